"""Each series query against its SQL on the smallest tables; those without SQL have to run."""

import pytest

from oracle import connect, same
from tidemark.plans.oracles import ORACLE
from tidemark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, sf, name):
    same(spark, con, sf, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
