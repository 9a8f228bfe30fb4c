"""Corpus queries on the smallest tables: SQL where there is some, and the pipeline's stages."""

import pytest

from oracle import connect, same
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, name):
    same(spark, connect(sf), sf, QUERIES[name], ORACLE[name])


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, last = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, last, sf)
        assert out.columns == names and 0 < out.count() <= last.count()
        last = corpus_pipeline.written(out, "test")
    packed = corpus_pipeline.STAGES[-1][1](spark, last, sf)
    assert packed.select("doc_id").distinct().count() == last.count()
