"""Draws, training windows, batches of like size, closures and correlations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, sampling, scans, series

CATALOG = [(f"s{i}", "ab"[i % 2], n, k, level, 1.0) for i, (n, k, level) in enumerate([(400, 3, "cell"), (100, 1, "cell"), (900, 2, "row"), (30, 4, "cell"), (0, 2, "cell")])]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "series_id string, sector string, n_rows long, n_channels int, label_level string, confidence double")


def items(spark, n, partitions=3):
    return spark.range(n).withColumnRenamed("id", "item").repartition(partitions)


def test_draws_are_as_frequent_as_their_weights(spark, catalog):
    n = 20_000
    drawn = sampling.weighted_draws(items(spark, n), catalog, "sector", F.sqrt("n_rows"))
    got = Counter(r["series_id"] for r in drawn.collect())
    assert sum(got.values()) == n and got["s4"] == 0
    for sector in "ab":
        pull = {s: math.sqrt(rows) for s, name, rows, *_ in CATALOG if name == sector}
        for s, w in pull.items():
            share = w / sum(pull.values()) / 2
            assert abs(got[s] / n - share) <= sampling.likely(n, share)


def test_draws_depend_on_nothing_but_the_item(spark, catalog, monkeypatch):
    def made(partitions):
        drawn = sampling.placed(sampling.weighted_draws(items(spark, 300, partitions), catalog.repartition(partitions), "sector", F.sqrt("n_rows")), max_t=64)
        return sorted(map(str, drawn.select(sorted(drawn.columns)).collect()))

    one = made(1)
    monkeypatch.setattr(scans, "BLOCK", 1)
    assert made(7) == one and len(one) == 300


def test_placed_windows_fit_their_series(spark, catalog):
    drawn = sampling.placed(sampling.weighted_draws(items(spark, 3_000), catalog, "sector", F.sqrt("n_rows")), max_t=64).collect()
    for r in drawn:
        steps = r["n_rows"] // r["factor"]
        assert 0 <= r["start"] and r["start"] + r["length"] <= steps and 1 <= r["channels"] <= r["n_channels"]
        assert r["factor"] == 1 or steps >= 40
        assert r["length"] == min(64, steps) or 20 <= r["length"] <= steps
        assert r["label_level"] == "cell" or r["channels"] == r["n_channels"]
    full = [r["length"] == 64 for r in drawn if r["n_rows"] // r["factor"] >= 64]
    assert 0.45 < np.mean(full) < 0.6 and len({r["factor"] for r in drawn}) == 7


def test_training_windows_are_cut_from_their_series(spark, catalog, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", 16)
    rng = random.Random(2)
    values, marks = {}, {}
    for s, _, n, k, level, _ in CATALOG:
        for i in range(n):
            row = rng.choice([0] * 8 + [1, -1])
            for c in range(k):
                values[s, i, c] = 5.0 if c == 3 else rng.gauss(0, 1)
                marks[s, i, c] = row if level == "row" else rng.choice([0] * 9 + [1, -1])
    cells = spark.createDataFrame([(s, i, float(i), c, v, marks[s, i, c]) for (s, i, c), v in values.items()], "series_id string, row_idx long, timestamp double, channel int, value double, label int")
    drawn = sampling.placed(sampling.weighted_draws(items(spark, 60), catalog, "sector", F.sqrt("n_rows")), max_t=64)
    spans = {r["item"]: r for r in drawn.withColumn("mean", sampling.hashed()("mean") < 0.5).collect()}
    by_item = {}
    for r in sampling.training_windows(cells, drawn).collect():
        by_item.setdefault(r["item"], {})[r["row_idx"], r["channel"]] = r
    assert len(by_item) > 40
    for item, got in by_item.items():
        span = spans[item]
        s, f, level = span["series_id"], span["factor"], span["label_level"]
        channels = {c for _, c in got}
        assert 3 not in channels and len(channels) in (span["channels"], span["channels"] - 1)
        assert set(got) == {(i, c) for i in range(span["length"]) for c in channels}
        hits = 0
        for i in range(span["length"]):
            rows = [(span["start"] + i) * f + j for j in range(f)][: None if span["mean"] else 1]
            labels = {c: 1 if 1 in (m := [marks[s, x, c] for x in rows]) else 0 if set(m) == {0} else -1 for c in channels}
            positive = 1 in labels.values()
            hits += positive
            for c in channels:
                r = got[i, c]
                assert r["value"] == pytest.approx(np.mean([values[s, x, c] for x in rows])) and r["label"] == labels[c] and r["timestamp"] == rows[0]
                if level == "row" and positive:
                    assert (r["target"], r["weight"], r["row_weight"]) == (-1, 0.0, 1.0)
                else:
                    assert (r["target"], r["weight"], r["row_weight"]) == (max(0, labels[c]), 1.0 if labels[c] >= 0 else 0.05, 0.0)
        assert hits <= 0.6 * span["length"]


def test_batches_are_within_their_budget(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, 3, 7, 8, 9, 500, rng.randint(1, 4096)]), rng.randint(1, 100)) for i in range(2_000)]
    out = sampling.bucketed(spark.createDataFrame(rows, "item long, t long, k long"), "t", "k", 100_000)
    batches = {}
    for r in out.collect():
        batches.setdefault((r["bucket"], r["batch"]), []).append((r["t"], r["k"]))
    assert sum(map(len, batches.values())) == len(rows)
    padded = used = 0
    for own in batches.values():
        size = len(own) * max(t for t, _ in own) * max(k for _, k in own)
        assert size <= 100_000 or len(own) == 1
        padded, used = padded + size, used + sum(t * k for t, k in own)
    assert used / padded > 0.75
    with pytest.raises(ValueError):
        sampling.bucketed(out, "t", "k", 0)


def test_closure_of_a_long_chain_and_a_ring(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(i, i + 1) for i in range(200, 205)] + [(205, 200), (300, None)], "a long, b long")
    got = {tuple(r) for r in graph.closure(chain).collect()}
    assert got == {(i, j) for i in range(100) for j in range(i + 1, 101)} | {(i, j) for i in range(200, 206) for j in range(200, 206)}
    assert graph.closure(chain.limit(0)).count() == 0


def test_correlations_of_many_channels(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 500)) @ np.diag(rng.uniform(0.1, 5, 500)) + 1e6
    x[:, 1] = 2 * x[:, 0] - 7
    x[:, 2] = 4.0
    x[rng.random(x.shape) < 0.05] = np.nan
    cells = spark.createDataFrame([("a", i, c, float(v)) for (i, c), v in np.ndenumerate(x) if not np.isnan(v)], "series_id string, row_idx long, channel int, value double")
    got = {(r["channel"], r["partner"]): (r["r"], r["n"]) for r in series.correlations(cells, block=25).collect()}
    assert len(got) == 500 * 499 // 2
    for a, b in [(0, 1), (0, 2), (0, 3), (17, 400), (498, 499)]:
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        r, n = got[a, b]
        assert n == both.sum() and (r is None if b == 2 else r == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-6))
    assert series.correlated_partner(cells).where("channel = 0").first()["partner"] == 1
