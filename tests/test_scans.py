"""Scans in blocks and rank selection against whole-series windows and Spark's own quantiles."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oracle import connect, same
from tidemark.operators import runs, scans, selection, series
from tidemark.plans.oracles import ORACLE
from tidemark.plans.queries import QUERIES
from tidemark.sources import tables

KEYS = ("series_id",)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(-3, 3)), lambda: 1e300, lambda: -1e-310, lambda: 1e6 + rng.random() * 1e-6, lambda: None, lambda: None, lambda: -0.0]
    made = [(s, i, rng.choice(kinds)(), rng.choice([0, 0, 1, 1, 1, -1])) for s in range(4) for i in range(200) if rng.random() < 0.95]
    made += [(9, 5, None, 1), (10, 0, 1.5, 1)]
    return spark.createDataFrame(made, "series_id int, row_idx long, value double, label int").cache()


def same_rows(got, want, close=()):
    got, want = (df.select(want.columns).orderBy("series_id", "row_idx").collect() for df in (got, want))
    for a, b in zip(got, want, strict=True):
        for c in b.asDict():
            assert a[c] == (pytest.approx(b[c], rel=1e-9) if c in close and b[c] is not None else b[c]), (c, a, b)


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_scans_equal_windows(rows, size):
    got = scans.previous(rows, ["value", "label"], KEYS, size)
    got = scans.last_known(got, "value", KEYS, "known", size)
    got = scans.running(got, {"s": ("sum", "label"), "p": ("product", F.col("label") + 2.0), "m": ("max", "value"), "l": ("min", "value")}, KEYS, size)
    got = scans.run_starts(got, 1, KEYS, size)
    w = Window.partitionBy("series_id").orderBy("row_idx")
    begun = rows.where("label = 1").withColumn("g", F.col("row_idx") - F.row_number().over(w))
    begun = begun.select("series_id", "row_idx", F.min("row_idx").over(Window.partitionBy("series_id", "g")).alias("run_start"))
    want = rows.select("*", *(F.lag(c).over(w).alias(f"previous_{c}") for c in ("value", "label")), F.last("value", ignorenulls=True).over(w).alias("known"))
    want = want.select("*", F.sum("label").over(w).alias("s"), F.product(F.col("label") + 2.0).over(w).alias("p"), F.max("value").over(w).alias("m"), F.min("value").over(w).alias("l"))
    same_rows(got, want.join(begun, ["series_id", "row_idx"], "left"), close=("p",))


def test_numbered_in_many_ranges(rows):
    w = Window.partitionBy("series_id").orderBy("label", "old")
    plain = rows.withColumnRenamed("row_idx", "old")
    got = scans.numbered(plain, KEYS, ["label", "old"], 9)
    assert sorted(map(str, got.select("series_id", "old", "row_idx").collect())) == sorted(map(str, plain.select("series_id", "old", (F.row_number().over(w) - 1).alias("row_idx")).collect()))


def test_unknown_total(rows):
    with pytest.raises(ValueError, match="median"):
        scans.running(rows, {"x": ("median", "value")}, KEYS)


def test_repairs_in_small_blocks_equal_large_ones(rows, monkeypatch):
    def made():
        marks = rows.select("series_id", "row_idx", "label")
        cells = rows.withColumn("channel", F.lit(0)).withColumn("value", F.round("value", 3))
        timed = marks.withColumn("timestamp", (F.col("row_idx") * F.col("row_idx")).cast("double"))
        parts = [runs.runs(marks), runs.onset_cut(marks, 2), runs.context_fix(marks, onset=3, most=15), runs.audit(marks, most=9), series.fill(cells), series.difference(cells)]
        parts += [series.delta_t(timed), series.centre_and_scale(cells), series.centre_and_scale(cells, reference=F.col("row_idx") < 50)]
        return [sorted(map(str, p.select(sorted(p.columns)).collect())) for p in parts]

    large = made()
    for size in (1, 8):
        monkeypatch.setattr(scans, "BLOCK", size)
        monkeypatch.setattr(selection, "HOT_ROWS", 20)
        assert made() == large


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_over_the_cells_of_a_series(rows):
    marks, cells = rows.select("series_id", "row_idx", "label"), rows.withColumn("channel", F.lit(0))
    for df in (runs.runs(marks), runs.context_fix(marks, onset=2), series.difference(cells), scans.last_known(cells, "value", KEYS, "known")):
        windows = [x.split("], [") for x in plan(df).splitlines() if "Window [" in x]
        by_row = [x for x in windows if "row_idx#" in x[-1]]
        assert by_row and all("block_" in x[-2] for x in by_row), windows


@pytest.mark.parametrize(("parts", "hot"), [(2, 0), (1024, 0), (1024, 100), (1024, 10_000)])
def test_quantiles_are_exact(rows, monkeypatch, parts, hot):
    monkeypatch.setattr(selection, "PARTS", parts)
    monkeypatch.setattr(selection, "HOT_ROWS", hot)
    wanted = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.0, "e": 1.0, "f": 0.333}
    got = selection.quantiles(rows, KEYS, "value", wanted).orderBy("series_id").collect()
    want = rows.where("value is not null").groupBy("series_id").agg(*(F.percentile("value", p).alias(n) for n, p in wanted.items())).orderBy("series_id").collect()
    assert got == want


def test_one_hot_channel_is_spread(spark):
    cells = spark.range(200_000).select(F.lit(0).alias("series_id"), F.rand(7).alias("value"))
    counts = selection.selected(cells, KEYS, "value", {"m": 0.5})
    assert counts.first()["m"] == cells.agg(F.median("value")).first()[0]
    # The largest set of values that one task puts in order: those of one part of one bin.
    x = cells.withColumn("bin", selection._log_bin(F.col("value")))
    low, high = F.min("value").over(Window.partitionBy("bin")), F.max("value").over(Window.partitionBy("bin"))
    each = x.withColumn("part", selection._part(F.col("value"), low, high)).groupBy("bin", "part").count()
    assert each.agg(F.max("count")).first()[0] < 50 and x.select("bin").distinct().count() < 1_000


def test_nan_is_left_out(spark):
    cells = spark.createDataFrame([(0, 1.0), (0, float("nan")), (0, None), (0, 3.0), (1, None)], "series_id int, value double")
    assert [tuple(r) for r in selection.medians(cells, KEYS, "value").collect()] == [(0, 2.0)]


def spread(df):
    """Rows of each partition."""
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


def test_cold_series_are_dealt_by_rows(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    monkeypatch.setattr(selection, "TASK_ROWS", 50)
    made = spread(tables.event_series(spark, sf))
    assert len(made) > 8 and sum(made) == rows.count()
    monkeypatch.setattr(selection, "HOT_ROWS", 20)  # a series of more rows than that would be one task's
    assert selection.dealt(rows, ("user_id",)) is rows
    assert selection.dealt(rows, ("user_id",), fine=True) is not rows


@pytest.mark.parametrize("name", ["inject_template", "result_frame", "detect_short_series", "vus_pr", "robust_normalize"])
def test_dealt_rows_give_the_same_as_sql(spark, sf, monkeypatch, name):
    monkeypatch.setattr(selection, "TASK_ROWS", 50)
    same(spark, connect(sf), sf, QUERIES[name], ORACLE[name])
