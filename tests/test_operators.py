"""Hand-computed cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import events, generate, inject, label_rules, labels, metrics, reshape, runs, scoring, selection, series
from tidemark.plans import queries
from tidemark.schema import BUFFERS
from tidemark.sources import tables


def cells(spark, values, series_id="a"):
    rows = [(series_id, i, float(i), 0, None if v is None else float(v), 0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, row_idx long, timestamp double, channel int, value double, label int")


def labelled(spark, marks, series_id="a"):
    return spark.createDataFrame([(series_id, i, y) for i, y in enumerate(marks)], "series_id string, row_idx long, label int")


def column(df, name, by="row_idx"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize(("values", "want"), [([None, 1, None, 3], [1, 1, 1, 3]), ([None, None, 2, None, 8], [2, 2, 2, 2, 8]), ([None, None], [0, 0])])
def test_fill(spark, values, want):
    assert column(series.fill(cells(spark, values)), "filled") == want


@pytest.mark.parametrize(("values", "want"), [([1, 2, 3, 4, 100], [-1.349, -0.674, 0, 0.674, 50]), ([5, 5, 5, 9], [0, 0, 0, 2.3094]), ([7, 7, 7], [0, 0, 0])])
def test_robust_normalize(spark, values, want):
    assert column(series.robust_normalize(cells(spark, values)), "z") == pytest.approx(want, abs=1e-3)


def test_robust_normalize_nan_is_null(spark):
    made = cells(spark, [1, 2, float("nan"), 3]).withColumn("value", C.missing("value"))
    assert column(series.robust_normalize(made), "z")[2] is None


def test_delta_t(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.0, 10.0, 20.0, 50.0])] + [("b", 0, 5.0)], "series_id string, row_idx long, timestamp double")
    out = series.delta_t(rows)
    assert column(out.where("series_id = 'a'"), "delta_t") == pytest.approx([0, math.log(2), math.log(2), math.log(4)])
    assert column(out.where("series_id = 'b'"), "delta_t") == [0]


def test_runs(spark):
    got = runs.runs(labelled(spark, [0, 1, 1, 0, 1])).orderBy("start").collect()
    assert [(r["start"], r["stop"], r["length"]) for r in got] == [(1, 3, 2), (4, 5, 1)]


def test_onset_cut(spark):
    assert column(runs.onset_cut(labelled(spark, [0, 1, 1, 1, 1, 0]), 2), "label") == [0, 1, 1, -1, -1, 0]


def test_context_fix(spark):
    marks = [1, 1, 0, 0, 0, 1] + [0] * 14
    assert column(runs.context_fix(labelled(spark, marks)), "label") == [-1, -1, 0, 0, 0, 1] + [0] * 14


def test_audit(spark):
    got = runs.audit(labelled(spark, [1] * 60 + [0] * 40)).first()
    assert (got["ratio"], got["longest"], got["context"], got["events"]) == (0.6, 60, 0, 1)
    assert (got["flag_ratio"], got["flag_long"], got["flag_context"], got["flag"]) == (True, False, True, True)


def test_row_targets(spark):
    rows = [(i, c, y) for i, row in enumerate([[0, 0], [0, 1], [0, -1], [-1, 1]]) for c, y in enumerate(row)]
    made = spark.createDataFrame([("a", *r) for r in rows], "series_id string, row_idx long, channel int, label int")
    assert column(labels.row_targets(made), "label") == [0, 1, -1, 1]


def test_supervision(spark):
    made = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 0), ("a", 0, 2, -1), ("a", 1, 0, 1), ("a", 1, 1, 1)], "series_id string, row_idx long, channel int, label int")
    one = labels.supervision(made.where("row_idx = 0"), F.lit(1.0), F.lit("cell"))
    assert [(r["target"], r["weight"], r["row_weight"]) for r in one.orderBy("channel").collect()] == [(1, 1.0, 0.0), (0, 1.0, 0.0), (0, 0.05, 0.0)]
    two = labels.supervision(made.where("row_idx = 1"), F.lit(0.3), F.lit("row"))
    assert [(r["target"], r["weight"], r["row_weight"]) for r in two.collect()] == [(-1, 0.0, 0.3)] * 2


def test_label_confidence(spark):
    made = spark.createDataFrame([(None, "weak"), (None, "predictive"), (None, "source"), (0.5, "weak"), (float("nan"), "weak")], "c double, q string")
    assert [r[0] for r in made.select(C.label_confidence("c", "q")).collect()] == [0.2, 0.3, 1.0, 0.5, 0.2]


@pytest.mark.parametrize(("scores", "how", "k", "want"), [([0.1, 0.9, 0.5, 0.3], "topk", 3, 0.5666667), ([0.1, 0.9, 0.5, 0.3], "max", 1, 0.9), ([0.1, 0.9, 0.5, 0.3], "noisy_or", 2, 0.95), ([0.2, 0.4], "topk", 5, 0.3)])
def test_row_score(spark, scores, how, k, want):
    assert spark.createDataFrame([(scores,)], "s array<double>").select(C.row_score("s", how, k)).first()[0] == pytest.approx(want)


def test_combine_scales(spark):
    made = spark.createDataFrame([(0.2, 0.6, 0.8), (0.2, None, 0.8)], "p double, a double, b double")
    assert [r[0] for r in made.select(C.combine_scales("p", ["a", "b"], "max")).collect()] == [0.8, 0.8]
    assert [r[0] for r in made.select(C.combine_scales("p", ["a", "b"], "equal")).collect()] == pytest.approx([0.5333333, 0.5])
    assert [r[0] for r in made.select(C.combine_scales("p", ["a", "b"], "mean")).collect()] == pytest.approx([0.6, 0.5])


def test_calibration(spark):
    made = spark.createDataFrame([(0.9,)], "p double")
    assert made.select(C.calibrate("p", 2.0, 0.0)).first()[0] == pytest.approx(0.75)
    assert made.select(C.calibrate("p")).first()[0] == 0.9
    assert [C.sensitivity(0.5, s) for s in ("low", "medium", "high")] == [0.75, 0.5, 0.3]


def test_robust_probability(spark):
    made = spark.createDataFrame([(3.0,), (4.0,), (13.0,)], "z double")
    assert [r[0] for r in made.select(C.robust_probability("z")).collect()] == pytest.approx([0, 0.6321206, 0.9999546])


@pytest.mark.parametrize(("n", "want"), [(10000, [0, 2048, 4096, 5904]), (8192, [0, 2048, 4096]), (100, [0])])
def test_window_starts(spark, n, want):
    assert spark.range(1).select(series.window_starts(F.lit(n), 4096, 2048)).first()[0] == want


@pytest.mark.parametrize("n", [5, 8, 9, 23])
def test_rows_find_their_windows(spark, n):
    made = series.in_windows(labelled(spark, [0] * n), 8, 4).groupBy("start").agg(F.count("*").alias("n"), F.min("row_idx").alias("low")).orderBy("start").collect()
    want = spark.range(1).select(series.window_starts(F.lit(n), 8, 4)).first()[0]
    assert [r["start"] for r in made] == want and all(r["n"] == min(8, n) and r["low"] == r["start"] for r in made)


def test_triangle(spark):
    got = spark.range(5).select(C.triangle(F.col("id"), F.lit(5)).alias("w")).collect()
    assert [r["w"] for r in got] == pytest.approx([0.1, 0.55, 1.0, 0.55, 0.1])


def test_block_downsample(spark):
    out = reshape.block_downsample(cells(spark, [1, 3, 5, None, 7]), 2)
    assert column(out, "value") == [2, 5]
    made = cells(spark, [0] * 6).drop("label").join(labelled(spark, [0, 0, 1, -1, 0, -1]), ["series_id", "row_idx"])
    assert column(reshape.block_downsample(made, 2), "label") == [0, 1, -1]


def test_ranking_with_ties(spark):
    rows = list(zip([1, 0, 1, 0, 1, 0, -1], [0.9, 0.9, 0.8, 0.7, 0.7, 0.1, 0.95], strict=True))
    made = spark.createDataFrame([("a", i, y, s) for i, (y, s) in enumerate(rows)], "series_id string, row_idx long, label int, score double")
    got = metrics.ranking(made).first()
    assert (got["average_precision"], got["roc_auc"], got["best_f1"]) == pytest.approx((0.5888889, 0.6666667, 0.75))
    assert metrics.row_metrics(made).first()["n"] == 6


def test_dilation_of_zero_is_average_precision(spark):
    made = spark.createDataFrame([("a", i, int(i % 5 == 0), (i * 7 % 11) / 11) for i in range(40)], "series_id string, row_idx long, label int, score double")
    assert metrics.range_precision(made, (0,)).first()["vus_pr"] == pytest.approx(metrics.ranking(made).first()["average_precision"])
    assert metrics.range_precision(made, BUFFERS).first()["vus_pr"] > 0


@pytest.mark.parametrize(("rows", "want"), [([("x", True, 0.5, 0.5), ("y", False, 0.8, 0.8)], 0.59), ([("x", True, 0.5, 0.5)], 0.5)])
def test_source_score(spark, rows, want):
    made = spark.createDataFrame(rows, "source string, unseen boolean, average_precision double, roc_auc double")
    assert metrics.source_score(made).first()["score"] == pytest.approx(want)


def test_role_order(spark):
    made = spark.createDataFrame(
        [("a", "b", "s1", False, "k", False, 0.1), ("b", None, "s1", False, "k", False, 0.6), ("c", None, "s1", True, "k", False, None), ("d", None, "x", False, "h", False, 0.1), ("e", None, "x", False, "k", True, 0.1), ("f", None, "x", False, "k", False, 0.1)],
        "series_id string, benchmark string, source string, unlabeled boolean, sector string, is_val boolean, anomaly_row_ratio double",
    )
    got = {r["series_id"]: r["role"] for r in labels.roles(made, ["s1"], ["s2"], ["h"]).collect()}
    assert got == {"a": "benchmark", "b": "holdout", "c": "holdout", "d": "holdout", "e": "val", "f": "train"}


def test_volatility_order(spark):
    rows = [("a", i, 0, v) for i, v in enumerate([2, 4, 6])] + [("a", i, 1, v) for i, v in enumerate([0, 1, 2])]
    made = spark.createDataFrame(rows, "series_id string, row_idx long, channel int, value long").withColumn("value", F.col("value").cast("double"))
    got = {r["channel"]: r["volatility"] for r in series.volatility(made).collect()}
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(1.0)


def test_interval_precedence_and_open_end(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)], "series_id string, timestamp double")
    table = spark.createDataFrame([("a", 2.0, 5.0, -1), ("a", 4.0, 6.0, 1), ("a", 8.0, None, -1), ("a", 7.5, 7.6, 1)], "series_id string, a double, b double, label int")
    assert column(reshape.interval_label(rows, table, "timestamp", 3.0), "label", "timestamp") == [0, 0, -1, -1, 1, 1, 1, 0, -1, -1]


def test_asof(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 3.0, 3)], "series_id string, t double, id int")
    right = spark.createDataFrame([("a", 2.0, 20.0), ("a", 3.0, 30.0), ("b", 4.0, 40.0)], "series_id string, t double, v double")
    assert column(reshape.asof_align(left, right, "series_id", "t", ["v"]), "v", "id") == [None, 30.0, None]


def test_merge_duplicates_takes_finite_values(spark):
    rows = [("a", 1.0, 0, 1.0), ("a", 1.0, 0, float("inf")), ("a", 1.0, 0, 3.0), ("a", 2.0, 0, float("nan"))]
    out = reshape.merge_duplicates(spark.createDataFrame(rows, "series_id string, timestamp double, channel int, value double"))
    assert [(r["row_idx"], r["value"]) for r in out.orderBy("row_idx").collect()] == [(0, 2.0), (1, None)]


def test_long_and_wide(spark):
    wide = spark.createDataFrame([(1, 1.0, float("nan")), (2, 3.0, 4.0)], "row_idx int, x double, y double")
    back = reshape.to_wide(reshape.to_long(wide, ["row_idx"], ["x", "y"]), ["row_idx"], [0, 1]).orderBy("row_idx").collect()
    assert [tuple(r) for r in back] == [(1, 1.0, None), (2, 3.0, 4.0)]


def test_injection_labels_changed_cells_only(spark):
    made = cells(spark, [i % 7 for i in range(40)])
    for kind in ("spike", "level_shift", "flatline", "drift", "noise_burst", "pattern_change", "missing_data"):
        out = inject.inject(made, kind, F.lit(10), F.lit(20), 4.0).withColumnRenamed("value", "new").select("row_idx", "new", F.col("label").alias("mark")).join(made, "row_idx")
        assert out.where("mark = 0 and not new <=> value").count() == 0
        assert out.where("mark = 1").count() > 0


def test_correlation_break_copies_a_stretch(spark):
    values = [float((i * i) % 11) for i in range(30)]
    for start, stop, step in ((10, 18, -8), (2, 8, 6), (1, 20, 19)):
        rows = inject.inject(cells(spark, values), "correlation_break", F.lit(start), F.lit(stop), 4.0).orderBy("row_idx").collect()
        want = [values[i + step] if start <= i < stop and i + step < 30 else x for i, x in enumerate(values)]
        assert [r["value"] for r in rows] == want and [r["label"] for r in rows] == [int(start <= i < stop) for i in range(30)]


def test_injection_without_effect_goes_back(spark):
    out = inject.inject(cells(spark, [5.0] * 30), "flatline", F.lit(10), F.lit(20), 4.0)
    assert out.where("label = 1").count() == 0


def test_matrix_profile_finds_the_odd_stretch():
    x = np.sin(np.arange(400) / 5)
    x[200:210] += 1.5
    d = scoring.nearest(x, 20, 5)
    assert 180 <= d.argmax() <= 210


def test_matrix_profile_against_definition():
    x = np.random.default_rng(0).normal(size=60)
    m, exclude = 8, 2
    w = np.stack([x[i : i + m] for i in range(53)])
    z = (w - w.mean(1, keepdims=True)) / w.std(1, keepdims=True)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    d[np.abs(np.subtract.outer(np.arange(53), np.arange(53))) <= exclude] = np.inf
    assert scoring.nearest(x, m, exclude) == pytest.approx(d.min(1), abs=1e-6)


def test_matrix_profile_of_whole_series(spark, sf):
    """Blocks of offsets together give the profile by definition, and the query scores every row."""
    rng = np.random.default_rng(3)
    made = {"a": rng.normal(size=(90, 2)) * [1, 3], "b": rng.normal(size=(61, 1)), "c": rng.normal(size=(9, 1))}
    rows = [(s, i, c, float(v)) for s, x in made.items() for (i, c), v in np.ndenumerate(x)]
    cells = spark.createDataFrame(rows, "series_id string, row_idx long, channel int, value double")
    got = {(r["series_id"], r["row_idx"]): r["score"] for r in scoring.matrix_profile(cells, block=7).collect()}
    assert len(got) == 160
    m, exclude = 8, 2
    for s, x in made.items():
        n = len(x) - m + 1
        total = np.zeros(len(x))
        if len(x) >= 2 * m:
            profiles = []
            for c in range(x.shape[1]):
                w = np.stack([x[i : i + m, c] for i in range(n)])
                z = (w - w.mean(1, keepdims=True)) / w.std(1, keepdims=True)
                d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
                d[np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= exclude] = np.inf
                profiles.append(d.min(1))
            padded = np.pad(np.mean(profiles, 0), (m // 2, m - 1 - m // 2), mode="edge")
            total = [padded[max(0, i - m // 2) : i + m // 2].mean() for i in range(len(x))]
        assert [got[s, i] for i in range(len(x))] == pytest.approx(list(total), abs=1e-6)
    days = tables.daily_series(spark, sf)
    assert queries.QUERIES["matrix_profile"](spark, sf).count() == days.count() > days.where("row_idx < 400").count()


def test_frozen_reference_keeps_anomalies_out():
    x = np.concatenate([np.tile([0.0, 1, 2, 1], 64), np.tile([0.0, 1, 2, 1], 64) + 30])[:, None]
    p = scoring.fold_windows(x, 64, 32, 0.5)[:, 0]
    assert p[:200].max() < 0.5 and p[300:].min() > 0.5


def test_detect_and_predict(spark):
    rows = [("a", float(i), 0, 50.0 if 40 <= i < 43 else float(i % 5)) for i in range(100)] + [("b", float(i), 0, 1.0) for i in range(5)]
    made = spark.createDataFrame(rows, "series_id string, timestamp double, channel int, value double")
    _, found = scoring.detect(made)
    assert [(r["series_id"], r["start"], r["stop"]) for r in found.collect()] == [("a", 40, 42)]
    assert [r["type"] for r in found.collect()] == ["anomaly"]
    assert scoring.predict(made).agg(F.count("*"), F.sum("anomaly")).first() == (105, 3)


def test_detect_calibrates_cells_and_fills_short_series(spark):
    """Channels of an event are those whose calibrated cells exceed the threshold of the level."""
    z = {0: 3.25, 1: 5.0}  # deviations in units of the scale: raw probabilities of about 0.2 and 0.86
    base = [math.sin(7.0 * i) for i in range(99)]
    centre = float(np.median(base))
    scale = float(np.median(np.abs(np.array(base) - centre))) * 1.4826
    rows = [("a", float(i), c, centre + scale * z[c] if i == 50 else base[i]) for i in range(99) for c in z]
    rows += [("b", float(i), 0, None if i == 3 else 90.0 if i == 7 else float(i % 3)) for i in range(12)]
    made = spark.createDataFrame(rows, "series_id string, timestamp double, channel int, value double")
    seen = {}
    for level, temperature in (("low", 1.0), ("medium", 1.0), ("high", 3.0)):
        flagged, found = scoring.detect(made, level=level, how="max", temperature=temperature, use_types=True)
        seen[level] = {r["series_id"]: (r["start"], r["channels"], r["type"]) for r in found.collect()}
        assert flagged.where("series_id = 'b'").count() == 12
    assert seen["low"]["a"] == (50, "1", "anomaly") and seen["medium"]["a"] == (50, "1", "anomaly")
    assert seen["high"]["a"][1] == "0,1" and all(s["b"] == (7, "0", "spike") for s in seen.values())


def test_detect_in_windows_and_against_a_reference(spark):
    x = [float(i % 4) + (30 if i >= 150 else 0) for i in range(300)]
    made = spark.createDataFrame([("a", float(i), 0, v) for i, v in enumerate(x)], "series_id string, timestamp double, channel int, value double")
    rows, found = scoring.detect(made, max_t=64)
    p = scoring.fold_windows(np.array(x)[:, None], 64, 32, 0.5)[:, 0]
    assert [r["score"] for r in rows.orderBy("row_idx").collect()] == pytest.approx(list(p), abs=1e-9)
    assert found.agg(F.max("stop")).first()[0] == 299
    calm = spark.createDataFrame([("a", i, 0, float(i % 4)) for i in range(40)], "series_id string, row_idx int, channel int, value double")
    rows, _ = scoring.detect(made, max_t=64, normal=calm)
    assert rows.where("anomaly = 1").agg(F.min("row_idx"), F.count("*")).first() == (150, 150)


def test_results_do_not_depend_on_partitions(spark):
    made = cells(spark, [i * 37 % 101 for i in range(60)])
    one = column(series.robust_normalize(series.local_deviation(made.repartition(1), 8, "ms")), "ms")
    assert one == column(series.robust_normalize(series.local_deviation(made.repartition(7, "row_idx"), 8, "ms")), "ms")


def test_generator(spark):
    made = generate.generate(spark, 30, rows=128, seed=3)
    again = generate.generate(spark, 30, rows=128, seed=3, partitions=3)
    mark = lambda df: df.agg(F.count("*"), F.sum("label"), F.round(F.sum(F.abs("value")), 3)).first()
    assert mark(made) == mark(again)
    assert made.where(F.isnan("value") | ((F.col("label") == 1) != (F.col("type") > 0))).count() == 0
    assert len(generate.DOMAINS) == 18 and sum(map(len, generate.SCENARIOS.values())) >= 60


def test_upsert_and_budget(spark):
    old = spark.createDataFrame([(1, "o"), (2, "o")], "id int, v string")
    new = spark.createDataFrame([(2, "n"), (3, "n")], "id int, v string")
    assert sorted(tuple(r) for r in reshape.upsert(old, new, "id").collect()) == [(1, "o"), (2, "n"), (3, "n")]
    sizes = spark.createDataFrame([("a", 1, 9), ("a", 2, 1), ("b", 1, 3), ("b", 2, 1), ("b", 3, 2)], "s string, id int, n int")
    assert sorted((r["s"], r["id"]) for r in labels.budget(sizes, "s", "n", [F.col("id")], 4).collect()) == [("a", 1), ("b", 1), ("b", 2)]


def test_ways_are_compared(spark):
    rows = [("a", 1, True, 0.6, 0.6), ("b", 1, True, 0.605, 0.605), ("c", 1, True, 0.7, 0.7), ("d", 1, True, 0.7, 0.7), ("e", 1, True, None, None)]
    found = spark.createDataFrame(rows, "way string, source int, unseen boolean, average_precision double, roc_auc double")

    def chosen(base, *ways):
        return [r["way"] for r in metrics.compared(found.where(F.col("way").isin(*ways)), base).where("chosen").collect()]

    assert chosen(None, *"abcde") == ["c"]
    assert chosen("a", *"abcde") == ["c"]
    assert chosen("a", "a", "b") == ["a"]
    assert chosen("x", "a", "b") == ["b"]
    assert chosen(None, "e") == []


def test_windows_that_can_be_learned_from(spark):
    schema = "series_id int, window int, row_idx int, channel int, value double, label int"
    rows = [(1, w, 4 * w + i, c, None if c == 2 else float(i * c), int(i < hits)) for w, hits in ((0, 2), (1, 3)) for i in range(4) for c in range(3)]
    windows = spark.createDataFrame(rows, schema)
    assert {r["channel"] for r in labels.usable_channels(windows).collect()} == {1}
    assert labels.without_dense(windows).select("window").distinct().collect() == [(0,)]
    assert labels.without_dense(windows, F.col("window") == 1).count() == len(rows)
    assert labels.without_dense(windows.limit(0)).count() == labels.usable_channels(windows.limit(0)).count() == 0


def test_false_alarms_by_channel(spark):
    rows = [("a", i, c, 0.9 if i < 5 - c else 0.1, y) for i, y in enumerate((0, 0, 0, 1, -1)) for c in range(6)]
    cells = spark.createDataFrame(rows, "series_id string, row_idx int, channel int, p double, label int")
    got = [(r["channel"], round(r["rate"], 3)) for r in metrics.false_alarms(cells, k=4).orderBy("place").collect()]
    assert got == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.667)]


def test_template_is_stretched_and_added(spark):
    bank = spark.createDataFrame([("t", 7, 3, 2, p, float(z)) for p, z in ((-1, 9), (0, 4), (1, 8), (2, 0))], "series_id string, start long, channel int, length long, place long, z double")
    values = [0.0, 1.0] * 10
    one = cells(spark, values)
    placed = spark.createDataFrame([("a", "t", 7, 4, 5 / 3, 2.0)], "series_id string, template string, template_start long, start int, stretch double, gain double")
    got = inject.from_template(one, bank, placed).orderBy("row_idx").collect()
    scale = 0.5 * 1.4826
    want = list(values)
    for i, z in enumerate((4, 6, 8, 4, 0)):
        want[4 + i] += z * 2 * scale
    assert [r["value"] for r in got] == pytest.approx(want)
    assert [r["label"] for r in got] == [int(4 <= i < 7) for i in range(20)]
    assert [r["type"] for r in got] == [-int(4 <= i < 7) for i in range(20)]
    late = placed.withColumn("start", F.lit(16))
    busy = one.withColumn("label", (F.col("row_idx") == 5).cast("int"))
    for rows, where in ((one, late), (busy, placed), (one, placed.withColumn("gain", F.lit(0.01))), (one, placed.limit(0))):
        same = inject.from_template(rows, bank, where).orderBy("row_idx").collect()
        assert [(r["value"], r["label"], r["type"]) for r in same] == [(r["value"], r["label"], 0) for r in rows.orderBy("row_idx").collect()]


def test_times_of_any_form(spark):
    made = spark.createDataFrame([("a", 1.7e9), ("a", 1.7e9 + 1), ("b", 1.7e12), ("b", 1.7e12 + 500), ("b", None)], "series_id string, timestamp double")
    assert sorted((r[0], r[1] or 0) for r in reshape.unix_times(made).select("series_id", "timestamp").collect()) == [("a", 1.7e9), ("a", 1.7e9 + 1), ("b", 0), ("b", 1.7e9), ("b", 1.7e9 + 0.5)]
    text = spark.createDataFrame([("a", "2024-01-01T00:00:01.5")], "series_id string, timestamp string")
    assert reshape.unix_times(text).first()["timestamp"] == reshape.unix_times(text.withColumn("timestamp", F.to_timestamp("timestamp"))).first()["timestamp"] == 1704067201.5
    rows = [("a", 1.7e12 + 1000 * i, 0, 50.0 if i == 40 else float(i % 5)) for i in range(100)]
    found = scoring.detect(spark.createDataFrame(rows, "series_id string, timestamp double, channel int, value double"), times="guess")
    assert [(r["start"], r["start_time"]) for r in found.events.collect()] == [(40, 1.7e9 + 40)]
    with pytest.raises(ValueError, match="times"):
        scoring.detect(made, times="hours")


def test_context_rule_on_cells(spark):
    marks = {0: [0] * 4 + [1, 1, 1] + [0] * 3, 1: [1, 0, -1, 0, 0, 1, 1, 0, 0, 0]}
    made = spark.createDataFrame([("a", i, c, y) for c, ys in marks.items() for i, y in enumerate(ys)], "series_id string, row_idx long, channel int, label int")
    got = runs.context_fix_cells(made, onset=2, most=1, share=1)
    # The first row's event has no normal row before it, the third row of the other one is cut; cells that aren't anomalous stay.
    assert column(got.where("channel = 1"), "label") == [-1, 0, -1, 0, 0, 1, -1, 0, 0, 0] and column(got.where("channel = 0"), "label") == [0] * 4 + [1, 1, -1] + [0] * 3


def test_events_by_cell_count_marked_channels_only(spark):
    rows = [("lead1", i, c, math.sin(i * (c + 1.7)) + (20 if 60 <= i < 70 and c < 2 else 0), int(60 <= i < 70 and c == 0)) for i in range(120) for c in range(3)]
    made = spark.createDataFrame(rows, "series_id string, row_idx long, channel int, value double, label int")
    catalog = spark.createDataFrame([("lead1", "lead", False, "cell"), ("x", "lead", True, "cell")], "series_id string, source string, unlabeled boolean, label_level string")
    one = events.real_events(made, catalog).collect()
    assert [(r["source"], r["start"], r["n_affected"], round(r["affected_share"], 6)) for r in one] == [("lead", 60, 1, 0.333333)]
    whole = made.withColumn("label", F.when(F.col("row_idx").between(60, 69), 1).otherwise(0))
    two = events.real_events(whole, catalog.withColumn("label_level", F.lit("row"))).first()
    assert (two["n_affected"], two["affected_share"]) == (3, 1.0)  # a wave deviates, too, from its own median
    assert events.real_events(made, catalog.withColumn("source", F.lit("skab"))).count() == 0


def test_fault_variants_are_checked(spark):
    made = cells(spark, [math.sin(i) for i in range(60)])
    with pytest.raises(ValueError, match="variant"):
        inject.inject(made, "spike", F.lit(3), F.lit(5), 3.0, "noisy")
    with pytest.raises(ValueError, match="fault"):
        inject.inject(made, "normal", F.lit(3), F.lit(5), 3.0)
    one, two = (inject.inject(made.repartition(k), "noise_burst", F.lit(20), F.lit(40), 6.0, "ramped") for k in (1, 5))
    assert column(one, "value") == column(two, "value") and sum(column(one, "label")) == 20


@pytest.mark.parametrize(("n", "share", "first"), [(90, 0.7, 63), (170, 0.7, 119), (10, 0.7, 7), (66, 0.7, 46), (3, 1 / 3, 1)])
def test_unknown_share_is_counted_in_whole_rows(spark, n, share, first):
    made = label_rules.half_known(labelled(spark, [0] * n), share).where("label = 0").agg(F.min("row_idx")).first()[0]
    assert made == first


def joined(df):
    return "Join" in df._jdf.queryExecution().optimizedPlan().toString()


def test_cold_channels_are_scaled_without_joins(spark, monkeypatch):
    made = cells(spark, [1.0, 2.0, None, 9.0, 2.5, 2.0]).unionByName(cells(spark, [3.0] * 5, "b"))
    cold = series.robust_normalize(made)
    assert not joined(cold)
    monkeypatch.setattr(selection, "HOT_ROWS", 3)
    hot = series.robust_normalize(made)
    key = lambda df: {(r["series_id"], r["row_idx"]): r["z"] for r in df.collect()}
    assert joined(hot) and key(cold) == pytest.approx(key(hot))


def test_range_precision_takes_scores_once(spark):
    made = labelled(spark, [0, 1, 0, 0]).unionByName(labelled(spark, [1, 1], "b")).unionByName(labelled(spark, [0, -1], "c"))
    found = metrics.range_precision(made.withColumn("score", F.col("row_idx") / 4), (0, 1))
    assert not joined(found)
    assert [r["series_id"] for r in found.collect()] == ["a"]


def test_rows_of_plain_cells_are_not_calibrated(spark):
    made = spark.createDataFrame([("a", 0, 0, 0.6, True), ("b", 0, 0, 0.6, False), ("b", 0, 1, 0.2, False)], "series_id string, row_idx long, channel int, p double, short boolean")
    found = {r["series_id"]: r for r in events.decide(made, 0.5, bias=5.0, how="max", plain="short").collect()}
    assert found["a"]["score"] == 0.6 and found["b"]["score"] > 0.9
