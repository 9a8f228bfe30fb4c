"""Window scoring against plain loops over whole series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring, windows

SCHEMA = "series_id string, row_idx long, timestamp double, channel int, value double, label int"


def plain_fill(x):
    x = [[None if math.isnan(v) else v for v in column] for column in x.T]
    for column in x:
        for i in range(1, len(column)):
            if column[i] is None:
                column[i] = column[i - 1]
        known = [v for v in column if v is not None]
        for i, v in enumerate(column):
            if v is None:
                column[i] = float(np.median(known)) if known else 0.0
    return np.array(x).T


def plain_scale(x, by=None):
    by = x if by is None else by
    out = np.zeros(x.shape)
    for c in range(x.shape[1]):
        m = np.median(by[:, c])
        mad, sd = np.median(abs(by[:, c] - m)) * 1.4826, np.std(by[:, c])
        out[:, c] = (x[:, c] - m) / (mad if mad > 1e-8 else sd if sd > 1e-8 else 1.0)
    return np.clip(out, -50, 50)


def plain_p(z):
    return 1 - np.exp(-np.maximum(abs(z) - 3, 0))


def plain_windows(x, size, stride, given=None, threshold=None, how=None):
    """Blended scores; with a ``threshold``, each window against the last calm one."""
    n = len(x)
    starts = [0] if n <= size else list(range(0, n - size + 1, stride))
    if starts[-1] + size < n:
        starts.append(n - size)
    total, weight, calm = np.zeros(x.shape), np.zeros(n), given
    for s in starts:
        part = plain_fill(x[s : s + size])
        p = plain_p(plain_scale(part, calm))
        for i in range(len(part)):
            w = (1 - abs(2 * i / (len(part) - 1) - 1)) * 0.9 + 0.1
            total[s + i] += w * p[i]
            weight[s + i] += w
        if threshold is not None and max(how(row) for row in p[len(part) * 3 // 4 :]) < threshold:
            calm = part
    return total / weight[:, None]


def mean_of_top(k):
    return lambda row: float(np.mean(sorted(row)[-k:]))


def noisy(seed, n, channels):
    rng = random.Random(seed)
    x = np.array([[rng.gauss(0, 1) + (9 if rng.random() < 0.03 else 0) + (6 if i > 2 * n / 3 else 0) for _ in range(channels)] for i in range(n)])
    x[np.array([[rng.random() < 0.1 for _ in range(channels)] for _ in range(n)])] = np.nan
    x[:5, 0] = np.nan
    if channels > 2:
        x[:, 2] = np.nan
    return x


def long_form(spark, made):
    rows = [(s, i, 60.0 * i, c, None if math.isnan(v) else float(v), 0) for s, x in made.items() for i, row in enumerate(x) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, SCHEMA)


def matrix(df, n, channels):
    out = np.full((n, channels), np.nan)
    for r in df.collect():
        out[r["row_idx"], r["channel"]] = r["p"]
    return out


MADE = {"a": noisy(1, 150, 3), "b": noisy(2, 64, 2), "c": noisy(3, 30, 1)}


@pytest.mark.parametrize(("group", "batch_bytes", "partitions"), [(100, 64 << 20, 3), (2, 1, 7)])
def test_window_scores_are_those_of_a_loop(spark, group, batch_bytes, partitions):
    got = windows.window_scores(long_form(spark, MADE).repartition(partitions), 64, 32, group=group, batch_bytes=batch_bytes)
    for s, x in MADE.items():
        assert matrix(got.where(F.col("series_id") == s), *x.shape) == pytest.approx(plain_windows(x, 64, 32), abs=1e-9)


def test_windows_against_a_reference(spark):
    calm = {s: noisy(9, 40, x.shape[1]) for s, x in MADE.items() if s != "c"}
    calm = {s: np.nan_to_num(x) for s, x in calm.items()}
    normal = long_form(spark, calm).select("series_id", "row_idx", "channel", "value")
    got = scoring.windowed_scorer(64)(long_form(spark, MADE), normal)
    for s, x in MADE.items():
        want = plain_windows(x, 64, 32, calm.get(s))
        assert matrix(got.where(F.col("series_id") == s), *x.shape) == pytest.approx(want, abs=1e-9)
    for bad in (normal.where("row_idx < 10"), normal.where("channel = 0"), normal.withColumn("value", F.lit(float("inf")))):
        with pytest.raises(ValueError, match="normal reference"):
            scoring.windowed_scorer(64)(long_form(spark, MADE), bad)


@pytest.mark.parametrize(("how", "k", "plain"), [("topk", 3, mean_of_top(3)), ("topk", 1, max), ("max", 3, max), ("noisy_or", 2, lambda row: 1 - np.prod([1 - min(v, 1 - 1e-6) for v in sorted(row)[-2:]]) if len(row) > 1 else row[0])])
def test_frozen_reference_is_a_loop(spark, how, k, plain):
    got = scoring.frozen_reference(long_form(spark, MADE), size=32, threshold=0.4, how=how, k=k)
    for s, x in MADE.items():
        assert matrix(got.where(F.col("series_id") == s), *x.shape) == pytest.approx(plain_windows(x, 32, 16, None, 0.4, plain), abs=1e-9)


def test_frozen_reference_query(spark, sf):
    from tidemark.plans import queries

    cells = queries._hourly_rows(spark, sf).collect()
    got = {(r["series_id"], r["row_idx"]): r["p"] for r in queries.QUERIES["frozen_reference_fold"](spark, sf).collect()}
    assert len(got) == len(cells)
    for channel in {r["channel"] for r in cells}:
        x = np.array([[r["value"]] for r in sorted((r for r in cells if r["channel"] == channel), key=lambda r: r["row_idx"])], float)
        want = plain_windows(x, 128, 64, None, 0.5, max)
        assert [got[channel, i] for i in range(len(x))] == pytest.approx(list(want[:, 0]), abs=2e-6)


def test_a_learned_scorer_sees_whole_windows(spark):
    """Mean of a window's known cells, a figure that shows whether the window is whole and its padding masked."""

    def mean_of_window(batch):
        assert batch.values.shape[:2] == batch.time_mask.shape == batch.delta_t.shape and (batch.delta_t[:, 0] == 0).all()
        assert (batch.values[~batch.time_mask] == 0).all()
        cells = batch.time_mask[:, :, None] & batch.channel_mask[:, None, :]
        means = (batch.values * cells).sum((1, 2)) / cells.sum((1, 2))
        return np.broadcast_to(means[:, None, None], batch.values.shape)

    got = scoring.learned_scorer(mean_of_window, 64, batch_bytes=1 << 16)(long_form(spark, {"b": MADE["b"], "c": MADE["c"]}).repartition(5))
    for s in "bc":
        p = matrix(got.where(F.col("series_id") == s), *MADE[s].shape)
        assert p == pytest.approx(np.full(p.shape, plain_scale(plain_fill(MADE[s])).mean()), abs=1e-9)


def test_steps_in_a_window():
    assert windows.steps(np.array([0.0, 10, 20, 50])) == pytest.approx([0, math.log(2), math.log(2), math.log(4)])
    assert list(windows.steps(np.array([5.0]))) == [0]


def test_scales_average_the_reference_and_skip_short_ones(spark):
    x = {"a": np.random.default_rng(3).normal(size=(403, 2)), "b": np.random.default_rng(4).normal(size=(403, 2))}
    calm = {"a": x["a"][:90] + 1, "b": x["b"][:70] + 1}  # means of four leave 22 rows, and 17
    normal = long_form(spark, calm).select("series_id", (F.col("row_idx") + 1000).alias("row_idx"), "channel", "value")
    got = scoring.score_cells(long_form(spark, x), scoring.windowed_scorer(64), scales=(4,), how="equal", max_t=64, normal=normal)
    for s in x:
        p = plain_windows(x[s], 64, 32, calm[s])
        if s == "a":
            coarse = x[s][:400].reshape(100, 4, 2).mean(1)
            up = np.repeat(plain_windows(coarse, 64, 32, calm[s][:88].reshape(22, 4, 2).mean(1)), 4, axis=0)
            p = (p + np.concatenate([up, up[-1:], up[-1:], up[-1:]])) / 2
        assert matrix(got.where(F.col("series_id") == s), *p.shape) == pytest.approx(p, abs=1e-9)
    with pytest.raises(ValueError, match="two rows"):
        scoring.score_cells(long_form(spark, x), scales=(1,))


def test_result_frame(spark):
    rows = [("a", float(i), c, (50.0 if 40 <= i < 43 else float(i % 5)) + c) for i in range(100) for c in range(2)] + [("a", 3.0, 0, 5.0)]
    found = scoring.detect(spark.createDataFrame(rows, "series_id string, timestamp double, channel int, value double"))
    frame = found.frame([0, 1])
    assert frame.columns == ["series_id", "row_idx", "timestamp", "ch_0", "ch_1", "score", "anomaly"] and frame.count() == 100
    got = {r["row_idx"]: r for r in frame.collect()}
    assert got[3]["ch_0"] == 4.0 and got[41]["ch_1"] == 51.0 and [i for i, r in sorted(got.items()) if r["anomaly"]] == [40, 41, 42]
