"""Cell scorers, window scoring with a frozen reference, and the detection pipeline.

A scorer maps cells to cells with a probability ``p``; any callable of that form can take its place, a trained
network behind ``mapInPandas`` as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import calibrate, combine_scales, finite, robust_probability, sensitivity
from ..schema import MAX_T, MIN_T
from ..storage import written
from . import reshape, selection, series, windows
from .events import decide, detected

#: From cells, and rows known to be calm where there are some, to cells with ``p``.
Scorer = Callable[..., DataFrame]


def robust_scorer(cells: DataFrame) -> DataFrame:
    """Robust z-scores of the whole channel as probabilities."""
    filled = written(series.fill(cells).drop("value").withColumnRenamed("filled", "value"), "filled")
    return series.robust_normalize(selection.dealt(filled, series.KEYS)).withColumn("p", robust_probability("z"))


def nearest(x: np.ndarray, m: int, exclude: int) -> np.ndarray:
    """Z-normalised distance of each ``m``-row stretch to its nearest one further than ``exclude`` rows away."""
    best = nearest_squared(x, m, range(exclude + 1, len(x) - m + 1))
    return np.sqrt(np.where(np.isfinite(best), best, 0.0))


def nearest_squared(x: np.ndarray, m: int, offsets: range) -> np.ndarray:
    """The square of that distance among stretches that are one of ``offsets`` rows away; infinite where there is none.

    Dot products of all stretches at one offset are a running sum of products, so the work is one vector pass an offset.
    """
    n = len(x) - m + 1
    mean = np.convolve(x, np.ones(m) / m, "valid")
    deviation = np.sqrt(np.maximum(np.convolve(x * x, np.ones(m) / m, "valid") - mean * mean, 0))
    flat = deviation < 1e-9
    best = np.full(n, np.inf)
    for offset in offsets:
        products = np.cumsum(x[: len(x) - offset] * x[offset:])
        dots = products[m - 1 :] - np.concatenate([[0.0], products[:-m]])
        a, b = slice(0, n - offset), slice(offset, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (dots / m - mean[a] * mean[b]) / (deviation[a] * deviation[b])
        d = 2 * m * (1 - np.clip(r, -1, 1))
        d = np.where(flat[a] & flat[b], 0.0, np.where(flat[a] | flat[b], float(m), d))
        best[a] = np.minimum(best[a], d)
        best[b] = np.minimum(best[b], d)
    return best


def matrix_profile(cells: DataFrame, most_rows: int = 40_000, channels: int = 8, block: int = 256) -> DataFrame:
    """``series_id, row_idx, score``: the nearest-neighbour baseline.

    Stretches of ``min(64, max(8, n // 20))`` rows; the profile of the (at most ``channels``) most variable channels is
    averaged, put at stretch centres, its ends extended, and smoothed. Rows from ``most_rows`` on (the baseline's own
    limit) have no score (null). The work is quadratic in them: a task takes ``block`` offsets of one channel, and the least
    distance of each stretch is taken over all blocks.
    """
    kind = dict(cells.dtypes)["series_id"]

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="row_idx", columns="channel", values="value").sort_index()
        x = wide.ffill().bfill().fillna(0.0).to_numpy(float)
        n = len(x)
        m = min(64, max(8, n // 20))
        top = np.argsort(-x.std(0), kind="stable")[:channels]
        rows = [(frame["series_id"].iloc[0], k, m, wide.index.to_numpy(), x[:, c]) for k, c in enumerate(top)]
        return pd.DataFrame(rows, columns=["series_id", "rank", "m", "index", "x"])

    def distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for series_id, rank, m, x, first in frame[["series_id", "rank", "m", "x", "first"]].itertuples(index=False, name=None):
                x = np.asarray(x, float)
                best = nearest_squared(x, m, range(first, min(first + block, len(x) - m + 1)))
                yield pd.DataFrame({"series_id": series_id, "rank": rank, "place": np.arange(len(best)), "d": best})

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        index, m = np.asarray(frame["index"].iloc[0]), int(frame["m"].iloc[0])
        n, total = len(index), np.zeros(len(index))
        if n >= 2 * m:
            rows = []
            for found in frame.sort_values("rank")["found"]:
                best = np.full(n - m + 1, np.inf)
                for f in found if found is not None else ():
                    best[f["place"]] = f["d"]
                rows.append(np.sqrt(np.where(np.isfinite(best), best, 0.0)))
            profile = np.mean(rows, axis=0)
            total = np.pad(profile, (m // 2, n - len(profile) - m // 2), mode="edge")
            total = pd.Series(total).rolling(m, center=True, min_periods=1).mean().to_numpy()
        return pd.DataFrame({"series_id": frame["series_id"].iloc[0], "row_idx": index, "score": total})

    rows = cells.where(F.col("row_idx") < most_rows).select("series_id", "row_idx", "channel", "value")
    picked = rows.groupBy("series_id").applyInPandas(chosen, f"series_id {kind}, rank int, m int, index array<long>, x array<double>")
    last, exclude = F.size("x") - F.col("m"), F.ceil(F.col("m") / 4).cast("int")
    blocks = picked.where((F.size("x") >= 2 * F.col("m")) & (last > exclude)).withColumn("first", F.explode(F.sequence(exclude + 1, last, F.lit(block))))
    parts = blocks.drop("index").repartition("series_id", "rank", "first").mapInPandas(distances, f"series_id {kind}, rank int, place int, d double")
    least = parts.groupBy("series_id", "rank", "place").agg(F.min("d").alias("d"))
    # A channel's stretches: at most ``most_rows``.
    least = least.groupBy("series_id", "rank").agg(F.collect_list(F.struct("place", "d")).alias("found"))
    made = picked.select("series_id", "rank", "m", "index").join(least, ["series_id", "rank"], "left")
    scores = made.groupBy("series_id").applyInPandas(score, f"series_id {kind}, row_idx long, score double")
    beyond = cells.where(F.col("row_idx") >= most_rows).select("series_id", F.col("row_idx").cast("long").alias("row_idx")).distinct()
    return scores.unionByName(beyond.withColumn("score", F.lit(None).cast("double")))


def fold_windows(x: np.ndarray, size: int, stride: int, threshold: float, t: np.ndarray | None = None, scorer: windows.Predict = windows.robust_z, how: str = "topk", k: int = 3) -> np.ndarray:
    """Cell probabilities of one series: windows in order, each scored against the last one that ended calm.

    A window whose last quarter's row scores (``how``, ``k``) stay below ``threshold`` becomes the reference of those after it;
    else the reference stays as it is. Each window is filled by itself. Windows are blended by triangle weights.
    """
    n = len(x)
    t = np.arange(n, dtype=float) if t is None else t
    starts = [0] if n <= size else [*range(0, n - size + 1, stride)]
    if starts[-1] + size < n:
        starts.append(n - size)
    total, weight = np.zeros(x.shape), np.zeros((n, 1))
    reference = None
    for s in starts:
        part = windows.filled(x[s : s + size])
        z = windows.scaled_by(part, part if reference is None else reference)
        p = np.asarray(scorer(windows.batch_of([(z, t[s : s + size])]))[0], float)
        w = windows.weights(len(part))[:, None]
        total[s : s + size] += p * w
        weight[s : s + size] += w
        if row_scores(p[len(part) * 3 // 4 :], how, k).max() < threshold:
            reference = part
    return total / np.maximum(weight, 1e-8)


def row_scores(p: np.ndarray, how: str = "topk", k: int = 3) -> np.ndarray:
    """One score a row of cell probabilities, as ``columns.row_score`` has it."""
    if p.shape[1] == 1 or how == "max":
        return p.max(1)
    top = np.sort(p, 1)[:, ::-1][:, :k]
    if how == "topk":
        return top.mean(1)
    if how == "noisy_or":
        return 1 - np.prod(1 - np.minimum(top, 1 - 1e-6), axis=1)
    raise ValueError(f"unknown aggregation {how!r}")


def frozen_reference(cells: DataFrame, size: int = MAX_T, stride: int | None = None, threshold: float = 0.5, group: int = windows.GROUP, scorer: windows.Predict = windows.robust_z, how: str = "topk", k: int = 3) -> DataFrame:
    """``series_id, row_idx, channel, p`` with each window scored against a reference that anomalies don't enter.

    Sequential by definition: a task's unit is a series' block of ``group`` channels, all its rows.
    """
    step = stride or size // 2
    kind = dict(cells.dtypes)["series_id"]
    timed = "timestamp" in cells.columns

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="row_idx", columns="channel", values="value").sort_index()
        t = frame.groupby("row_idx")["timestamp"].first().to_numpy(float) if timed else None
        p = fold_windows(wide.to_numpy(float), size, step, threshold, t, scorer, how, k)
        return pd.DataFrame({"series_id": frame["series_id"].iloc[0], "row_idx": np.repeat(wide.index.to_numpy(), p.shape[1]), "channel": np.tile(wide.columns.to_numpy(), len(p)), "p": p.ravel()})

    cut = cells.select("series_id", "row_idx", "channel", "value", *(["timestamp"] if timed else [])).withColumn("block", F.floor(F.col("channel") / group))
    return cut.groupBy("series_id", "block").applyInPandas(folded, f"series_id {kind}, row_idx long, channel int, p double")


def reference_scales(cells: DataFrame, normal: DataFrame) -> DataFrame:
    """``series_id, channel, centre, scale`` of rows known to be calm, which need ``MIN_T`` rows, the channels of their series and
    finite values: anything else is an error, found at once."""
    rows = normal.groupBy("series_id").agg(F.count_distinct("row_idx").alias("n"), F.count_if(finite("value").isNull()).alias("odd"))
    pair = ["series_id", "channel"]
    have = normal.groupBy(*pair).agg(F.count("*").alias("m"))
    need = cells.join(rows.select("series_id"), "series_id", "left_semi").select(*pair).distinct().withColumn("needed", F.lit(1))
    gaps = need.join(have, pair, "full").join(rows, "series_id", "left")
    bad = gaps.where((F.col("n") < MIN_T) | (F.col("odd") > 0) | F.col("needed").isNull() | F.coalesce(F.col("m") < F.col("n"), F.lit(True)))
    present = cells.select("series_id").distinct()
    if not bad.join(present, "series_id", "left_semi").isEmpty():
        raise ValueError(f"a normal reference needs {MIN_T} rows, the series' channels and finite values")
    return series.centre_and_scale(normal, ("series_id", "channel"))


def windowed_scorer(size: int = MAX_T, stride: int | None = None, threshold: float = 0.5, scorer: windows.Predict | None = None, how: str = "topk", k: int = 3, batch_bytes: int = windows.BATCH_BYTES) -> Scorer:
    """Scores in windows of ``size`` rows by ``scorer`` (robust z without one): series with ``normal`` rows against these, else those of
    more than ``size`` rows against their last calm window and shorter ones, a single window, against themselves."""
    step, names = stride or size // 2, ("series_id", "row_idx", "channel", "p")

    def single(cells: DataFrame) -> DataFrame:
        if scorer is not None:
            return windows.window_scores(cells, size, step, scorer, batch_bytes=batch_bytes)
        return robust_scorer(cells).select("series_id", "row_idx", F.col("channel").cast("int").alias("channel"), "p")

    def scored(cells: DataFrame, normal: DataFrame | None = None) -> DataFrame:
        parts = []
        if normal is not None:
            given = normal.select("series_id").distinct()
            known = cells.join(given, "series_id", "left_semi")
            parts.append(windows.window_scores(known, size, step, scorer or windows.robust_z, reference_scales(known, normal), batch_bytes=batch_bytes))
            cells = cells.join(given, "series_id", "left_anti")
        longer = cells.groupBy("series_id").agg(F.max("row_idx").alias("m")).where(F.col("m") + 1 > size).select("series_id")
        longer = written(longer, "long-series")
        if longer.isEmpty():
            parts.append(single(cells))
        else:
            parts.append(single(cells.join(longer, "series_id", "left_anti")))
            parts.append(frozen_reference(cells.join(longer, "series_id", "left_semi"), size, step, threshold, scorer=scorer or windows.robust_z, how=how, k=k))
        return reduce(DataFrame.unionByName, (p.select(*names) for p in parts))

    return scored


def coarse_scores(cells: DataFrame, scorer: Scorer, factor: int, max_t: int = MAX_T, normal: DataFrame | None = None) -> DataFrame:
    """``series_id, channel, block, last, p``: scores of block means of ``factor`` rows, for series of more than ``max_t`` rows that have at
    least ``MIN_T`` blocks, and ``last``, the last block. ``normal`` rows are averaged likewise; series whose
    reference is then shorter than ``MIN_T`` are left out."""
    if factor < 2:
        raise ValueError("a scale averages two rows at least")
    sizes = cells.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n"))
    chosen = sizes.where((F.col("n") > max_t) & (F.floor(F.col("n") / factor) >= MIN_T)).select("series_id")
    blocks = reshape.block_downsample(cells.join(chosen, "series_id", "left_semi"), factor)
    if normal is not None:
        place = (F.dense_rank().over(Window.partitionBy("series_id").orderBy("row_idx")) - 1).alias("row_idx")
        calm = normal.select("series_id", place, "channel", "value", F.lit(0.0).alias("timestamp"), F.lit(0).alias("label"))
        short = calm.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n")).where(F.floor(F.col("n") / factor) < MIN_T).select("series_id")
        blocks = blocks.join(short, "series_id", "left_anti")
        normal = reshape.block_downsample(calm.join(short, "series_id", "left_anti"), factor)
    blocks = written(blocks, "blocks")
    p = (scorer(blocks) if normal is None else scorer(blocks, normal)).select("series_id", "channel", F.col("row_idx").alias("block"), "p")
    last = blocks.groupBy("series_id", "channel").agg(F.max("row_idx").alias("last"))
    return p.join(last, ["series_id", "channel"])


def score_cells(cells: DataFrame, scorer: Scorer = robust_scorer, scales: tuple[int, ...] = (), how: str = "mean", max_t: int = MAX_T, normal: DataFrame | None = None) -> DataFrame:
    """Cell probabilities, over coarser scales as well for series of more than ``max_t`` rows.

    A coarse score is repeated over its block's rows; rows after the last whole block get the last block's. A cell finds its
    block by arithmetic: a row of the coarse scores is spread over its block's cells before they meet.
    """
    out = (scorer(cells) if normal is None else scorer(cells, normal)).select("series_id", "row_idx", "channel", "p")
    names = []
    for factor in scales:
        coarse = coarse_scores(cells, scorer, factor, max_t, normal)
        # The last block also covers the rows after it, fewer than a block.
        spread = F.sequence(F.lit(0), F.when(F.col("block") == F.col("last"), 2 * factor - 2).otherwise(factor - 1))
        fine = coarse.select("series_id", "channel", F.col("p").alias(f"p{factor}"), "block", F.explode(spread).alias("place"))
        fine = fine.select("series_id", "channel", (F.col("block") * factor + F.col("place")).alias("row_idx"), f"p{factor}")
        out = out.join(fine, ["series_id", "channel", "row_idx"], "left")
        names.append(f"p{factor}")
    return out.withColumn("p", combine_scales("p", names, how)).drop(*names) if names else out


@dataclass
class Detection:
    """What ``detect`` finds; also unpacks into ``rows, events``."""

    rows: DataFrame
    events: DataFrame
    values: DataFrame

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.rows, self.events))

    def frame(self, channels: list[int]) -> DataFrame:
        """The result by row: ``series_id, row_idx, timestamp``, the merged values ``ch_i``, ``score`` and ``anomaly``."""
        values = selection.dealt(self.values, ("series_id", "row_idx"), fine=True)
        wide = reshape.to_wide(values, ["series_id", "row_idx", "timestamp"], channels)
        return wide.join(self.rows.select("series_id", "row_idx", "score", "anomaly"), ["series_id", "row_idx"])


def detect(
    cells: DataFrame, scorer: Scorer | None = None, threshold: float = 0.5, level: str = "medium", how: str = "topk", k: int = 3, temperature: float = 1.0, bias: float = 0.0,
    scales: tuple[int, ...] = (), combine: str = "mean", normal: DataFrame | None = None, max_t: int = MAX_T, use_types: bool = False, predict_windows: windows.Predict | None = None,
    times: str = "seconds",
) -> Detection:
    """Rows with ``score, anomaly``, the events, and the merged values. ``cells``: ``series_id, timestamp, channel, value``.

    ``times``: ``seconds`` for unix seconds, ``guess`` for anything that ``reshape.unix_times`` reads. Equal timestamps are merged first. Series are scored in windows of ``max_t`` rows (``windowed_scorer``, by
    ``predict_windows`` if given, against ``normal`` if given) or by ``scorer``, over coarser ``scales`` as well. Series of fewer than ``MIN_T``
    rows are filled and scored by robust z alone, without calibration. Rows and, for an event's channels, cells are calibrated before
    they are compared with the threshold of ``level``. Events have a type only with ``use_types``. Merged cells and scores are written
    to the shared folder, as they are used again.
    """
    scorer = scorer or windowed_scorer(max_t, scorer=predict_windows, how=how, k=k)
    if times not in ("seconds", "guess"):
        raise ValueError(f"unknown times {times!r}")
    cells = cells if times == "seconds" else reshape.unix_times(cells)
    merged = reshape.merge_duplicates(cells).withColumn("label", F.lit(0))
    merged = written(_with_size(selection.dealt(written(merged, "merged"), ("series_id",))), "sized")
    enough = selection.dealt(merged, series.KEYS).where("long_").drop("long_")
    scored = score_cells(enough, scorer, scales, combine, max_t, normal).withColumn("short_", F.lit(False))
    brief = written(merged.where("not long_").drop("long_"), "short-series")
    if not brief.isEmpty():
        filled = series.fill(brief).drop("value").withColumnRenamed("filled", "value")
        short = series.robust_normalize(filled).withColumn("p", robust_probability("z"))
        scored = scored.unionByName(short.select("series_id", "row_idx", "channel", F.coalesce("p", F.lit(0.0)).alias("p"), F.lit(True).alias("short_")))
    scored = written(scored, "scores")
    limit = sensitivity(threshold, level)
    rows = decide(selection.dealt(scored, ("series_id", "row_idx"), fine=True), threshold, level, how, k, temperature, bias, plain="short_")
    kind = F.when(F.col("short_") & (F.col("p") > limit), 1).otherwise(0) if use_types else F.lit(0)
    p = scored.select("series_id", "row_idx", "channel", kind.alias("type"), F.when(F.col("short_"), F.col("p")).otherwise(calibrate("p", temperature, bias)).alias("p"))
    values = merged.select("series_id", "row_idx", "channel", "timestamp", "value")
    return Detection(rows, detected(p.join(values.drop("value"), ["series_id", "row_idx", "channel"]), rows, limit), values)


def _with_size(merged: DataFrame) -> DataFrame:
    """``merged`` with ``long_``, whether its series has ``MIN_T`` rows."""
    size = merged.groupBy("series_id").agg((F.max("row_idx") + 1 >= MIN_T).alias("long_"))
    return merged.join(size, "series_id")


def predict(cells: DataFrame, **options) -> DataFrame:
    """``series_id, timestamp, anomaly`` of each input row, equal timestamps sharing theirs."""
    found = detect(cells, **options)
    ranks = found.values.select("series_id", "timestamp", "row_idx").distinct()
    flags = found.rows.join(ranks, ["series_id", "row_idx"]).select("series_id", "timestamp", "anomaly")
    return cells.select("series_id", "timestamp").join(flags, ["series_id", "timestamp"], "left").withColumn("anomaly", F.coalesce("anomaly", F.lit(0)))


def matrix_scorer(cells: DataFrame) -> DataFrame:
    """The nearest-neighbour baseline as a scorer: a row's share of the series' largest score, for all its channels."""
    score = matrix_profile(cells)
    most = score.groupBy("series_id").agg(F.max("score").alias("most"))
    p = score.join(most, "series_id").select("series_id", "row_idx", F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0).alias("p"))
    return cells.join(p, ["series_id", "row_idx"])


def learned_scorer(predict_windows: windows.Predict, size: int = MAX_T, stride: int | None = None, batch_bytes: int = windows.BATCH_BYTES) -> Scorer:
    """A scorer around a function from a batch of whole windows to their cells' probabilities."""
    return windowed_scorer(size, stride, scorer=predict_windows, batch_bytes=batch_bytes)
