"""Order-dependent features and scales of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, robust_probability, triangle
from ..storage import written
from . import scans, selection

KEYS = ("series_id", "channel")


def _ordered(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("row_idx")


def delta_t(rows: DataFrame, series: str = "series_id", t: str = "timestamp") -> DataFrame:
    """``rows`` with ``delta_t``: log of one plus the step to the row before over the series' median step; 0 at first.

    Series that fit a task take two windows of one partitioning; longer ones are scanned in blocks.
    """
    if selection.hot_keys(rows, (series,)) is None:
        step = rows.withColumn("step", F.col(t) - F.lag(t).over(Window.partitionBy(series).orderBy("row_idx")))
        stepped = step.withColumn("usual", F.median("step").over(Window.partitionBy(series)))
    else:
        step = scans.previous(rows, [t], (series,)).withColumn("step", F.col(t) - F.col(f"previous_{t}")).drop(f"previous_{t}")
        step = written(step, "steps")
        stepped = step.join(selection.medians(step, (series,), "step", "usual"), series, "left")
    share = F.col("step") / F.greatest("usual", F.lit(1e-12))
    return stepped.withColumn("delta_t", F.coalesce(F.log1p(share), F.lit(0.0))).drop("step", "usual")


def fill(cells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``cells`` with ``filled``: the last value seen; before the first one the median of the forward-filled
    channel; 0 where all are missing. Channels that fit a task take windows; longer ones are scanned in blocks."""
    if selection.hot_keys(cells, keys) is None:
        known = F.last("value", ignorenulls=True).over(_ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
        forward = cells.withColumn("forward", known).withColumn("typical", F.median("forward").over(Window.partitionBy(*keys)))
    else:
        forward = written(scans.last_known(cells, "value", keys, "forward"), "forward")
        forward = forward.join(selection.medians(forward, keys, "forward", "typical"), list(keys), "left")
    return forward.withColumn("filled", F.coalesce("forward", "typical", F.lit(0.0))).drop("forward", "typical")


def centre_and_scale(cells: DataFrame, keys: tuple[str, ...] = KEYS, reference: Column | None = None) -> DataFrame:
    """``keys, centre, scale``: median, and 1.4826 times the median absolute deviation; where that vanishes the
    standard deviation, where that vanishes 1. Only ``reference`` rows count, if given.

    Two aggregations with a join between them. The medians of channels too long for a task are selected by rank.
    """
    known = cells if reference is None else cells.where(reference)
    return _scales(known, keys, selection.hot_keys(known, keys) is not None)


def _scale() -> Column:
    mad = F.col("mad") * 1.4826
    return F.when(mad > 1e-8, mad).when(F.col("deviation") > 1e-8, F.col("deviation")).otherwise(1.0)


def _scales(known: DataFrame, keys: tuple[str, ...], hot: bool) -> DataFrame:
    away = F.abs(F.col("value") - F.col("centre"))
    if not hot:
        centre = known.groupBy(*keys).agg(F.median("value").alias("centre"), F.stddev_pop("value").alias("deviation"))
        spread = known.join(centre, list(keys)).groupBy(*keys).agg(F.first("centre").alias("centre"), F.first("deviation").alias("deviation"), F.median(away).alias("mad"))
    else:
        known = written(known.select(*keys, "value"), "values")
        centre = written(selection.medians(known, keys, "value", "centre"), "centres")
        mad = selection.medians(known.join(centre, list(keys)), keys, away, "mad")
        deviation = known.groupBy(*keys).agg(F.stddev_pop("value").alias("deviation"))
        spread = deviation.join(centre, list(keys), "left").join(mad, list(keys), "left")
    return spread.select(*keys, "centre", _scale().alias("scale"))


def robust_normalize(cells: DataFrame, keys: tuple[str, ...] = KEYS, reference: Column | None = None, limit: float = 50.0) -> DataFrame:
    """``cells`` with ``z``, the robustly scaled value within ``limit``.

    Channels that fit a task, without a reference, take windows of one sort; else the scales are aggregated and joined.
    """
    z = clip((F.col("value") - F.col("centre")) / F.col("scale"), -limit, limit)
    if reference is not None:
        return cells.join(centre_and_scale(cells, keys, reference), list(keys)).withColumn("z", z).drop("centre", "scale")
    if selection.hot_keys(cells, keys) is not None:
        return cells.join(_scales(cells, keys, True), list(keys)).withColumn("z", z).drop("centre", "scale")
    own = Window.partitionBy(*keys)
    centred = cells.withColumns({"centre": F.median("value").over(own), "deviation": F.stddev_pop("value").over(own)})
    spread = centred.withColumn("mad", F.median(F.abs(F.col("value") - F.col("centre"))).over(own)).withColumn("scale", _scale())
    return spread.withColumn("z", z).drop("centre", "deviation", "mad", "scale")


def difference(cells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``cells`` with ``diff``, the step from the row before; 0 at first."""
    stepped = scans.previous(cells, ["value"], keys)
    return stepped.withColumn("diff", F.coalesce(F.col("value") - F.col("previous_value"), F.lit(0.0))).drop("previous_value")


def local_deviation(cells: DataFrame, n: int, name: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``cells`` with ``name``: value less the mean of ``n`` rows around it (``n / 2`` before to ``n / 2 - 1`` after)."""
    around = _ordered(keys).rowsBetween(-(n // 2), n // 2 - 1)
    return cells.withColumn(name, F.col("value") - F.avg("value").over(around))


def window_starts(length: Column, size: int, stride: int) -> Column:
    """Starts of windows: every ``stride`` rows, and one that ends with the series if its end isn't covered."""
    regular = F.when(length > size, F.sequence(F.lit(0).cast("long"), (length - size).cast("long"), F.lit(stride).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    tail = F.when((length > size) & ((length - size) % stride != 0), F.array((length - size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(regular, tail)


def in_windows(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """``rows`` once for each sliding window that holds them, with ``start``, ``length`` and ``place``.

    A row finds its windows by arithmetic on its own index; nothing is joined but the series' lengths.
    """
    lengths = rows.groupBy("series_id").agg((F.max("row_idx") + 1).alias("series_rows"))
    each = rows.join(lengths, "series_id")
    i, n = F.col("row_idx"), F.col("series_rows")
    first = F.greatest(F.lit(0), F.ceil((i - size + 1) / stride)).cast("long")
    last = F.least(F.floor(i / stride), F.floor(F.greatest(n - size, F.lit(0)) / stride)).cast("long")
    regular = F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
    tail = F.when((n > size) & ((n - size) % stride != 0) & (i >= n - size), F.array((n - size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = each.withColumn("start", F.explode(F.concat(regular, tail)))
    return out.withColumn("length", F.least(F.lit(size), n)).withColumn("place", i - F.col("start")).drop("series_rows")


def blend(scores: DataFrame, keys: tuple[str, ...] = ("series_id", "row_idx")) -> DataFrame:
    """One score a row from those of its windows, weighted by a triangle over each window."""
    weight = triangle(F.col("place"), F.col("length"))
    return scores.withColumn("weight", weight).groupBy(*keys).agg((F.sum(F.col("score") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-8))).alias("score"), F.count("*").alias("n_windows"))


def short_scores(cells: DataFrame, least: int) -> DataFrame:
    """Cell probabilities ``p`` by robust z-scores of the series with fewer than ``least`` rows, which are written and dealt anew."""
    short = cells.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n")).where(F.col("n") < least).select("series_id")
    brief = selection.dealt(written(cells.join(short, "series_id", "left_semi"), "short-series"), ("series_id",))
    return robust_normalize(brief).withColumn("p", robust_probability("z"))


def snapshot(cells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Root mean square, peak and (not excess) kurtosis of each group, from power sums in one pass."""
    x = F.col("value")
    sums = cells.groupBy(*keys).agg(F.avg(x).alias("m1"), F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"), F.avg(x * x * x * x).alias("m4"), F.max(F.abs(x)).alias("peak"))
    m1, m2, m3, m4 = (F.col(f"m{k}") for k in (1, 2, 3, 4))
    variance = m2 - m1 * m1
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return sums.select(*keys, F.sqrt(m2).alias("rms"), "peak", (fourth / (variance * variance + 1e-12)).alias("kurtosis"))


def volatility(cells: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, volatility``: sample deviation over the median absolute value."""
    return cells.groupBy(*keys).agg((F.stddev_samp("value") / (F.median(F.abs("value")) + 1e-9)).alias("volatility"))


def correlations(cells: DataFrame, block: int = 4_096) -> DataFrame:
    """``series_id, channel, partner, r, n``: correlation of each two channels of a series, ``channel < partner``, over the ``n`` rows
    that both have values in; null where one doesn't vary.

    A task takes ``block`` rows of a series as a matrix and adds up outer products of its rows, one matrix product for each moment;
    a block then has one row a pair of channels. Values are taken from the channel's mean, so that sums don't cancel.
    """
    kind = dict(cells.dtypes)["series_id"]

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="row_idx", columns="channel", values="x")
        x = wide.to_numpy(float)
        known = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        a, b = np.triu_indices(x.shape[1], 1)
        channels = wide.columns.to_numpy()
        n, sx, sxx, sxy = known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x
        return pd.DataFrame({"series_id": frame["series_id"].iloc[0], "channel": channels[a], "partner": channels[b], "n": n[a, b], "sx": sx[a, b], "sy": sx[b, a], "sxx": sxx[a, b], "syy": sxx[b, a], "sxy": sxy[a, b]})

    known = cells.select("series_id", "row_idx", F.col("channel").cast("int").alias("channel"), F.col("value").cast("double").alias("value")).where("value is not null")
    means = known.groupBy("series_id", "channel").agg(F.avg("value").alias("mean"))
    moved = known.join(means, ["series_id", "channel"]).select("series_id", "row_idx", "channel", (F.col("value") - F.col("mean")).alias("x"), F.floor(F.col("row_idx") / block).alias("block"))
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = moved.groupBy("series_id", "block").applyInPandas(products, f"series_id {kind}, channel int, partner int, " + ", ".join(f"{c} double" for c in sums))
    total = parts.groupBy("series_id", "channel", "partner").agg(*(F.sum(c).alias(c) for c in sums))
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    r = F.when((vx > 0) & (vy > 0), F.expr("n * sxy - sx * sy") / F.sqrt(vx) / F.sqrt(vy))
    return total.select("series_id", "channel", "partner", clip(r, -1.0, 1.0).alias("r"), F.col("n").cast("long").alias("n"))


def correlated_partner(cells: DataFrame, least: float = 0.5) -> DataFrame:
    """For each channel the other one of its series with the largest absolute correlation of at least ``least``;
    the lowest channel of equals."""
    half = correlations(cells)
    other = half.select("series_id", F.col("partner").alias("channel"), F.col("channel").alias("partner"), "r")
    strong = half.select("series_id", "channel", "partner", "r").unionByName(other).where(F.abs("r") >= least)
    best = F.max_by(F.struct("partner", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("partner")))
    return strong.groupBy("series_id", "channel").agg(best.alias("best")).select("series_id", "channel", "best.partner", "best.r")
