"""Between wide, long, gridded and merged forms of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MILLISECONDS, col, finite, missing, unix_seconds
from . import selection


def row_numbers(df: DataFrame, series: str, *order: str) -> DataFrame:
    """``df`` with ``row_idx`` from 0 within each series; ``order`` must end in a tie-break."""
    return df.withColumn("row_idx", F.row_number().over(Window.partitionBy(series).orderBy(*order)) - 1)


def unix_times(df: DataFrame, t: str = "timestamp", series: str = "series_id") -> DataFrame:
    """``df`` with ``t`` as unix seconds: times and ISO text are parsed; numbers are seconds, or milliseconds in a series
    whose median absolute time is beyond what seconds can be."""
    kind = dict(df.dtypes)[t]
    if kind.startswith(("timestamp", "date")):
        return df.withColumn(t, unix_seconds(t))
    if kind == "string":
        return df.withColumn(t, unix_seconds(F.to_timestamp(t)))
    usual = selection.medians(df, (series,), F.abs(F.col(t)), "usual_")
    unit = F.when(F.col("usual_") > MILLISECONDS, 1000.0).otherwise(1.0)
    return df.join(usual, series, "left").withColumn(t, F.col(t).cast("double") / unit).drop("usual_")


def to_long(wide: DataFrame, ids: list[str], channels: list[str]) -> DataFrame:
    """One row a cell: ``ids``, ``channel`` (position in ``channels``), ``value`` (NaN as null)."""
    values = F.array(*(missing(F.col(c).cast("double")) for c in channels))
    return wide.select(*ids, F.posexplode(values).alias("channel", "value"))


def to_wide(cells: DataFrame, ids: list[str], channels: list[int]) -> DataFrame:
    """One row a time step with ``ch_i`` columns; the channel list is given, so no pass is needed to find it."""
    wide = cells.groupBy(*ids).pivot("channel", channels).agg(F.first("value"))
    return wide.select(*ids, *(F.col(str(c)).alias(f"ch_{c}") for c in channels))


def merge_duplicates(cells: DataFrame) -> DataFrame:
    """Cells of equal ``(series_id, timestamp, channel)`` as one with the mean of the finite values; ``row_idx`` is the
    rank of the timestamp in its series."""
    merged = cells.groupBy("series_id", "timestamp", "channel").agg(F.avg(finite("value")).alias("value"), F.count("*").alias("n_merged"))
    times = merged.select("series_id", "timestamp").distinct()
    ranks = row_numbers(times, "series_id", "timestamp")
    return merged.join(ranks, ["series_id", "timestamp"])


def binned(t: Column | str, width: float) -> Column:
    """Start of the left-closed bin of ``width`` seconds that holds ``t``."""
    return F.floor(col(t) / width) * width


def resample_mean(cells: DataFrame, width: float) -> DataFrame:
    """Mean of each bin: ``series_id, channel, bin, value``; bins without rows are absent."""
    return cells.groupBy("series_id", "channel", binned("timestamp", width).alias("bin")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def grid(bins: DataFrame, width: float, keys: tuple[str, ...] = ("series_id", "channel")) -> DataFrame:
    """Every bin between a group's first and last one. Only two rows of bounds a group are aggregated before the explode."""
    bounds = bins.groupBy(*keys).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    step = F.lit(width)
    places = F.sequence(F.lit(0).cast("long"), F.round((F.col("high") - F.col("low")) / step).cast("long"))
    return bounds.select(*keys, F.explode(F.transform(places, lambda i: F.col("low") + i * step)).alias("bin"))


def gap_fill(bins: DataFrame, width: float, fill: float | None = None, keys: tuple[str, ...] = ("series_id", "channel")) -> DataFrame:
    """``bins`` on the full grid; missing values become ``fill``, or stay null."""
    out = grid(bins, width, keys).join(bins, [*keys, "bin"], "left")
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def block_downsample(cells: DataFrame, factor: int) -> DataFrame:
    """Means of blocks of ``factor`` rows; the rows left at the end go. The label of a block: anomaly if any row is,
    normal if all are, else unknown; its time is that of its first row."""
    whole = cells.groupBy("series_id", "channel").agg((F.floor((F.max("row_idx") + 1) / factor) * factor).alias("whole"))
    kept = cells.join(whole, ["series_id", "channel"]).where("row_idx < whole")
    label = F.when(F.max((F.col("label") == 1).cast("int")) == 1, 1).when(F.min((F.col("label") == 0).cast("int")) == 1, 0).otherwise(-1)
    return kept.groupBy("series_id", "channel", F.floor(F.col("row_idx") / factor).alias("row_idx")).agg(F.min("timestamp").alias("timestamp"), F.avg("value").alias("value"), label.alias("label"))


def asof_align(left: DataFrame, right: DataFrame, series: str, t: str, values: list[str]) -> DataFrame:
    """Each ``left`` row with the last ``right`` values of the series at or before its time.

    Both sides are stacked and sorted once: the last value seen on the right is carried forward. No range join.
    """
    nothing = [F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values]
    a = left.select("*", *nothing, F.lit(1).alias("side"))
    own = [c for c in left.columns if c not in (series, t)]
    b = right.select(series, t, *(F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in own), *values, F.lit(0).alias("side"))
    w = Window.partitionBy(series).orderBy(t, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    return both.select(series, t, *own, *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values), "side").where("side = 1").drop("side")


def interval_label(rows: DataFrame, intervals: DataFrame, at: str, width: float, default: int = 0) -> DataFrame:
    """``rows`` with ``label`` from closed intervals ``series_id, a, b, label``; of several the anomaly wins, then unknown.

    Both sides are cut in bins of ``width`` and joined by equality, the exact bounds checked after, so neither
    side has to fit a broadcast. An interval with a null end is open. Intervals spread over their own bins only.
    """
    last = rows.groupBy("series_id").agg(F.max(at).alias("last"))
    known = intervals.join(last, "series_id").withColumn("b", F.coalesce("b", "last")).where("a <= b")
    bins = F.sequence(F.floor(F.col("a") / width).cast("long"), F.floor(F.least("b", "last") / width).cast("long"))
    spread = known.where("a <= last").select("series_id", "a", "b", F.col("label").alias("hit"), F.explode(bins).alias("bin"))
    keyed = rows.select("series_id", at, F.floor(F.col(at) / width).cast("long").alias("bin")).distinct()
    rank = F.when(F.col("hit") == 1, 2).when(F.col("hit") == -1, 1).otherwise(0)
    hits = keyed.join(spread, ["series_id", "bin"]).where(F.col(at).between(F.col("a"), F.col("b"))).groupBy("series_id", at).agg(F.max(rank).alias("rank"))
    label = F.when(F.col("rank") == 2, 1).when(F.col("rank") == 1, -1).when(F.col("rank") == 0, 0).otherwise(default)
    return rows.join(hits, ["series_id", at], "left").withColumn("label", label).drop("rank")


def interval_channels(rows: DataFrame, intervals: DataFrame, at: str, width: float) -> DataFrame:
    """``rows`` with ``channels``: those that closed intervals ``series_id, a, b, channels`` name at a row's time; empty outside.

    Intervals are cut in bins of ``width`` and their channels exploded, rows' times are cut in bins, and both meet by one equi-join.
    """
    bounds = rows.groupBy("series_id").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    known = intervals.join(bounds, "series_id").select("series_id", F.greatest("a", "low").alias("a"), F.least("b", "high").alias("b"), "channels").where("a <= b")
    bins = F.sequence(F.floor(F.col("a") / width).cast("long"), F.floor(F.col("b") / width).cast("long"))
    spread = known.select("series_id", "a", "b", F.explode("channels").alias("channel"), bins.alias("bins")).withColumn("bin", F.explode("bins")).drop("bins")
    times = rows.select("series_id", at, F.floor(F.col(at) / width).cast("long").alias("bin")).distinct()
    hits = times.join(spread, ["series_id", "bin"]).where(F.col(at).between(F.col("a"), F.col("b")))
    hits = hits.groupBy("series_id", at).agg(F.array_sort(F.collect_set("channel")).alias("channels"))  # bounded by the channels
    empty = F.array().cast(dict(hits.dtypes)["channels"])
    return rows.join(hits, ["series_id", at], "left").withColumn("channels", F.coalesce("channels", empty))


def melt_pivot_last(messages: DataFrame, keys: list[str], bin_: str, name: str, names: list[str], value: str, order: Column) -> DataFrame:
    """The last value of each name in each bin, one column a name."""
    last = messages.groupBy(*keys, bin_).pivot(name, names).agg(F.max_by(value, order))
    return last.select(*keys, bin_, *(F.col(f"`{n}`").alias(n) for n in names))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose key isn't among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)
