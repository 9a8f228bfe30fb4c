"""Label rules of single sources: first rows of faults, status logs, leaks, categorised intervals.

Rows are ``series_id, row_idx, label`` and, where times are needed, ``timestamp``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reshape


def first_positives(rows: DataFrame, keep: int, hopeless: Column) -> DataFrame:
    """The first ``keep`` anomalies of a series stay, the others become unknown; all of them where ``hopeless``."""
    marked = rows.withColumn("hopeless", hopeless)
    place = F.row_number().over(Window.partitionBy("series_id", F.col("label") == 1).orderBy("row_idx"))
    label = F.when((F.col("label") == 1) & (F.col("hopeless") | (place > keep)), -1).otherwise(F.col("label"))
    return marked.withColumn("label", label).drop("hopeless")


def status_labels(rows: DataFrame, log: DataFrame, fault: Column, other: Column, open_for: float = 600.0, width: float = 86400.0) -> DataFrame:
    """Labels from a log of states (``series_id, start, stop``, its own columns): states that are a ``fault`` mark an
    anomaly, ``other`` ones unknown rows; an anomaly wins. The row before a state's start counts; a state without an
    end lasts to ``open_for`` seconds after the series' last row."""
    before = F.lag("timestamp").over(Window.partitionBy("series_id").orderBy("timestamp"))
    times = rows.select("series_id", "timestamp").withColumn("before", before)
    label = F.when(fault, 1).when(other, -1)
    states = log.withColumn("hit", label).where("hit is not null").select("series_id", F.col("start").alias("a"), F.col("stop").alias("b"), F.col("hit").alias("label"))
    last = rows.groupBy("series_id").agg((F.max("timestamp") + open_for).alias("last"))
    states = states.join(last, "series_id").select("series_id", "a", F.coalesce("b", "last").alias("b"), "label")
    inside = reshape.interval_label(times.select("series_id", "timestamp"), states, "timestamp", width)
    # The row before: the last one at or before each start.
    entry = reshape.asof_align(states.select("series_id", F.col("a").alias("t"), "label"), times.select("series_id", F.col("timestamp").alias("t"), F.col("timestamp").alias("at")), "series_id", "t", ["at"])
    rank = F.max(F.when(F.col("label") == 1, 2).otherwise(1)).alias("rank")
    entry = entry.where("at is not null").groupBy("series_id", F.col("at").alias("timestamp")).agg(rank)
    both = inside.join(entry, ["series_id", "timestamp"], "left")
    top = F.greatest(F.when(F.col("label") == 1, 2).when(F.col("label") == -1, 1).otherwise(0), F.coalesce("rank", F.lit(0)))
    final = both.select("series_id", "timestamp", F.when(top == 2, 1).when(top == 1, -1).otherwise(0).alias("label")).distinct()
    return rows.drop("label").join(final, ["series_id", "timestamp"])


def leak_labels(flows: DataFrame, onset: int = 864, margin: int = 288, least: float = 3.0) -> DataFrame:
    """Row labels from leak flows (``leak, row_idx, flow``): a leak's first ``onset`` rows are anomalous, or unknown if it
    never reaches ``least``; the rows around its repair are unknown; a leak from the first row on has no onset. An
    anomaly wins."""
    span = flows.groupBy("leak").agg(F.min(F.when(F.col("flow") > 0, F.col("row_idx"))).alias("first"), F.max(F.when(F.col("flow") > 0, F.col("row_idx"))).alias("last"), F.max("flow").alias("top"), F.max("row_idx").alias("end"))
    leaks = span.where("first is not null")
    begin = leaks.where("first > 0").select(F.col("first").alias("a"), F.least(F.col("first") + onset - 1, F.col("last")).alias("b"), F.when(F.col("top") >= least, 1).otherwise(-1).alias("label"))
    repair = leaks.where("last < end").select(F.greatest(F.col("last") + 1 - margin, F.lit(0)).alias("a"), (F.col("last") + margin).alias("b"), F.lit(-1).alias("label"))
    table = begin.unionByName(repair).select(F.lit(0).alias("series_id"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), "label")
    rows = flows.select(F.lit(0).alias("series_id"), F.col("row_idx").cast("double").alias("row")).distinct()
    return reshape.interval_label(rows, table, "row", 1000.0).select(F.col("row").cast("long").alias("row_idx"), "label")


def categorised(intervals: DataFrame, kinds: DataFrame, key: str, category: str, anomaly: str) -> DataFrame:
    """Intervals with a label by their event's category: ``anomaly`` is one, all others unknown."""
    return intervals.join(kinds.select(key, F.col(category).alias("category")), key, "left").withColumn("label", F.when(F.col("category") == anomaly, 1).otherwise(-1)).drop("category")


def after(rows: DataFrame, first: Column) -> DataFrame:
    """Rows from ``first`` on anomalous; unknown where it is null."""
    return rows.withColumn("label", F.when(first.isNull(), -1).when(F.col("row_idx") >= first, 1).otherwise(0))


def half_known(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """The first ``share`` of each series' rows, rounded down, made unknown: what a model may have been fitted on. The share counts
    as the fraction that is meant, in whole numbers: 0.7 of 90 rows are 63, in doubles 62."""
    part = Fraction(share).limit_denominator(1_000_000)
    n = F.count("*").over(Window.partitionBy("series_id"))
    inside = (F.col("row_idx") + 1) * part.denominator <= n * part.numerator
    return rows.withColumn("label", F.when(inside, -1).otherwise(F.col("label")))
