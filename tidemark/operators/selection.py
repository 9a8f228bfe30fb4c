"""Exact quantiles, by rank selection for keys of many rows.

``median`` and ``percentile`` bring all distinct values of a key to one task. That is the cheapest way for keys of at most
``HOT_ROWS`` rows. The values of hotter keys are counted by key and value, which
spreads a key over all tasks, and ranks are narrowed down: bins of a fixed logarithmic scale are counted and the
one with the wanted rank found, then ``PARTS`` equal parts of that bin's range, and only the values in the part are
put in order. What a task sees of one key is the bins (some dozens for every doubling of the values' size), the parts, or the
values of one part. Results equal those of ``percentile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..storage import written

#: Rows of a key that one task may hold.
HOT_ROWS = 250_000
#: Bins of the logarithmic scale for each doubling, and parts of a bin.
BINS, PARTS = 32, 1024
#: Rows that a task takes of a table whose keys are cold.
TASK_ROWS = 100_000


def _log_bin(x: Column) -> Column:
    """Number of the bin that holds ``x``: never falls as ``x`` rises."""
    size = F.floor((F.log2(F.abs(x)) + 1100) * BINS).cast("long")
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _part(x: Column, low: Column, high: Column) -> Column:
    """Number of the equal part of the range that holds ``x``: never falls as ``x`` rises."""
    return F.when(high > low, F.least(F.floor((x - low) / (high - low) * PARTS).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.lit(0).cast("long"))


def hot_keys(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame | None:
    """The keys of more than ``HOT_ROWS`` rows; none if there are none. Counts the rows at once."""
    hot = written(cells.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).select(*keys), "hot-keys")
    return None if hot.isEmpty() else hot


def dealt(rows: DataFrame, keys: tuple[str, ...], fine: bool = False) -> DataFrame:
    """``rows``, of files, dealt by ``keys`` to as many tasks as leave each about ``TASK_ROWS`` of them.

    Adaptive execution joins partitions until there are as few as cores, whatever a row costs in the sorts of a stage; a given
    number stays. Windows, joins and groupings on ``keys`` then take place where the rows are. Small tables and such with hot keys
    are left to it; ``fine`` keys, of a row a channel, are never hot.
    """
    spark = rows.sparkSession
    n = -(-rows.count() // TASK_ROWS)  # from the files' footers
    few = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if n <= few or not fine and hot_keys(rows, keys) is not None:
        return rows
    return rows.repartition(n, *keys)


def quantiles(cells: DataFrame, keys: tuple[str, ...], value: Column | str, probabilities: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``probabilities``, ``name: p``: the exact quantile with linear interpolation. Null and
    NaN are left out; a key without values is absent."""
    hot = hot_keys(cells, keys)
    if hot is None:
        return by_percentile(cells, keys, value, probabilities)
    cold = by_percentile(cells.join(hot, list(keys), "left_anti"), keys, value, probabilities)
    return cold.unionByName(selected(cells.join(hot, list(keys), "left_semi"), keys, value, probabilities))


def by_percentile(cells: DataFrame, keys: tuple[str, ...], value: Column | str, probabilities: dict[str, float]) -> DataFrame:
    """The quantiles of keys whose values fit a task."""
    values = cells.select(*keys, col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    return values.groupBy(*keys).agg(*(F.percentile("x", p).alias(n) for n, p in probabilities.items()))


def selected(cells: DataFrame, keys: tuple[str, ...], value: Column | str, probabilities: dict[str, float]) -> DataFrame:
    """The quantiles by rank selection. The values' counts are written, as they are read three times."""
    keys = list(keys)
    counts = cells.select(*keys, col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counts = written(counts.groupBy(*keys, (F.col("x") + 0.0).alias("x")).agg(F.count("*").alias("k")), "values")  # 0.0: one zero
    counts = counts.withColumn("bin", _log_bin(F.col("x")))

    spots = [(p * (F.col("n") - 1)) for p in probabilities.values()]
    ranks = F.array_distinct(F.array(*(f(s).cast("long") for s in spots for f in (F.floor, F.ceil))))
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = counts.groupBy(*keys, "bin").agg(F.sum("k").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
    bins = bins.withColumn("below", F.sum("c").over(so_far) - F.col("c")).withColumn("n", F.sum("c").over(whole))
    bins = bins.withColumn("rank", F.explode(F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))))
    bins = bins.select(*keys, "bin", "rank", "n", "low", "high", "below")

    parted = counts.join(bins, [*keys, "bin"]).withColumn("part", _part(F.col("x"), F.col("low"), F.col("high")))
    parts = parted.groupBy(*keys, "rank", "bin", "part").agg(F.sum("k").alias("c"), *(F.first(c).alias(c) for c in ("n", "low", "high", "below")))
    by_rank = Window.partitionBy(*keys, "rank")
    parts = parts.withColumn("below", F.col("below") + F.sum("c").over(by_rank.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    parts = parts.where("rank >= below and rank < below + c").drop("c")

    near = counts.join(parts, [*keys, "bin"]).where(_part(F.col("x"), F.col("low"), F.col("high")) == F.col("part"))
    upto = F.col("below") + F.sum("k").over(by_rank.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("upto", upto).where("rank < upto and rank >= upto - k")

    out = []
    for name, p in probabilities.items():
        spot = p * (F.first("n") - 1)
        at = lambda f, p=p: F.max(F.when(F.col("rank") == f(p * (F.col("n") - 1)).cast("long"), F.col("x")))
        share = spot - F.floor(spot)
        out.append(F.when(share == 0, at(F.floor)).otherwise((1 - share) * at(F.floor) + share * at(F.ceil)).alias(name))
    return found.groupBy(*keys).agg(*out)


def medians(cells: DataFrame, keys: tuple[str, ...], value: Column | str, name: str = "median") -> DataFrame:
    return quantiles(cells, keys, value, {name: 0.5})
