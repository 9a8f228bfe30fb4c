"""Ordered scans of long series, in blocks of rows.

A window over a whole series sorts it in one task. Here a series is cut at multiples of ``BLOCK`` of its ``row_idx``. A
block is summed up in one row; what a block takes over from those before it is a window over these rows, of
which there are few; and it meets the block's rows by an equi-join on keys and block, so that the largest unit of a
task is a block. In-block windows are partitioned the way the join is.

Keys aren't null, and ``row_idx`` is unique within them; it may have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import col
from ..storage import written

#: Rows of a block.
BLOCK = 65_536

_TOTALS = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}


def blocks(rows: DataFrame, size: int | None = None) -> DataFrame:
    """``rows`` with their ``block_``."""
    return rows.withColumn("block_", F.floor(F.col("row_idx") / (size or BLOCK)))


def inside(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys, "block_").orderBy("row_idx")


def in_order(keys: tuple[str, ...]) -> WindowSpec:
    """Over the summaries of one key, by block."""
    return Window.partitionBy(*keys).orderBy("block_")


def before(keys: tuple[str, ...]) -> WindowSpec:
    return in_order(keys).rowsBetween(Window.unboundedPreceding, -1)


def carried(placed: DataFrame, keys: tuple[str, ...], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``placed`` with the ``carry`` columns: window expressions over the ``summary`` aggregates of each block."""
    sums = placed.groupBy(*keys, "block_").agg(*(c.alias(n) for n, c in summary.items()))
    taken = sums.select(*keys, "block_", *(c.alias(n) for n, c in carry.items()))
    return placed.join(taken, [*keys, "block_"])


def previous(rows: DataFrame, names: list[str], keys: tuple[str, ...], size: int | None = None) -> DataFrame:
    """``rows`` with ``previous_<name>`` of the row before; null at first."""
    out = carried(blocks(rows, size), keys, {"last_": F.max_by(F.struct(*names), "row_idx")}, {"last_": F.lag("last_").over(in_order(keys))})
    first = F.row_number().over(inside(keys)) == 1
    shifted = {f"previous_{n}": F.when(first, F.col(f"last_.{n}")).otherwise(F.lag(n).over(inside(keys))) for n in names}
    return out.withColumns(shifted).drop("last_", "block_")


def last_known(rows: DataFrame, name: str, keys: tuple[str, ...], into: str, size: int | None = None) -> DataFrame:
    """``rows`` with ``into``: the last value of ``name`` that isn't null, the row's own included."""
    known = F.max_by(name, F.when(F.col(name).isNotNull(), F.col("row_idx")))
    out = carried(blocks(rows, size), keys, {"known_": known}, {"known_": F.last("known_", ignorenulls=True).over(before(keys))})
    own = F.last(name, ignorenulls=True).over(inside(keys).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(into, F.coalesce(own, "known_")).drop("known_", "block_")


def running(rows: DataFrame, totals: dict[str, tuple[str, Column | str]], keys: tuple[str, ...], size: int | None = None) -> DataFrame:
    """``rows`` with a running total for each of ``totals``, ``name: (how, value)``: ``sum``, ``product``, ``max`` or ``min``
    of the values up to the row's own. Nulls are passed over."""
    if unknown := {how for how, _ in totals.values()} - _TOTALS.keys():
        raise ValueError(f"unknown totals {sorted(unknown)}")
    out = blocks(rows, size)
    summary = {f"{n}_": _TOTALS[how](col(x)) for n, (how, x) in totals.items()}
    out = carried(out, keys, summary, {f"{n}_": _TOTALS[how](F.col(f"{n}_")).over(before(keys)) for n, (how, _) in totals.items()})
    made = {}
    for name, (how, x) in totals.items():
        own, earlier = _TOTALS[how](col(x)).over(inside(keys).rowsBetween(Window.unboundedPreceding, 0)), F.col(f"{name}_")
        both = {"sum": own + earlier, "product": own * earlier, "max": F.greatest(own, earlier), "min": F.least(own, earlier)}[how]
        made[name] = F.coalesce(both, own, earlier)
    return out.withColumns(made).drop(*summary, "block_")


def run_starts(rows: DataFrame, label: int, keys: tuple[str, ...] = ("series_id",), size: int | None = None) -> DataFrame:
    """``rows`` with ``run_start``, the first ``row_idx`` of the run of ``label`` that a row is in; null outside.

    A run ends at another label and at a gap of ``row_idx``. A block's first run goes on from the block before if both
    have the label where they meet; its start is then that of the last run which begins in an earlier block.
    """
    placed, w = blocks(rows, size), inside(keys)
    fresh = (F.col("label") == label) & ~F.coalesce((F.lag("label").over(w) == label) & (F.lag("row_idx").over(w) == F.col("row_idx") - 1), F.lit(False))
    placed = placed.withColumn("own_", F.when(F.col("label") == label, F.last(F.when(fresh, F.col("row_idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    summary = {"low_": F.min("row_idx"), "high_": F.max("row_idx"), "first_": F.min_by("label", "row_idx"), "end_": F.max_by("label", "row_idx"), "tail_": F.max("own_")}
    sums = placed.groupBy(*keys, "block_").agg(*(c.alias(n) for n, c in summary.items()))
    each = in_order(keys)
    goes_on = F.coalesce((F.col("first_") == label) & (F.lag("end_").over(each) == label) & (F.lag("high_").over(each) == F.col("low_") - 1), F.lit(False))
    sums = sums.withColumn("on_", goes_on)
    begun = F.last(F.when(~(F.col("on_") & (F.col("tail_") == F.col("low_"))), F.col("tail_")), ignorenulls=True).over(before(keys))
    taken = sums.select(*keys, "block_", "low_", F.when(F.col("on_"), begun).alias("earlier_"))
    start = F.when(F.col("own_") == F.col("low_"), F.coalesce("earlier_", "own_")).otherwise(F.col("own_"))
    return placed.join(taken, [*keys, "block_"]).withColumn("run_start", start).drop("own_", "low_", "earlier_", "block_")


def numbered(rows: DataFrame, keys: tuple[str, ...], order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``row_idx`` from 0 in each key by ``order``, which has to end in a tie-break.

    Rows are sorted by ranges of keys and order, so that a key may span many tasks; they are written, as ranges are drawn anew
    each time. A row's number is its place in the range and the count of its key's rows in earlier ranges.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in (*keys, *order)]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("range_", F.spark_partition_id()).withColumn("place_", place)
    dealt = written(dealt, "numbered")
    sums = dealt.groupBy(*keys, "range_").agg(F.count("*").alias("n_"), F.min("place_").alias("low_"))
    earlier = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*keys, "range_", (earlier - F.col("low_")).alias("shift_"))
    return dealt.join(starts, [*keys, "range_"]).withColumn("row_idx", F.col("place_") + F.col("shift_")).drop("range_", "place_", "shift_")
