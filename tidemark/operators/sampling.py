"""Training windows: weighted draws of series, what is cut from them, and batches of windows of like size.

A draw's random numbers are a function of its id and the name of the choice, so that results depend neither on partitions
nor on order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import label_confidence
from ..schema import MAX_T, MIN_T, UNKNOWN_WEIGHT
from ..storage import written
from . import labels, scans

#: Factors that series are thinned by, as likely as they are often.
FACTORS = (1, 1, 1, 2, 3, 4, 7, 8, 12)
#: Channels of a window at most; parts of the line that weights are laid out on; rows of a block that windows are cut from.
MOST_CHANNELS, CELLS_OF_LINE, BLOCK = 100, 1024, 4096

Draw = Callable[[str], Column]


def hashed(item: str = "item") -> Draw:
    """Numbers from 0 to below 1 by hash of the item's id and the choice's name."""
    return lambda choice: F.pmod(F.xxhash64(F.col(item), F.lit(choice)), F.lit(1 << 53)) / float(1 << 53)


def weighted_draws(items: DataFrame, catalog: DataFrame, by: str, weight: Column, draw: Draw | None = None) -> DataFrame:
    """``items`` (``item``) each with a row of ``catalog``, drawn with replacement: first a value of ``by``, all alike, then a row of it,
    likelier by ``weight``; rows without a weight above 0 are never drawn.

    Weights are laid on a line from 0 to 1, one for each value of ``by``, by running sums in blocks; an item's number falls on the line,
    and both meet by the line's parts: an equi-join with the exact bounds checked after.
    """
    draw = draw or hashed()
    known = catalog.withColumn("weight_", weight.cast("double")).where("weight_ > 0")
    line = scans.running(scans.numbered(known, (by,), ["series_id"]), {"upto_": ("sum", "weight_")}, (by,))
    line = written(line, "weights")
    ends = written(line.groupBy(by).agg(F.max("upto_").alias("whole_"), F.max("row_idx").alias("top_")), "ends")
    names = ends.select(by).withColumn("k_", F.row_number().over(Window.orderBy(by)) - 1)  # a row a value of ``by``
    n = names.count()
    last = F.col("row_idx") == F.col("top_")
    spans = line.join(ends, by).withColumn("low_", (F.col("upto_") - F.col("weight_")) / F.col("whole_")).withColumn("high_", F.when(last, 1.0).otherwise(F.col("upto_") / F.col("whole_")))
    # The next one begins where this one ends, to the bit.
    begins = scans.previous(spans, ["high_"], (by,)).withColumn("low_", F.coalesce("previous_high_", F.lit(0.0))).where("low_ < high_")
    parts = F.sequence(F.floor(F.col("low_") * CELLS_OF_LINE), F.least(F.floor(F.col("high_") * CELLS_OF_LINE), F.lit(CELLS_OF_LINE - 1).cast("long")))
    spread = begins.drop("whole_", "top_", "weight_", "upto_", "row_idx", "previous_high_").withColumn("part_", F.explode(parts))
    drawn = items.withColumn("k_", F.floor(draw("group") * n)).withColumn("u_", draw("row")).join(names, "k_")
    drawn = drawn.withColumn("part_", F.floor(F.col("u_") * CELLS_OF_LINE))
    hit = drawn.join(spread, [by, "part_"]).where((F.col("u_") >= F.col("low_")) & (F.col("u_") < F.col("high_")))
    return hit.drop("k_", "u_", "part_", "low_", "high_")


def placed(drawn: DataFrame, draw: Draw | None = None, max_t: int = MAX_T, min_t: int = MIN_T) -> DataFrame:
    """Drawn series with what is cut from each: ``factor`` (rows a step; 1 if the series were too short), ``length`` in
    steps (half of them ``max_t`` if there are so many), ``start`` in steps and ``channels``, how many. ``drawn`` has ``n_rows, n_channels, label_level``."""
    draw = draw or hashed()
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), (F.floor(draw("factor") * len(FACTORS)) + 1).cast("int"))
    out = drawn.withColumn("factor", factor)
    out = out.withColumn("factor", F.when(F.floor(F.col("n_rows") / F.col("factor")) < 2 * min_t, 1).otherwise(F.col("factor")))
    steps = F.floor(F.col("n_rows") / F.col("factor"))
    some = min_t + F.floor(draw("length") * (max_t - min_t + 1))
    out = out.withColumn("length", F.least(F.when(draw("whole") < 0.5, F.lit(max_t).cast("long")).otherwise(some), steps))
    out = out.withColumn("start", F.floor(draw("start") * (steps - F.col("length") + 1)))
    most = F.least(F.col("n_channels"), F.lit(MOST_CHANNELS))
    few = F.greatest(F.lit(1), F.bround(F.exp(draw("channels") * F.log(most.cast("double")))).cast("int"))
    return out.withColumn("channels", F.when(F.col("label_level") == "row", most).otherwise(F.least(few, most)).cast("int"))


def training_windows(cells: DataFrame, drawn: DataFrame, draw: Draw | None = None, unknown: float = UNKNOWN_WEIGHT) -> DataFrame:
    """The cells of placed draws: ``item, series_id, row_idx`` (step in the window), ``timestamp, channel, value, label, target, weight, row_weight``.

    Steps are means of ``factor`` rows, or every ``factor``-th row, by the draw. The channels are those of least number of the draw. Windows meet
    the cells by series and block, so that a window reads its own blocks only. Channels without two different values go, and
    so do windows with anomalies in more than 60 % of rows. Anomalous rows of row-labelled series count as such only if all
    their channels are in the window.
    """
    draw = draw or hashed()
    spans = drawn.withColumn("mean_", draw("mean") < 0.5).withColumn("from_", F.col("start") * F.col("factor")).withColumn("to_", (F.col("start") + F.col("length")) * F.col("factor"))
    blocks = F.sequence(F.floor(F.col("from_") / BLOCK), F.floor((F.col("to_") - 1) / BLOCK))
    wanted = spans.select("item", "series_id", "factor", "mean_", "from_", "to_", "channels", "n_channels", "label_level", "confidence", F.explode(blocks).alias("block_"))
    near = cells.select("series_id", "row_idx", "timestamp", "channel", "value", "label", F.floor(F.col("row_idx") / BLOCK).alias("block_"))
    cut = near.join(wanted, ["series_id", "block_"]).where((F.col("row_idx") >= F.col("from_")) & (F.col("row_idx") < F.col("to_")))
    rank = F.pmod(F.xxhash64("item", "channel", F.lit("channel")), F.lit(1 << 53))
    seen = cut.select("item", "channel", "channels").distinct().withColumn("k_", F.row_number().over(Window.partitionBy("item").orderBy(rank, "channel")))  # a window's channels
    cut = cut.join(seen.where("k_ <= channels").select("item", "channel"), ["item", "channel"], "left_semi")
    step = F.floor((F.col("row_idx") - F.col("from_")) / F.col("factor"))
    cut = cut.withColumn("step_", step).where(F.col("mean_") | ((F.col("row_idx") - F.col("from_")) % F.col("factor") == 0))
    label = F.when(F.max((F.col("label") == 1).cast("int")) == 1, 1).when(F.min((F.col("label") == 0).cast("int")) == 1, 0).otherwise(-1)
    made = cut.groupBy("item", "series_id", "step_", "channel").agg(F.min("timestamp").alias("timestamp"), F.avg("value").alias("value"), label.alias("label"), *(F.first(c).alias(c) for c in ("label_level", "confidence", "channels", "n_channels")))
    made = written(made.withColumnRenamed("step_", "row_idx"), "windows")
    kept = labels.without_dense(labels.usable_channels(made, ("item",)), keys=("item",))
    whole = F.col("channels") >= F.col("n_channels")
    row = Window.partitionBy("item", "row_idx")
    positive = F.max((F.col("label") == 1).cast("int")).over(row) == 1
    masked = (F.col("label_level") == "row") & positive
    known = F.col("label") >= 0
    return kept.select(
        "item", "series_id", "row_idx", "timestamp", "channel", "value", "label",
        F.when(masked, -1).when(known, F.col("label")).otherwise(0).alias("target"),
        F.when(masked, 0.0).when(known, F.col("confidence")).otherwise(unknown).alias("weight"),
        F.when(masked & whole, F.col("confidence")).otherwise(0.0).alias("row_weight"),
    )


def confident(catalog: DataFrame) -> DataFrame:
    """``catalog`` with ``confidence`` and the weight of a series in its sector, the root of its rows."""
    return catalog.withColumn("confidence", label_confidence(F.lit(None).cast("double"), "label_quality")).withColumn("pull", F.sqrt("n_rows"))


def bucketed(items: DataFrame, rows: str, channels: str, budget: int, order: str = "item") -> DataFrame:
    """``items`` with ``bucket`` and ``batch``: batches of like size whose padded size (items times longest times widest) is within ``budget``;
    an item beyond it is a batch of its own.

    Items are dealt to buckets by the size of rows and channels, four for each doubling, so that little is padded; a bucket's batches all
    have as many items as its longest and widest allow. An item's batch is its number in the bucket over that: numbers come from a sort
    by ranges and prefix sums, so that a bucket may span many tasks.
    """

    def size_class(c: str) -> Column:
        bits = F.length(F.bin(F.col(c).cast("long")))
        return bits * 8 + F.floor(F.col(c) * 4 / F.pow(F.lit(2.0), bits - 1)).cast("int")

    if budget < 1:
        raise ValueError("a batch holds something")
    known = items.withColumn("bucket", F.concat_ws("/", size_class(rows), size_class(channels)))
    most = known.groupBy("bucket").agg(F.max(rows).alias("r_"), F.max(channels).alias("c_"))
    # Written, so that a bucket of many items can be split where it meets its one row.
    fits = written(most.select("bucket", F.greatest(F.lit(1), F.floor(F.lit(budget) / (F.col("r_") * F.col("c_")))).alias("fits_")), "fits")
    numbered = scans.numbered(known.withColumn("size_", F.col(rows) * F.col(channels)), ("bucket",), ["size_", order])
    return numbered.join(fits, "bucket").withColumn("batch", F.floor(F.col("row_idx") / F.col("fits_"))).drop("row_idx", "size_", "fits_")


def likely(n: int, share: float) -> float:
    """How far a share among ``n`` draws may be from ``share``: four standard deviations."""
    return 4 * math.sqrt(share * (1 - share) / n)
