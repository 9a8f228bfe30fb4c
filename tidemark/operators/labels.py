"""Supervision targets, roles and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNKNOWN_WEIGHT
from . import scans

#: Sources whose labels may be learned from, with the patterns that a series' id must all match.
LEARNED = {
    "hai": ("/test", r"hai-20\.07|hai-21\.03"),
    "cats": ("/train$",),
    "esa": ("/train$",),
    "esa_full": ("/train$",),
    "lead": (),
    "care": (),
    "ctf": (),
    "kelmarsh": (),
    "alfa": (),
    "pvfault": (),
}
#: Ids of series that measure bodies.
PHYSIOLOGY = "sddb|BIDMC|ECG|ecg|mitdb|MITDB|ltst|LTST|qtdb"


def row_targets(cells: DataFrame, keys: tuple[str, ...] = ("series_id", "row_idx")) -> DataFrame:
    """A row's label from its cells': anomaly if any is, normal if all are, else unknown."""
    label = F.when(F.max((F.col("label") == 1).cast("int")) == 1, 1).when(F.min((F.col("label") == 0).cast("int")) == 1, 0).otherwise(-1)
    return cells.groupBy(*keys).agg(label.alias("label"))


def supervision(cells: DataFrame, confidence: Column, level: Column, unknown: float = UNKNOWN_WEIGHT) -> DataFrame:
    """``cells`` with ``target, weight, row_weight``.

    Cell level: the label (unknown: 0), weighed by the confidence if known, else by ``unknown``. Row level: cells of
    anomalous rows have no target (-1) and no weight; the row has the confidence as weight if all its cells are known.
    """
    row = Window.partitionBy("series_id", "row_idx")
    seen = F.min((F.col("label") >= 0).cast("int")).over(row) == 1
    positive = F.max((F.col("label") == 1).cast("int")).over(row) == 1
    masked = (level == "row") & positive
    known = F.col("label") >= 0
    return cells.select(
        "*",
        F.when(masked, -1).when(known, F.col("label")).otherwise(0).alias("target"),
        F.when(masked, 0.0).when(known, confidence).otherwise(unknown).alias("weight"),
        F.when((level == "row") & positive & seen, confidence).otherwise(0.0).alias("row_weight"),
    )


def held_out(key: Column, one_in: int = 5) -> Column:
    """Every ``one_in``-th id."""
    return F.pmod(key, F.lit(one_in)) == 0


def holdout_ids(ids: DataFrame, key: str, share: float) -> DataFrame:
    """``max(1, round(n * share))`` of the ids (half to even), those of least hash."""
    ranked = ids.select(key).distinct()
    return ranked.orderBy(F.xxhash64(key), key).limit(max(1, round(ranked.count() * share)))


def roles(catalog: DataFrame, tests: list[str], validation: list[str], holdout_sectors: list[str]) -> DataFrame:
    """``catalog`` with ``role``, first match wins: benchmark, test (labelled test source), val (labelled unseen source),
    holdout (unlabelled unseen source), val (own share of a seen source), holdout (sector), train. Val and test series
    with more than half of their rows anomalous become holdout."""
    labelled = ~F.col("unlabeled")
    role = (
        F.when(F.col("benchmark").isNotNull(), "benchmark")
        .when(F.col("source").isin(tests) & labelled, "test")
        .when(F.col("source").isin(validation) & labelled, "val")
        .when(F.col("source").isin(tests + validation), "holdout")
        .when(F.col("is_val") & labelled, "val")
        .when(F.col("sector").isin(holdout_sectors), "holdout")
        .otherwise("train")
    )
    crowded = F.col("role").isin("val", "test") & (F.coalesce("anomaly_row_ratio", F.lit(0.0)) > 0.5)
    return catalog.withColumn("role", role).withColumn("role", F.when(crowded, "holdout").otherwise(F.col("role")))


def calibration_split(catalog: DataFrame) -> DataFrame:
    """Series of half the validation sources (two at least, one less than all at most) get role ``calibration``; the first by name."""
    sources = catalog.where("role = 'val'").select("source").distinct()
    n = sources.count()
    if n < 2:
        raise ValueError("calibration needs two validation sources")
    chosen = [r[0] for r in sources.orderBy("source").limit(min(n - 1, max(2, n // 2))).collect()]  # a few source names
    return catalog.withColumn("role", F.when((F.col("role") == "val") & F.col("source").isin(chosen), "calibration").otherwise(F.col("role")))


def budget(catalog: DataFrame, by: str, size: str, order: list[Column], most: int) -> DataFrame:
    """Rows of each group in ``order``, which ends in a tie-break, while their ``running`` size stays within ``most``; the first always
    stays. Few groups may hold all rows: they are numbered by ranges and added up in blocks. Rows without a group go."""
    names = [f"order_{i}_" for i in range(len(order))]
    placed = scans.numbered(catalog.withColumns(dict(zip(names, order, strict=True))), (by,), names)
    run = scans.running(placed, {"running": ("sum", size)}, (by,))
    return run.where((F.col("running") <= most) | (F.col("row_idx") == 0)).drop("row_idx", *names)


def crop(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each series: from its start if the first anomaly lies in the first four fifths of them, else around it."""
    bounds = rows.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n"), F.coalesce(F.min(F.when(F.col("label") == 1, F.col("row_idx"))), F.lit(0)).alias("first"))
    start = F.when((F.col("n") <= most) | (F.col("first") < 0.8 * most), 0).otherwise(F.least(F.col("first") - most // 2, F.col("n") - most))
    return rows.join(bounds.select("series_id", start.alias("from_row")), "series_id").where((F.col("row_idx") >= F.col("from_row")) & (F.col("row_idx") < F.col("from_row") + most)).drop("from_row")


def learned_from(source: Column, series_id: Column) -> Column:
    """Whether a series' labels may be used in training: true or false, also for null."""
    may = F.lit(False)
    for name, patterns in LEARNED.items():
        fits = source == name
        for pattern in patterns:
            fits = fits & series_id.rlike(pattern)
        may = may | fits
    return F.coalesce(may, F.lit(False))


def reported_source(source: Column, series_id: Column) -> Column:
    """``source``, but for physiological series of ``ucr``, which are reported apart."""
    return F.when((source == "ucr") & series_id.rlike(PHYSIOLOGY), "ucr_physiology").otherwise(source)


def usable_channels(windows: DataFrame, keys: tuple[str, ...] = ("series_id", "window")) -> DataFrame:
    """The cells of channels that have two different values in their window; a window without any goes."""
    seen = windows.groupBy(*keys, "channel").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low < high")
    return windows.join(seen.select(*keys, "channel"), [*keys, "channel"], "left_semi")


def without_dense(windows: DataFrame, referenced: Column | None = None, keys: tuple[str, ...] = ("series_id", "window"), most: float = 0.6) -> DataFrame:
    """The cells of windows with anomalies in at most this share of rows, and of those with a normal reference."""
    known = F.lit(False) if referenced is None else F.coalesce(referenced, F.lit(False))
    rows = windows.groupBy(*keys, "row_idx").agg(F.max(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("hit"), F.max(known).alias("known"))
    dense = rows.groupBy(*keys).agg(F.avg("hit").alias("share"), F.max("known").alias("known")).where((F.col("share") > most) & ~F.col("known"))
    return windows.join(dense.select(*keys), list(keys), "left_anti")


def weighted_pick(catalog: DataFrame, by: str, weight: Column, drawn: Column, k: int, parts: int = 64) -> DataFrame:
    """``k`` rows of each group of ``by`` without replacement, likelier by ``weight``: those with the least
    ``-ln(drawn) / weight``; ``drawn`` is a row's own number above 0 and up to 1. Rows without a weight above 0 are never picked.
    The least ``k`` of each of ``parts`` parts of a group are found first, the least of these after."""
    some = catalog.withColumn("weight_", weight).where("weight_ > 0").withColumn("turn_", -F.log(drawn) / F.col("weight_"))
    some = some.withColumn("part_", F.pmod(F.xxhash64("series_id"), F.lit(parts)))
    for keys in ((by, "part_"), (by,)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("turn_", "series_id"))
        some = some.withColumn("place_", place).where(F.col("place_") <= k)
    return some.drop("weight_", "turn_", "part_", "place_")


def thinned(cells: DataFrame, share: float, drawn: Column | None = None) -> DataFrame:
    """An irregular series: rows whose number ``drawn`` (from 0 to below 1; a hash of series and row) is below ``share`` stay with all
    their cells, in order, labels and times unchanged; ``row_idx`` keeps its gaps. Narrow."""
    number = F.pmod(F.xxhash64("series_id", "row_idx"), F.lit(1 << 20)) / (1 << 20) if drawn is None else drawn
    return cells.where(number < share)
