"""Maximal runs of rows with one label, and the label repairs built on them.

Input is one row a time step: ``series_id, row_idx, label`` with labels 1, 0 and -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONTEXT_ROWS, CONTEXT_SHARE
from . import scans
from .labels import row_targets

SERIES = ("series_id",)


def islands(rows: DataFrame, label: int = 1) -> DataFrame:
    """The rows with ``label``, with ``run``, which is the same within a run and rises from run to run."""
    return scans.run_starts(rows.where(F.col("label") == label), label).withColumnRenamed("run_start", "run")


def runs(rows: DataFrame, label: int = 1) -> DataFrame:
    """One row a run: ``series_id, start, stop`` (exclusive), ``length``."""
    spans = islands(rows, label).groupBy("series_id", "run").agg(F.min("row_idx").alias("start"), (F.max("row_idx") + 1).alias("stop"))
    return spans.select("series_id", "start", "stop", (F.col("stop") - F.col("start")).alias("length"))


def _with_place(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` (0-based, in a run of anomalies) and ``run_start``; null outside."""
    return scans.run_starts(rows, 1).withColumn("place", F.col("row_idx") - F.col("run_start"))


def onset_cut(rows: DataFrame, onset: int) -> DataFrame:
    """``rows`` with the anomalies from the ``onset``-th row of a run on made unknown."""
    return _with_place(rows).withColumn("label", F.when(F.col("place") >= onset, -1).otherwise(F.col("label"))).drop("place", "run_start")


def context_fix(rows: DataFrame, onset: int | None = None, most: int = CONTEXT_ROWS, share: int = CONTEXT_SHARE) -> DataFrame:
    """Anomalous runs without enough normal rows before them made unknown, after the onset cut.

    Enough are ``most``, or a ``share``-th of the series' rows if that is less.
    """
    cut = rows if onset is None else onset_cut(rows, onset)
    normal = F.count_if(F.col("label") == 0)
    totals = {"normal_": F.sum("normal_").over(scans.before(SERIES)), "n_": F.sum("n_").over(Window.partitionBy(*SERIES))}
    placed = scans.carried(scans.blocks(cut), SERIES, {"normal_": normal, "n_": F.count("*")}, totals)
    own = normal.over(scans.inside(SERIES).rowsBetween(Window.unboundedPreceding, 0))
    # Within a run no normal row is added, so the count at any of its rows is that before its start.
    enough = F.coalesce("normal_", F.lit(0)) + own >= F.least(F.lit(most), F.floor(F.col("n_") / share))
    label = F.when((F.col("label") == 1) & ~enough, -1).otherwise(F.col("label"))
    return placed.withColumn("fixed", label).withColumn("label", F.col("fixed")).drop("fixed", "normal_", "n_", "block_")


def context_fix_cells(cells: DataFrame, onset: int | None = 2048, most: int = CONTEXT_ROWS, share: int = CONTEXT_SHARE) -> DataFrame:
    """``cells`` with the context rule applied by row: a row is anomalous if any of its cells is, normal if all are. Anomalous
    cells of rows that the rule makes unknown, or whose row was unknown, become unknown; all others stay."""
    fixed = context_fix(row_targets(cells), onset, most, share).select("series_id", "row_idx", F.col("label").alias("row_label_"))
    label = F.when((F.col("row_label_") == -1) & (F.col("label") == 1), -1).otherwise(F.col("label"))
    return cells.join(fixed, ["series_id", "row_idx"]).withColumn("label", label).drop("row_label_")


def first_rows(rows: DataFrame, keep: int) -> DataFrame:
    """Only the first ``keep`` rows of each run stay anomalies."""
    return onset_cut(rows, keep)


def normal_reference(rows: DataFrame, least: int = 20, most: int = 256) -> DataFrame:
    """The last run of at least ``least`` normal rows of each series, cut to its last ``most`` rows: ``series_id, start, stop``."""
    long_runs = runs(rows, 0).where(F.col("length") >= least)
    best = long_runs.groupBy("series_id").agg(F.max_by(F.struct("start", "stop"), "start").alias("r"))
    return best.select("series_id", F.greatest(F.col("r.start"), F.col("r.stop") - most).alias("start"), F.col("r.stop").alias("stop"))


def audit(rows: DataFrame, longest: int = 4096, share: float = 0.5, most: int = CONTEXT_ROWS, part: int = CONTEXT_SHARE) -> DataFrame:
    """Label measures and flags of each series.

    ``n``, ``known`` rows, ``ratio`` of anomalies among known rows, number of ``events``, the ``longest`` one, normal rows
    before the first one (``context``; all normal rows without events), and flags for too many anomalies, too long an
    event and too little context.
    """
    first = F.min(F.when(F.col("label") == 1, F.col("row_idx")))
    sized = scans.carried(scans.blocks(rows), SERIES, {"first": first}, {"first": F.min("first").over(Window.partitionBy(*SERIES))})
    base = sized.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") >= 0).alias("known"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if((F.col("label") == 0) & (F.col("first").isNull() | (F.col("row_idx") < F.col("first")))).alias("context"),
    )
    events = runs(rows).groupBy("series_id").agg(F.count("*").alias("events"), F.max("length").alias("longest"))
    all_ = base.join(events, "series_id", "left").na.fill(0, ["events", "longest"])
    ratio = F.when(F.col("known") > 0, F.col("positive") / F.col("known"))
    return all_.select(
        "series_id", "n", "known", ratio.alias("ratio"), "events", "longest", "context",
        F.coalesce(ratio > share, F.lit(False)).alias("flag_ratio"),
        (F.col("longest") > longest).alias("flag_long"),
        ((F.col("events") > 0) & (F.col("context") < F.least(F.lit(most), F.floor(F.col("n") / part)))).alias("flag_context"),
    ).withColumn("flag", F.col("flag_ratio") | F.col("flag_long") | F.col("flag_context"))


def audit_summary(audited: DataFrame, by: str) -> DataFrame:
    """Series, flagged ones, median ratio and longest event of each group that has flagged series."""
    return audited.groupBy(by).agg(
        F.count("*").alias("series"), F.count_if("flag").alias("flagged"), F.median("ratio").alias("median_ratio"), F.max("longest").alias("longest")
    ).where("flagged > 0")
