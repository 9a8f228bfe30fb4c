"""Ranking metrics with ties, range-tolerant precision, calibration and thresholds, by series.

Input is one row a time step: ``series_id, row_idx, label, score``; rows with unknown label don't count.
Ties are counted together: rows are added up by score before any window, so a window sees distinct scores.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import binary_loss, clip, logit
from ..schema import BUFFERS


def curve(scores: DataFrame, keys: tuple[str, ...] = ("series_id",), label: str = "label") -> DataFrame:
    """One row a distinct score, from the highest: its ``pos`` and ``neg`` rows, those so far (``tp``, ``fp``) and all (``p``, ``n``)."""
    one = scores.where(F.col(label) >= 0).groupBy(*keys, "score").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    return one.select("*", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))


def ranking(scores: DataFrame, keys: tuple[str, ...] = ("series_id",), label: str = "label") -> DataFrame:
    """``average_precision, roc_auc, best_f1`` of the groups that have both classes."""
    c = curve(scores, keys, label).where("p > 0 and n > 0")
    tp, fp, p, n = (F.col(x) for x in ("tp", "fp", "p", "n"))
    return c.groupBy(*keys).agg(
        F.sum(F.col("pos") / p * tp / (tp + fp)).alias("average_precision"),
        F.sum(F.col("pos") * (n - fp + F.col("neg") / 2) / (p * n)).alias("roc_auc"),
        F.max(2 * tp / (tp + fp + p)).alias("best_f1"),
    )


def brier_nll(scores: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Mean squared error and mean cross entropy over known rows, with their number and that of anomalies' share."""
    known = scores.where("label >= 0")
    return known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("label").alias("anomaly_share"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"), F.avg(binary_loss("score", "label")).alias("nll")
    )


def _widened(scores: DataFrame, buffers: tuple[int, ...]) -> DataFrame:
    """``average_precision, roc_auc, best_f1`` by series and ``buffer``: labels widened by as many known rows on either side.

    All widened labels come from one sort of the known rows; they are then stacked and ranked as groups of their own.
    """
    by_row = Window.partitionBy("series_id").orderBy("row_idx")
    wide = F.array(*(F.struct(F.lit(b).alias("buffer"), F.max("label").over(by_row.rowsBetween(-b, b)).alias("wide")) for b in buffers))
    stacked = scores.where("label >= 0").select("series_id", "score", wide.alias("ws")).select("series_id", "score", F.explode("ws").alias("w")).select("series_id", "score", "w.buffer", F.col("w.wide").alias("label"))
    each = curve(stacked, ("series_id", "buffer")).where("p > 0")
    tp, fp, p, n = (F.col(x) for x in ("tp", "fp", "p", "n"))
    return each.groupBy("series_id", "buffer").agg(
        F.sum(F.col("pos") / p * tp / (tp + fp)).alias("average_precision"),
        F.sum(F.try_divide(F.col("pos") * (n - fp + F.col("neg") / 2), p * n)).alias("roc_auc"),
        F.max(2 * tp / (tp + fp + p)).alias("best_f1"),
    )


def range_precision(scores: DataFrame, buffers: tuple[int, ...] = BUFFERS) -> DataFrame:
    """``vus_pr``: mean average precision over labels widened by each of ``buffers`` known rows on either side."""
    own = Window.partitionBy("series_id")
    both = scores.where("label >= 0").withColumns({"low_": F.min("label").over(own), "high_": F.max("label").over(own)}).where("low_ < high_")
    return _widened(both, buffers).groupBy("series_id").agg(F.avg("average_precision").alias("vus_pr"))


def row_metrics(scores: DataFrame, buffers: tuple[int, ...] = BUFFERS) -> DataFrame:
    """All metrics of each series; those that need both classes are null where there is one. Plain ranking metrics are those of
    labels widened by no row, so that the rows are ranked once."""
    plain = lambda c: F.max(F.when(F.col("buffer") == 0, F.col(c))).alias(c)
    ranked = _widened(scores, tuple({0: 0, **dict.fromkeys(buffers)})).groupBy("series_id")
    ranked = ranked.agg(*map(plain, ("average_precision", "roc_auc", "best_f1")), F.avg(F.when(F.col("buffer").isin(*buffers), F.col("average_precision"))).alias("vus_pr"))
    mixed = (F.col("anomaly_share") > 0) & (F.col("anomaly_share") < 1)
    names = ("average_precision", "roc_auc", "best_f1", "vus_pr")
    return brier_nll(scores).join(ranked, "series_id", "left").withColumns({c: F.when(mixed, F.col(c)) for c in names})


def source_score(metrics: DataFrame, unseen_weight: float = 0.7, keys: tuple[str, ...] = ()) -> DataFrame:
    """One number (for each of ``keys``): mean of (average precision + ROC area) / 2 by source, then over unseen and over
    seen sources, weighed; the one there is where the other is missing."""
    by_source = metrics.groupBy(*keys, "source", "unseen").agg(F.avg((F.col("average_precision") + F.col("roc_auc")) / 2).alias("s"))
    two = by_source.groupBy(*keys).agg(F.avg(F.when(F.col("unseen"), F.col("s"))).alias("unseen_score"), F.avg(F.when(~F.col("unseen"), F.col("s"))).alias("seen_score"))
    both = unseen_weight * F.col("unseen_score") + (1 - unseen_weight) * F.col("seen_score")
    return two.withColumn("score", F.coalesce(both, "unseen_score", "seen_score"))


def compared(metrics: DataFrame, base: str | None = None, margin: float = 0.01, places: int = 9) -> DataFrame:
    """Ways of scoring against each other: ``metrics`` of each ``way`` give its source score and whether it is ``chosen``.

    The best is (the first by name of equals), and the way ``base`` keeps its place unless the best exceeds it by more
    than ``margin``. Ways without a score are never chosen. Scores are compared as rounded to ``places``.
    """
    each = source_score(metrics, keys=("way",))
    score = F.round("score", places)
    by = F.when(score.isNotNull(), F.struct(-score, "way"))
    best = each.agg(F.min_by("way", by).alias("way"), F.max(score).alias("top"), F.max(F.when(F.col("way") == F.lit(base), score)).alias("kept"))
    keeps = F.col("kept").isNotNull() & (F.col("top") <= F.col("kept") + margin)
    best = best.select(F.when(keeps, F.lit(base)).otherwise(F.col("way")).alias("way"), F.lit(True).alias("chosen"))
    return each.join(best, "way", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def benchmark(metrics: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """By ``source``: number of series, mean of each metric, ``chance`` (what a random score gets for the mean of average
    precision and ROC area) and, with a ``baseline``'s metrics, ``gain``: the difference in range-tolerant precision
    (null for sources that the baseline lacks)."""
    names = ("anomaly_share", "average_precision", "vus_pr", "roc_auc", "best_f1", "brier", "nll")
    table = metrics.groupBy("source").agg(F.count("series_id").alias("n_series"), *(F.avg(c).alias(c) for c in names)).withColumn("chance", (F.col("anomaly_share") + 0.5) / 2)
    if baseline is None:
        return table
    theirs = baseline.groupBy("source").agg(F.avg("vus_pr").alias("theirs"))
    return table.join(theirs, "source", "left").withColumn("gain", F.col("vus_pr") - F.col("theirs")).drop("theirs")


def false_alarms(cells: DataFrame, above: float = 0.7, k: int = 5) -> DataFrame:
    """The channels of each series that most often exceed ``above`` (``p``) in normal rows (``label``, the row's):
    ``series_id, channel, rate, place``; of equals the least channel first."""
    rate = cells.where("label = 0").groupBy("series_id", "channel").agg(F.avg(F.when(F.col("p") > above, 1.0).otherwise(0.0)).alias("rate"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("rate"), "channel"))  # a row a channel
    return rate.withColumn("place", place).where(F.col("place") <= k)


def best_threshold(scores: DataFrame, keys: tuple[str, ...] = ("series_id",), low: float = 1e-4, high: float = 0.95) -> DataFrame:
    """The score with the best F1 (the highest of equals), within bounds."""
    c = curve(scores.where("label >= 0"), keys).where("p > 0")
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    best = c.withColumn("f1", F.round(f1, 9)).groupBy(*keys).agg(F.max_by("score", F.struct("f1", "score")).alias("at"), F.max("f1").alias("f1"))
    return best.select(*keys, clip("at", low, high).alias("threshold"), "f1")


def fit_calibration(scores: DataFrame) -> tuple[float, float]:
    """Temperature and bias of ``calibrate`` by logistic regression of the label on the score's logit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = scores.where("label >= 0").select(logit(clip("score", 1e-7, 1 - 1e-7)).alias("z"), F.col("label").cast("double").alias("label"))
    data = VectorAssembler(inputCols=["z"], outputCol="features").transform(rows)
    model = LogisticRegression(regParam=0.0, standardization=False, maxIter=100).fit(data)
    slope = max(model.coefficients[0], 1e-6)
    temperature = min(max(1 / slope, math.exp(-3)), math.exp(3))
    return temperature, min(max(model.intercept, -10.0), 10.0)
