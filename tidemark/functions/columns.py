"""Column expressions: missing values, scaling, calibration, row scores, calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x: Column | str) -> Column:
    """NaN as null: Spark's aggregates skip nulls but not NaN."""
    x = col(x)
    return F.when(F.isnan(x), None).otherwise(x)


def finite(x: Column | str) -> Column:
    """The value if finite, else null."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sentinel(x: Column | str, value: float) -> Column:
    """A value that stands for missing, as null."""
    return F.nullif(col(x), F.lit(value))


def clip(x: Column | str, low: float, high: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))  # greatest and least pass over nulls


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def calibrate(p: Column | str, temperature: float = 1.0, bias: float = 0.0) -> Column:
    """Temperature and bias on the logit of a probability; the identity for 1 and 0."""
    if temperature == 1.0 and bias == 0.0:
        return col(p)
    z = logit(clip(p, 1e-7, 1 - 1e-7)) / temperature + bias
    return sigmoid(clip(z, -60, 60))


def sensitivity(threshold: float, level: str) -> float:
    """The decision threshold at a named sensitivity."""
    return {"low": threshold + (1 - threshold) / 2, "medium": threshold, "high": 0.6 * threshold}[level]


def robust_probability(z: Column | str) -> Column:
    """Anomaly probability of a robust z-score: none up to 3, then rising towards 1."""
    z = col(z)
    return F.when(z.isNotNull(), clip(1 - F.exp(-F.greatest(F.abs(z) - 3, F.lit(0.0))), 0.0, 1.0))


def top_scores(scores: Column | str, k: int) -> Column:
    """The ``k`` largest of an array, nulls left out."""
    return F.slice(F.sort_array(F.array_compact(col(scores)), asc=False), 1, k)


def row_score(scores: Column | str, how: str = "topk", k: int = 3) -> Column:
    """One score of a row from the array of its cells' scores: ``max``, mean of the ``topk``, or ``noisy_or`` of the top k."""
    top = top_scores(scores, k)
    if how == "max":
        out = F.array_max(col(scores))
    elif how == "topk":
        out = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    elif how == "noisy_or":
        out = 1 - F.aggregate(top, F.lit(1.0), lambda a, x: a * (1 - F.least(x, F.lit(1 - 1e-6))))
    else:
        raise ValueError(f"unknown aggregation {how!r}")
    present = F.array_compact(col(scores))
    return F.when(F.size(present) == 1, present[0]).when(F.size(present) > 1, out)


def combine_scales(single: Column | str, scales: list[Column | str], how: str = "mean") -> Column:
    """One score from the single-scale one and those of coarser scales; null scales are left out."""
    every = [col(single), *map(col, scales)]
    if how == "max":
        return F.greatest(*every) if len(every) > 1 else every[0]
    present = F.array_compact(F.array(*every))
    if how == "equal":
        return F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    if how == "mean":
        return F.aggregate(F.slice(present, 2, len(every)), present[0], lambda a, x: (a + x) / 2)
    raise ValueError(f"unknown combination {how!r}")


def label_confidence(explicit: Column | str, quality: Column | str) -> Column:
    """How far a series' labels are trusted: as stated, or by their kind."""
    by_kind = F.when(col(quality) == "weak", 0.2).when(col(quality) == "predictive", 0.3).otherwise(1.0)
    return F.coalesce(finite(explicit), by_kind)


def row_target(labels: Column | str) -> Column:
    """A row's label from the array of its cells': anomaly if any is, normal if all are, else unknown."""
    labels = col(labels)
    return F.when(F.exists(labels, lambda x: x == 1), 1).when(F.forall(labels, lambda x: x == 0), 0).otherwise(-1)


def hour(t: Column | str) -> Column:
    """Hour of the day of unix seconds, with fraction."""
    return F.pmod(col(t), F.lit(86400.0)) / 3600


def weekday(t: Column | str) -> Column:
    """Day of the week of unix seconds; Monday is 0."""
    return F.pmod(F.floor(col(t) / 86400) + 3, F.lit(7)).cast("int")


def year_share(t: Column | str) -> Column:
    """Share of the year gone, of unix seconds, in mean years from 1970."""
    return F.pmod(col(t) / 86400, F.lit(365.25)) / 365.25


def bump(position: Column, centre: float, width: float, period: float) -> Column:
    """A bell around ``centre`` on a circle of length ``period``."""
    away = F.abs(position - centre)
    away = F.least(away, period - away)
    return F.exp(-0.5 * F.pow(away / width, 2))


def unix_seconds(t: Column | str) -> Column:
    """A timestamp as unix seconds with fraction."""
    return F.unix_micros(col(t).cast("timestamp")) / 1e6


#: Numeric times of a larger typical size are milliseconds.
MILLISECONDS = 1e11


def binary_loss(p: Column | str, y: Column | str, eps: float = 1e-7) -> Column:
    """Cross entropy of one probability and label."""
    q = clip(p, eps, 1 - eps)
    return -(col(y) * F.log(q) + (1 - col(y)) * F.log1p(-q))


def focal_loss(p: Column | str, y: Column | str, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """Cross entropy with easy cells weighted down."""
    q = clip(p, 1e-7, 1 - 1e-7)
    right = F.when(col(y) == 1, q).otherwise(1 - q)
    weight = F.when(col(y) == 1, alpha).otherwise(1 - alpha)
    return -weight * F.pow(1 - right, gamma) * F.log(right)


def triangle(place: Column, length: Column) -> Column:
    """Weight of the 0-based ``place`` in a window of ``length`` rows: 0.1 at the ends, 1 in the middle."""
    at = F.when(length > 1, 2 * place / (length - 1) - 1).otherwise(-1.0)
    return (1 - F.abs(at)) * 0.9 + 0.1


LN2 = math.log(2)
