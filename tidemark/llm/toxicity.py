"""Toxicity: a linear classifier of character n-grams, each scaled by its naive Bayes log-count ratio.

Texts are lower-cased; n-grams of ``SIZES`` characters are hashed to ``BUCKETS`` features, present or not.
A feature's ratio is the log of its smoothed share in toxic over that in other documents. Features that
tell the classes apart (least chi-squared ``LEAST_CHI``, at most ``FEATURES``) are scaled by their ratio and
weighted by logistic regression. Counts come from a bounded sample of labelled rows (``SAMPLE_ROWS``).

Defined cases: null and empty texts have no features and get the intercept's score; equal texts have equal
scores; without labelled rows of both classes every score is the smoothed share of toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts, written
from .quality import sampled

#: Characters in an n-gram.
SIZES = (4, 5, 6)
BUCKETS = 1 << 20
#: Labelled rows to learn from, features to keep, at most.
SAMPLE_ROWS = 30_000
FEATURES = 4_096
LEAST_CHI = 12.0

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> Iterator[np.ndarray]:
    """The features of a text by n-gram size, with repeats."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    chars[(chars >= 9) & (chars <= 13)] = 32
    rolling = chars
    for n in range(2, max(SIZES) + 1):
        if len(chars) < n:
            return
        rolling = rolling[:-1] * _FACTOR + chars[n - 1 :]
        if n in SIZES:
            yield ((rolling * _FACTOR) >> np.uint64(44)).astype(np.int64)


@dataclass
class Linear:
    """Weight of each feature (0: not used) and the intercept."""

    weight: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        used = []
        for features in grams(text):
            used.append(features[self.weight[features] != 0])
        total = self.intercept
        if used:
            total += float(self.weight[np.unique(np.concatenate(used))].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def counts(sample: DataFrame) -> DataFrame:
    """``feature, toxic, other``: labelled documents with the feature, by class. Each task adds up its own rows first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = np.zeros((2, BUCKETS), np.int32)
        mark = np.zeros(BUCKETS, bool)
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                mark[:] = False
                for features in grams(text):
                    mark[features] = True
                there[int(label == 1)] += mark
        found = np.flatnonzero(there.any(0))
        yield pd.DataFrame({"feature": found, "toxic": there[1, found], "other": there[0, found]})

    partial = sample.mapInPandas(run, "feature long, toxic long, other long")
    return partial.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def ratios(table: DataFrame, toxic: int, other: int) -> dict[int, float]:
    """Log-count ratio of the features that tell the classes apart, ``FEATURES`` at most."""
    total = toxic + other
    absent_t, absent_o = F.lit(toxic) - F.col("toxic"), F.lit(other) - F.col("other")
    cross = F.col("toxic") * absent_o - F.col("other") * absent_t
    chi = F.lit(float(total)) * cross * cross / (F.lit(float(toxic)) * F.lit(float(other)) * (F.col("toxic") + F.col("other")) * (absent_t + absent_o + 1))
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("other") + 1) / (other + 2))
    best = table.select("feature", ratio.alias("ratio"), chi.alias("chi")).where(F.col("chi") >= LEAST_CHI)
    return {r["feature"]: r["ratio"] for r in best.orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()}


def train(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = SAMPLE_ROWS) -> Linear:
    """The classifier of ``labels.toxic``. The driver gets ``FEATURES`` ratios and the kept features of ``rows`` rows at most."""
    bounded_batches(docs.sparkSession)
    sample = written(sampled(docs, labels, "toxic", held_out, rows), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    none = Linear(np.zeros(BUCKETS, np.float32), float(np.log((toxic + 1) / (other + 1))))
    if not toxic or not other:
        return none
    ratio = ratios(counts(sample), toxic, other)
    if not ratio:
        return none
    features = np.array(sorted(ratio), np.int64)
    place = np.full(BUCKETS, -1, np.int64)
    place[features] = np.arange(len(features))
    shared = sample.sparkSession.sparkContext.broadcast(place.astype(np.int32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for text in frame["text"]:
                at = [shared.value[f] for f in grams(text)]
                at = np.concatenate(at) if at else np.zeros(0, np.int32)
                found.append(np.unique(at[at >= 0]).astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "found": found})

    got = sample.mapInPandas(run, "doc_id long, label int, found binary").toPandas().sort_values("doc_id", kind="stable")
    scale = np.array([ratio[f] for f in features.tolist()])
    y = (got["label"] == 1).to_numpy(float)
    # Rows of x are present features times their ratio; the weight of the scaled feature times the ratio is what a text adds.
    w, b = scaled_regression([np.frombuffer(x, np.int32) for x in got["found"]], y, scale)
    weight = np.zeros(BUCKETS, np.float32)
    weight[features] = w * scale
    return Linear(weight, b)


def scaled_regression(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = 2.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on ``scale`` at each row's features, by gradient steps with per-feature rates (Adam)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    w, b = np.zeros(len(scale)), float(np.log(mean / (1 - mean)))
    m, v, mb, vb = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(at, (w * scale)[col], len(rows)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        g = (np.bincount(col, error[at], len(scale)) * scale + ridge * w) / len(y)
        gb = error.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * (1 - step / (steps + 1))
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * fix * m / (np.sqrt(v) + 1e-9)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def scored(docs: DataFrame, model: Linear) -> DataFrame:
    """``doc_id``, ``score`` of every document. Narrow: no shuffle; the model has a fixed size."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [shared.value.score(t) for t in frame["text"]]})

    return texts(docs).mapInPandas(run, "doc_id long, score double")
