"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed on the executors, over whole texts. Trees are fitted on a bounded sample of labelled
rows (``SAMPLE_ROWS``, those of least hash) and flattened into arrays of feature, threshold and leaf value;
scoring walks all trees of a batch at once with numpy.

Defined cases: null and empty texts have all-zero statistics and get the score these lead to; equal texts
have equal scores; without any labelled row every score is 0.5; other columns are no input of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts

#: Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000

STATISTICS = (
    "bytes", "words", "mean_word", "longest_word", "one_letter", "distinct_words", "top_word", "top_five",
    "lines", "mean_line", "distinct_lines", "upper", "digits", "marks", "stars", "bangs", "pipes", "stops",
    "commas", "blanks", "non_ascii", "controls", "packed", "capital_words", "repeated_pairs",
)


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(STATISTICS) - 1)
    n, size = len(words), len(data)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts = Counter(words)
    top = sorted(counts.values(), reverse=True)[:5]
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:], strict=False)))
    share = lambda chars: float(seen[list(chars)].sum()) / size
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), float(np.log1p(lengths.max())), float((lengths == 1).mean()),
        len(counts) / n, top[0] / n, sum(top) / n,
        float(np.log1p(len(lines))), float(np.log1p(size / len(lines))), len(set(lines)) / len(lines),
        float(seen[65:91].sum()) / size, float(seen[48:58].sum()) / size, share(b"#*$%&|<>"), share(b"*#$%&"), share(b"!"), share(b"|"), share(b"."),
        share(b","), share(b" \t"), float(seen[128:].sum()) / size, float(seen[:32].sum() - seen[[9, 10, 13]].sum()) / size,
        len(zlib.compress(data, 1)) / size, sum(w[:1].isupper() for w in words) / n, 1 - pairs / max(1, n - 1),
    ]


@dataclass
class Trees:
    """Flattened trees: rows are trees, columns the nodes of a complete binary tree in level order."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boost ``trees`` trees of ``depth`` levels by logistic loss; ``least`` is the least hessian sum of a child."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    rows, n_features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    cell = binned + np.arange(n_features) * bins
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(rows, base)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (n_features * bins) + cell).ravel()
            shape = (width, n_features, bins)
            g = np.bincount(key, np.repeat(grad, n_features), width * n_features * bins).reshape(shape).cumsum(2)
            h = np.bincount(key, np.repeat(hess, n_features), width * n_features * bins).reshape(shape).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    out.feature[t, first + k], out.threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(rows), out.feature[t, node]] > out.threshold[t, node])
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        out.leaf[t] = -rate * g / (h + ridge)
        raw += out.leaf[t][node - inner]
    return out


def remainder(divisor: int) -> Column:
    """crc32 of ``doc_id`` as text, by ``divisor``: the split of rows into learnt and held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def labelled(labels: DataFrame, label: str, held_out: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``label`` of the rows to learn from, at most ``rows`` of them: those of least hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    return known.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sampled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents; that many ids are broadcast."""
    return texts(docs).join(F.broadcast(labelled(labels, label, held_out, rows)), "doc_id")


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``stats`` (array of double) and further columns of ``docs``."""
    bounded_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="text").assign(stats=[statistics(t) for t in frame["text"]])

    fields = "".join(f", `{c}` {kinds[c]}" for c in more)
    return texts(docs, *more).mapInPandas(run, f"doc_id long{fields}, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees for ``labels.quality``; the driver gets the statistics of ``rows`` rows at most."""
    sample = sampled(docs, labels, "quality", held_out, rows)
    got = measured(sample, "label").select("doc_id", "label", "stats").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["stats"].tolist(), float).reshape(len(got), len(STATISTICS))
    return fit(x, got["label"].to_numpy(float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id``, ``score`` of every document. Narrow: no shuffle; the model has a fixed size."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([statistics(t) for t in frame["text"]]).reshape(len(frame), len(STATISTICS))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": shared.value.score(x)})

    return texts(docs).mapInPandas(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Trees, least: float) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in column]).reshape(len(column), len(STATISTICS))
        return pd.Series(shared.value.score(x))

    return docs.where(score("text") >= least)
