"""Quality rules: word, line and repeat counts, and isolation forests on them.

The base rule (``base_failed``) is exact. Forests are grown on a bounded sample of documents that pass it
(``SAMPLE_ROWS``, those of least hash): each tree splits ``SUBSAMPLE`` of them at random, and a document is
the more anomalous the shorter its mean path. There is one forest on all statistics together and one on each
alone, as what is rare in one statistic drowns among the others. Each forest has its own threshold, calibrated on
all labelled rows: of those marked good, at most an equal part of ``FALSE_SHARE`` may go by it; a forest that
finds no larger share of the bad ones has no say. A document goes if any forest's score reaches its threshold.

Defined cases: null and empty texts have zero counts and fail the base rule; equal texts get equal verdicts, so do
repeated rows, each of which is judged and counts in the calibration; without labelled rows of both kinds only the
base rule decides; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bounded_batches, texts, written

#: Words in a window that counts as repeated when found twice.
WINDOW = 8
#: Documents the forest is grown on at most, trees, and documents of each tree.
SAMPLE_ROWS = 8_192
TREES = 60
SUBSAMPLE = 256
#: Share of labelled good documents that the calibrated thresholds may reject together.
FALSE_SHARE = 0.005
#: Bins of the score histograms that thresholds are read from.
BINS = 2_000
NONE = BINS + 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more, the first one's words included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    if len(number) == n:
        return 0
    ids = (ids + np.uint64(1)) * _FACTOR
    ids ^= ids >> np.uint64(29)
    ids *= np.uint64(0xBF58476D1CE4E5B9)
    key = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x94D049BB133111EB) + ids[k : n - WINDOW + 1 + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[: len(key)] += twice
    edge[WINDOW : WINDOW + len(key)] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def counted(text: str) -> tuple[int, int, int, int, int]:
    """The counts of one text, in the order of ``COUNTS``."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
    )


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and ``base_failed``. Narrow: no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([counted(t) for t in frame["text"]], columns=list(COUNTS))
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    fields = ", ".join(f"{c} long" for c in COUNTS)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return texts(docs).mapInPandas(run, f"doc_id long, {fields}").withColumn("base_failed", failed)


def measures(frame: pd.DataFrame) -> np.ndarray:
    """The rule statistics: mean word length, shares of symbols, repeated lines and repeated words, and log words."""
    words, chars, symbols, lines, again = (frame[c].to_numpy(float) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    n = np.maximum(1, words)
    return np.stack([chars / n, symbols / np.maximum(1, chars), lines / n, again / n, np.log1p(words)], axis=1)


#: Columns of the statistics that each forest splits.
VIEWS = ((0, 1, 2, 3, 4), (0,), (1,), (2,), (3,), (4,))


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows of a random tree."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Flattened trees in level order: feature (-1: leaf), split value, and path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the more anomalous."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, path in zip(self.feature, self.value, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                node = np.where(inner, 2 * node + 1 + (x[rows, feature[node]] >= value[node]), node)
            total += path[node]
        return 2.0 ** -(total / max(1, len(self.feature)) / max(1e-9, float(mean_path(self.size))))


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> Forest:
    """An isolation forest of ``trees`` trees, each on ``subsample`` random rows, split to single rows or the depth limit."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 ** (depth + 1) - 1
    out = Forest(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), size)
    for t in range(trees):
        open_nodes = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while open_nodes:
            node, level, rows = open_nodes.pop()
            low, high = rows.min(0), rows.max(0)
            wide = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(wide):
                out.path[t, node] = level + float(mean_path(len(rows)))
                continue
            f = int(rng.choice(wide))
            value = low[f] + (high[f] - low[f]) * (1 - rng.random())
            right = rows[:, f] >= value
            out.feature[t, node], out.value[t, node] = f, value
            open_nodes += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return out


@dataclass
class Steps:
    """A forest on one statistic as the step function that it is: the score from each split value on."""

    at: np.ndarray
    scores: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scores[np.searchsorted(self.at, x[:, 0], "right")]


def steps(forest: Forest) -> Steps:
    at = np.unique(forest.value[forest.feature >= 0])
    return Steps(at, forest.score(np.concatenate([at[:1] - 1 if len(at) else np.zeros(1), at])[:, None]))


def train(stats: DataFrame, rows: int = SAMPLE_ROWS) -> list[Forest | Steps]:
    """The forests of ``VIEWS``, of at most ``rows`` documents that pass the base rule; none where there are no such ones."""
    sample = stats.where(~F.col("base_failed")).orderBy(F.xxhash64("doc_id", "n_words"), "doc_id", *COUNTS).limit(rows).toPandas()
    if not len(sample):
        return []
    x = measures(sample)
    grown = [grow(x[:, list(view)]) for view in VIEWS]
    return [g if len(view) > 1 else steps(g) for g, view in zip(grown, VIEWS, strict=True)]


def scored(stats: DataFrame, forests: list[Forest | Steps]) -> DataFrame:
    """``stats`` with ``anomalies``, each forest's score; the forests have a fixed size."""
    shared = stats.sparkSession.sparkContext.broadcast(forests)

    @F.pandas_udf("array<double>")
    def anomalies(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        x = measures(pd.DataFrame(dict(zip(COUNTS, (a, b, c, d, e), strict=True))))
        found = [forest.score(x[:, list(view)]) for forest, view in zip(shared.value, VIEWS)]
        return pd.Series(list(np.stack(found, 1) if found else np.zeros((len(x), 0))))

    return stats.withColumn("anomalies", anomalies(*COUNTS))


def thresholds(scores: DataFrame, labels: DataFrame, false_share: float = FALSE_SHARE) -> list[int]:
    """For each forest the least bin of scores in which at most its part of ``false_share`` of the good documents go; above
    all bins for one that has no say."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    each = scores.where(~F.col("base_failed")).select("doc_id", F.posexplode("anomalies").alias("view", "score"))
    binned = each.withColumn("bin", F.floor(F.col("score") * BINS).cast("int")).join(known, "doc_id")
    table = binned.groupBy("view", "bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).toPandas()
    out = []
    for view in range(len(VIEWS)):
        own = table[table["view"] == view]
        good, bad = (np.append(np.bincount(own["bin"], own[c], BINS + 1)[::-1].cumsum()[::-1], 0) for c in ("good", "bad"))  # rows from each bin on
        if not good[0] or not bad[0]:
            out.append(NONE)
            continue
        least = int(np.flatnonzero(good / good[0] <= false_share / len(VIEWS))[0])
        out.append(least if bad[least] / bad[0] > good[least] / good[0] else NONE)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: the counts, ``base_failed``, ``anomalies`` and ``kept``."""
    stats = written(counts(docs), "rules")
    scores = written(scored(stats, train(stats)), "anomalies")
    odd = F.lit(False)
    for view, least in enumerate(thresholds(scores, labels)):
        odd = odd | (F.floor(F.coalesce(F.get("anomalies", F.lit(view)), F.lit(0.0)) * BINS) >= least)
    return scores.withColumn("kept", ~F.col("base_failed") & ~odd)
