"""Periodic runs: stretches of words that repeat with a period, found by probing a harmonic grid.

A run of period ``p`` has at least two periods, so that it holds a pair of neighbouring multiples of ``p``. For
each ``p`` the words at ``jp`` and ``(j + 1)p`` are compared, all pairs of a block of periods at once: about
``n ln n`` comparisons. Pairs that are equal and have equal neighbours are extended to both sides by array
comparison in growing chunks. Pairs within a run of a period that divides ``p`` are skipped: there, ``p`` isn't the smallest
period. So are pairs within the stretch found last.

Defined cases: null and empty texts have no words and no runs; each row is judged by itself, so repeated rows get
equal results; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts

#: Least words of a run.
LEAST = 12
#: Pairs of a block of periods that are compared at once.
PAIRS = 1 << 18
#: Words compared first when a pair is extended; each further chunk has twice as many.
CHUNK = 64

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _blocks(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods up to ``most`` with about ``PAIRS`` pairs each, one period at least."""
    first = 1
    while first <= most:
        last, pairs = first, (n - 1) // first
        while last < most and pairs + (n - 1) // (last + 1) <= PAIRS:
            last += 1
            pairs += (n - 1) // last
        yield first, last
        first = last + 1


def _grid(first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods and lower places of all pairs of neighbouring multiples below ``n``."""
    periods = np.arange(first, last + 1)
    counts = (n - 1) // periods
    period = np.repeat(periods, counts)
    j = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
    return period, j * period


def _promising(ids: np.ndarray, period: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Whether ``at`` lies among as many equal pairs in a row as any run needs, by the pairs nearby."""
    need = (least + 1) // 2  # a run of period p has max(least - p, p) equal pairs at least
    n, streak, best = len(ids), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for step in range(1 - need, need):
        x = at + step
        inside = (x >= 0) & (x + period < n)
        x = np.where(inside, x, 0)
        streak = np.where(inside & (ids[x] == ids[np.where(inside, x + period, 0)]), streak + 1, 0)
        best = np.maximum(best, streak)
    return best >= need


def _reach(same: np.ndarray, other: np.ndarray) -> int:
    """Leading places where both arrays are equal, compared in growing chunks."""
    done, chunk, n = 0, CHUNK, min(len(same), len(other))
    while done < n:
        stop = min(n, done + chunk)
        differ = same[done:stop] != other[done:stop]
        if differ.any():
            return done + int(differ.argmax())
        done, chunk = stop, 2 * chunk
    return n


def find(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of the sequence ``ids`` by start, then period: maximal, at least
    ``least`` long and twice as long as its smallest period."""
    n, runs = len(ids), []
    covers: dict[int, list[tuple[int, int, int]]] = {}  # by the next multiple of their period
    for first, last in _blocks(n, n // 2 if n >= least else 0):
        period, at = _grid(first, last, n)
        equal = np.flatnonzero(ids[at] == ids[at + period])
        equal = equal[_promising(ids, period[equal], at[equal], least)]
        period, at = period[equal], at[equal]
        if not len(at) and not covers:
            continue
        cuts = np.searchsorted(period, np.arange(first, last + 2)).tolist()
        for p in range(first, last + 1):
            within = covers.pop(p, [])
            for run in within:
                if p + run[2] < run[1] - run[0]:
                    covers.setdefault(p + run[2], []).append(run)
            points = at[cuts[p - first] : cuts[p - first + 1]]
            if within and len(points):  # no two of them hold the same pair, or they were one run
                begin, end = np.array(sorted(r[:2] for r in within)).T
                last_before = np.searchsorted(begin, points, "right") - 1
                points = points[(last_before < 0) | (points + p >= end[last_before])]
            stop = -1
            for x in points.tolist():
                if x < stop:
                    continue
                right = x + _reach(ids[x : n - p], ids[x + p :])
                left = x - _reach(ids[:x][::-1], ids[p : x + p][::-1])
                stop = right
                if right - left >= max(least - p, p):
                    runs.append((left, right - left + p, p))
                    if 2 * p < right - left + p:
                        covers.setdefault(2 * p, []).append((left, right + p, p))
    return sorted((a, length, p) for a, length, p in runs)


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, text``: the runs of each text by start, then period, and the text's words, each run cut to its first
    period, joined by single spaces. Words are split at space and 0x09 to 0x0D."""
    if least < 2:
        raise ValueError("a run has at least two words")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, left = [], [], []
            for text in batch.column("text"):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                found = find(numbered(words), least)
                stay = [w for w, k in zip(words, kept(len(words), found).tolist(), strict=True) if k] if found else words
                n_words.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                left.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, RUNS), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")


def made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of one text in ten, by the ``doc_id``'s CRC, the words after a place that the CRC names become repeats
    of the first few of them. Other texts, and rows without ``doc_id``, stay as they are."""
    docs = texts(docs)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, chosen = F.floor(h / 10), F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = docs.withColumn("w", F.when(chosen, words)).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    changed = changed.withColumn("p", F.when(F.col("n") > 0, F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8))))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("w", source(i))), " ")
    return changed.select("doc_id", F.when(F.coalesce(F.col("n") > 0, F.lit(False)), text).otherwise(F.col("text")).alias("text"))
