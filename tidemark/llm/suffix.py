"""Passages that repeat across documents, by sparse suffixes at content-selected positions.

Only suffixes at content-selected positions are kept: those where a word's ``GRAM``-gram has the least hash of
``WORDS - GRAM + 1`` neighbours in a row. Each window of ``WORDS`` words has one such suffix, its leftmost, and
equal windows have equal ones at equal places. The windows of one suffix follow each other: they are a run.

Suffixes are bucketed by gram. Buckets of one document have no repeat; where all runs of a bucket are equal, all
their windows are. Of the other buckets each distinct run is a suffix of the array, once, with its least and
greatest document. They are sorted by the words from the suffix on, and neighbours are compared: the suffixes that
share a window's words from its suffix on are an interval of this order, bounded by shorter common prefixes. They
are sorted by the words before as well, last word first: those that share a window's words before its suffix are an
interval of that order. So a match extends to the right by one interval and to the left by the other, and two
windows are equal where both are. Neighbours in one order alone would miss windows that suffixes further apart
share. Both orders are range-partitioned; intervals go across partitions by the first and last words of each.

Words are runs of characters other than blanks and are compared as they are, by 64-bit hashes of words; equal runs
are told by 64-bit hashes beside their gram's. Word positions count from 0, ends are exclusive.

Defined cases: null and empty texts and those of fewer than ``WORDS`` words have no spans; repeats within one
document alone don't count; rows with one ``doc_id`` are one document; of a window's occurrences those in
the document of least id are the first, all others are repeats; columns besides ``doc_id`` and ``text`` are
ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bounded_batches, frugal, texts, written

#: Least words of a repeated passage, words of a gram.
WORDS = 50
GRAM = 8
#: Words that may stand before a suffix in its windows, 0 to this less one; suffixes of a range, at most (about).
BEFORE = WORDS - GRAM + 1
RANGE = 100_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile("[^\x20\x09-\x0d]+").finditer
#: Base of the hashes of word sequences (odd) and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the 0 to n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Sequences:
    """Hashes of stretches of one document's words; equal stretches have equal ones wherever they are."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_BASE, n), dtype=np.uint64)])
        self.back = powers(_INVERSE, n + 1)

    def hashed(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = (self.sums[stop] - self.sums[begin]) * self.back[begin]
        return ((out ^ (out >> np.uint64(32))) * _FACTOR).view(np.int64)


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - GRAM + 1
    gram = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        gram = (gram ^ hashes[k : n + k]) * _FACTOR
        gram ^= gram >> np.uint64(29)
    return gram


def runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A document's windows by their selected suffixes: gram hash, hash of the run's words, first window, windows."""
    n = len(hashes) - GRAM + 1
    reach = WORDS - GRAM + 1
    if n < reach:
        return (np.zeros(0, np.int64),) * 4
    gram = gram_hashes(hashes)
    best = gram.copy()  # least hash of the next 2^k grams, doubled up to the reach
    width = 1
    while 2 * width <= reach:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    least = np.minimum(best[: n - reach + 1], best[reach - width : n - width + 1])
    # A window's suffix is the first of its least hash.
    at = np.flatnonzero(np.isin(gram, least))
    starts = np.searchsorted(at, np.arange(len(least)))
    while (wrong := gram[at[starts]] != least).any():
        starts = starts + wrong
    place = at[starts]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    windows = np.diff(begin, append=len(place))
    return gram[place[begin]].view(np.int64), Sequences(hashes).hashed(begin, begin + windows - 1 + WORDS), begin, windows


def suffixes(docs: DataFrame) -> DataFrame:
    """``doc_id, gram, run, begins, windows``: each document's distinct runs of windows with their places. Narrow: no
    shuffle; text that repeats itself gives one row, however often it does."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [runs(word_hashes(t)) for t in batch.column("text").to_pylist()]
            doc = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
            gram, key, begin, count = (np.concatenate([m[k] for m in made] or [np.zeros(0, np.int64)]) for k in range(4))
            order = np.lexsort((begin, key, gram, doc))
            doc, gram, key, begin, count = (x[order] for x in (doc, gram, key, begin, count))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            begins = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(begin, pa.int32()))
            columns = [batch.column("doc_id").take(pa.array(doc[first])), pa.array(gram[first]), pa.array(key[first]), begins, pa.array(count[first], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "gram", "run", "begins", "windows"])

    return texts(docs).mapInArrow(frugal(run), "doc_id long, gram long, run long, begins array<int>, windows int")


def contexts(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The words of each distinct run: ``gram, run, low, high, after, before``. ``after`` holds the words from the suffix
    on, ``before`` those before it, last word first, eight bytes each. ``kinds`` has a place (``at``) for each."""
    bounded_batches(docs.sparkSession)
    one = F.struct("gram", "run", "low", "high", "at.begin", "at.windows")
    places = kinds.groupBy("at.doc_id").agg(F.collect_list(one).alias("places"))  # bounded by the document's words
    joined = texts(docs).join(places, "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, places in zip(frame["text"], frame["places"], strict=True):
                hashes = word_hashes(text)
                sequences, n = Sequences(hashes), len(hashes)
                gram, key, begin, count = (np.array([p[name] for p in places], np.int64) for name in ("gram", "run", "begin", "windows"))
                stop = begin + count - 1 + WORDS
                # Another text of the same doc_id may not have the run there.
                has = stop <= n
                has[has] = sequences.hashed(begin[has], stop[has]) == key[has]
                grams, words = gram_hashes(hashes).view(np.int64), hashes.astype(">u8")
                for k in np.flatnonzero(has):
                    # The suffix of a run's first window is the first one with that gram.
                    at = begin[k] + int(np.argmax(grams[begin[k] : begin[k] + BEFORE] == gram[k]))
                    rows.append((gram[k], key[k], places[k]["low"], places[k]["high"], words[at : stop[k]].tobytes(), words[begin[k] : at][::-1].tobytes()))
            yield pd.DataFrame(rows, columns=["gram", "run", "low", "high", "after", "before"])

    return joined.mapInPandas(frugal(run), "gram long, run long, low long, high long, after binary, before binary")


def common_words(bucket: np.ndarray, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words that each sequence (``words[begin[i]:begin[i + 1]]``) has in common with the one before; -1: another bucket."""
    size = np.diff(begin)
    limit = np.minimum(size[1:], size[:-1])
    out = np.where(bucket[1:] == bucket[:-1], 0, -1)
    left = np.flatnonzero(out == 0)
    for d in range(WORDS):
        left = left[limit[left] > d]
        left = left[words[begin[left] + d] == words[begin[left + 1] + d]]
        out[left] = d + 1
    return out


def intervals(common: np.ndarray, needs: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of sorted sequences that share ``needs[o]`` words, for each ``o`` from ``least`` to ``most``: pieces
    ``(sequence, first o, begin, end)`` sorted by the first two, -1 where an interval goes beyond the sequences at hand;
    then the first and the last break at each ``o`` (-1: none)."""
    n = len(least)
    place, begin, end = np.arange(n), np.full(n, -2), np.full(n, -2)
    pieces, first, last = [], np.full(len(needs), -1), np.full(len(needs), -1)
    for o, need in enumerate(needs):
        breaks = np.flatnonzero(common < need) + 1
        if len(breaks):
            first[o], last[o] = breaks[0], breaks[-1]
        which = np.searchsorted(breaks, place, "right")
        b = np.concatenate([[-1], breaks])[which]
        e = np.concatenate([breaks - 1, [-1]])[which]
        new = (least <= o) & (o <= most) & ((b != begin) | (e != end) | (least == o))
        at = np.flatnonzero(new)
        pieces.append((at, np.full(len(at), o), b[at], e[at]))
        begin, end = b, e
    item, start, b, e = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.lexsort((start, item))
    return item[order], start[order], b[order], e[order], first, last


#: What stays of a partition's order: its first and last sequence and the breaks within.
_EDGE = "struct<n:long, first_bucket:long, last_bucket:long, first_words:binary, last_words:binary, first:array<long>, last:array<long>>"
_ORDER = f"part int, edge {_EDGE}, starts array<int>, begins array<long>, ends array<long>"


def ordered(items: DataFrame, words: str, needs: np.ndarray, keep: str, ranges: int) -> DataFrame:
    """``items`` sorted by gram and ``words``, neighbours compared: columns ``keep`` (a schema), ``part`` and the
    intervals as ``starts, begins, ends``; beside them one row a partition with its ``edge``."""
    names = [x.split()[0] for x in keep.split(", ")]
    schema = f"{keep}, {_ORDER}"
    # Distinct runs tell equal words apart, so that any number of these split into ranges.
    by_words = items.repartitionByRange(ranges, "gram", words, "run").sortWithinPartitions("gram", words, "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [batch for batch in batches if batch.num_rows]  # a range: bounded
        if not filled:
            return
        made = pa.Table.from_batches(filled).combine_chunks()
        part = TaskContext.get().partitionId()
        cells = made.column(words).to_pylist()
        bucket = made.column("gram").to_numpy()
        begin = np.concatenate([[0], np.cumsum([len(c) // 8 for c in cells])])
        common = common_words(bucket, np.frombuffer(b"".join(cells), np.uint64), begin)
        least, most = made.column("least").to_numpy(), made.column("most").to_numpy()
        item, start, b, e, first, last = intervals(common, needs, least, most)
        base = part << 40
        b, e = (np.where(x < 0, -1, x + base) for x in (b, e))
        offsets = pa.array(np.searchsorted(item, np.arange(len(cells) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((start, pa.int32()), (b, pa.int64()), (e, pa.int64()))]
        edge = {"n": len(cells), "first_bucket": int(bucket[0]), "last_bucket": int(bucket[-1]), "first_words": cells[0], "last_words": cells[-1], "first": first.tolist(), "last": last.tolist()}
        kind = pa.struct([("n", pa.int64()), ("first_bucket", pa.int64()), ("last_bucket", pa.int64()), ("first_words", pa.binary()), ("last_words", pa.binary()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])
        kept = made.select(names)
        columns = [*kept.columns, pa.array(np.full(len(cells), part), pa.int32()), pa.nulls(len(cells), kind), *lists]
        table = pa.table(columns, names=[*names, "part", "edge", "starts", "begins", "ends"])
        yield from table.to_batches(max_chunksize=BATCH_ROWS)
        empty = [pa.nulls(1, f.type) for f in table.schema]
        empty[len(names)], empty[len(names) + 1] = pa.array([part], pa.int32()), pa.array([edge], kind)
        yield pa.RecordBatch.from_arrays(empty, names=table.schema.names)

    return by_words.mapInArrow(frugal(run), schema)


def carried(order: DataFrame, needs: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each partition of ``ordered``, where the intervals that go beyond it begin and end, by ``o``. Its edges are a
    row a partition."""
    edges = order.where("edge is not null").select("part", "edge.*").orderBy("part").collect()
    rank = lambda e, place: (e["part"] << 40) + place
    shared = []
    for a, b in zip(edges, edges[1:], strict=False):
        words = np.frombuffer(bytes(a["last_words"]) + bytes(b["first_words"]), np.uint64)
        begin = np.array([0, len(a["last_words"]) // 8, len(words)])
        shared.append(common_words(np.array([a["last_bucket"], b["first_bucket"]]), words, begin)[0])
    out = {}
    begins = ends = None
    for k, e in enumerate(edges):
        here = np.full(len(needs), rank(e, 0))
        if k:
            before, last = edges[k - 1], np.array(edges[k - 1]["last"])
            here = np.where(shared[k - 1] < needs, here, np.where(last >= 0, rank(before, last), begins))
        begins = here
        out[e["part"]] = (begins, None)
    for k in reversed(range(len(edges))):
        e = edges[k]
        here = np.full(len(needs), rank(e, e["n"] - 1))
        if k + 1 < len(edges):
            after, first = edges[k + 1], np.array(edges[k + 1]["first"])
            here = np.where(shared[k] < needs, here, np.where(first >= 0, rank(after, first - 1), ends))
        ends = here
        out[e["part"]] = (out[e["part"]][0], ends)
    return out


def spread(batch: pa.RecordBatch, names: tuple[str, str, str], most: np.ndarray, part: np.ndarray, carry: dict | None) -> tuple[np.ndarray, ...]:
    """A batch's intervals for each ``o``: ``(row, o, begin, end)``; those beyond a partition come from ``carry``."""
    starts, begins, ends = (batch.column(n) for n in names)
    row = np.repeat(np.arange(batch.num_rows), starts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    start, b, e = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, begins, ends))
    stop = np.append(start[1:], 0)
    final = np.append(row[1:] != row[:-1], True)
    stop[final] = most[row[final]] + 1
    size = stop - start
    o = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
    row, b, e = (np.repeat(x, size) for x in (row, b, e))
    for p in np.unique(part) if carry is not None else ():
        mine = part[row] == p
        for x, known in zip((b, e), carry[int(p)], strict=True):
            beyond = mine & (x < 0)
            x[beyond] = known[o[beyond]]
    return row, o, b, e


def matches(items: DataFrame, ranges: int) -> DataFrame:
    """``gram, run, first, last, low, high, after_begin, after_end, before_begin, before_end``: the windows of each run,
    from the ``first``-th to the ``last``-th, by their intervals in both orders. Windows that no other run has are left
    out unless the run itself is in several documents."""
    o = np.arange(BEFORE)
    after_needs, before_needs = WORDS - o, o
    keep = "gram long, run long, low long, high long, least int, most int"
    right = written(ordered(items, "after", after_needs, f"{keep}, before binary", ranges), "by-words-after")
    carry = carried(right, after_needs)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, most, part = (batch.column(n).to_numpy() for n in ("low", "high", "most", "part"))
            row, o, b, e = spread(batch, ("starts", "begins", "ends"), most, part, carry)
            stays = low < high
            stays[row[b != e]] = True
            change = np.ones(len(row), bool)
            change[1:] = (row[1:] != row[:-1]) | (b[1:] != b[:-1]) | (e[1:] != e[:-1])
            change &= stays[row]
            take = np.flatnonzero(stays)
            kept = batch.select(["gram", "run", "low", "high", "least", "most", "before"]).take(pa.array(take))
            offsets = pa.array(np.searchsorted(row[change], np.append(take, batch.num_rows)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[change], kind)) for x, kind in ((o, pa.int32()), (b, pa.int64()), (e, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists], names=[*kept.schema.names, "after_starts", "after_begins", "after_ends"])

    lists = "after_starts array<int>, after_begins array<long>, after_ends array<long>"
    resolved = right.where("edge is null").drop("edge").mapInArrow(frugal(resolve), f"{keep}, before binary, {lists}")
    left = written(ordered(resolved, "before", before_needs, f"{keep}, {lists}", ranges), "by-words-before")
    carry_left = carried(left, before_needs)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, most, part = (batch.column(n).to_numpy() for n in ("low", "high", "most", "part"))
            _, _, *after = spread(batch, ("after_starts", "after_begins", "after_ends"), most, part, None)
            row, o, *before = spread(batch, ("starts", "begins", "ends"), most, part, carry_left)
            same = np.zeros(len(row), bool)
            same[1:] = row[1:] == row[:-1]
            for x in (*after, *before):
                same[1:] &= x[1:] == x[:-1]
            first = np.flatnonzero(~same)
            final = np.append(first[1:], len(row))[: len(first)] - 1
            alone = (after[0] == after[1]) | (before[0] == before[1])
            keep = ~alone[first] | (low < high)[row[first]]
            first, final = first[keep], final[keep]
            at = row[first]
            columns = [batch.column("gram").to_numpy()[at], batch.column("run").to_numpy()[at], most[at] - o[final], most[at] - o[first], low[at], high[at], *(x[first] for x in (*after, *before))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=_MATCH)

    return left.where("edge is null").drop("edge").mapInArrow(frugal(combine), ", ".join(f"{n} long" for n in _MATCH))


_CLASS = ["after_begin", "after_end", "before_begin", "before_end"]
_MATCH = ["gram", "run", "first", "last", "low", "high", *_CLASS]


def stretches(docs: DataFrame) -> DataFrame:
    """``doc_id, begins, low, high, first_doc_id``: at each of ``begins``, the windows from the ``low``-th to the
    ``high``-th all occur in other documents and for the first time in ``first_doc_id``."""
    every = written(suffixes(docs), "suffixes")
    grams = every.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("run").alias("a"), F.max("run").alias("b"))
    grams = written(grams.where("low < high").select("gram", "low", (F.col("a") != F.col("b")).alias("mixed")), "grams")
    kept = written(every.join(grams, "gram"), "kept")
    same = kept.where("not mixed").select("doc_id", "begins", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"), F.col("low").alias("first_doc_id"))
    mixed = kept.where("mixed").drop("low", "mixed")
    at = F.min(F.struct("doc_id", F.col("begins")[0].alias("begin"), "windows"))
    kinds = written(mixed.groupBy("gram", "run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), at.alias("at")), "kinds")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), kinds.count() // RANGE + 1)
    items = contexts(docs, kinds).withColumn("least", F.lit(WORDS) - (F.length("after") / 8).cast("int")).withColumn("most", (F.length("before") / 8).cast("int"))
    found = written(matches(written(items, "contexts"), ranges), "matches")
    shared = written(found.groupBy(_CLASS).agg(F.min("low").alias("first_doc_id"), F.max("high").alias("last_doc_id")).where("first_doc_id < last_doc_id").drop("last_doc_id"), "shared")
    named = found.join(shared, _CLASS).select("gram", "run", F.col("first").cast("int").alias("low"), F.col("last").cast("int").alias("high"), "first_doc_id")
    # Windows of one run that follow each other and have the same first document are one part of it.
    ahead = Window.partitionBy("gram", "run", "first_doc_id").orderBy("low")
    fresh = F.when(F.col("low") > F.lag("high").over(ahead) + 1, 1).otherwise(0)
    parts = named.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(ahead)).groupBy("gram", "run", "first_doc_id", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    parts = written(parts.drop("island"), "parts")
    return same.unionByName(mixed.join(parts, ["gram", "run"]).select("doc_id", "begins", "low", "high", "first_doc_id"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (begin, stop) as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame) -> DataFrame:
    """One row a span: ``doc_id, start, stop`` (words), ``n_words, first_doc_id, repeat`` (false: the first occurrence).

    Spans of one first document are merged; those of different ones may overlap.
    """
    # A document's stretches: bounded by its words.
    lists = stretches(docs).groupBy("doc_id").agg(F.collect_set(F.struct("begins", "low", "high", "first_doc_id")).alias("spans"))
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, spans in frame.itertuples(index=False, name=None):
                by_first: dict[int, list[tuple[int, int]]] = {}
                for s in spans:
                    by_first.setdefault(s["first_doc_id"], []).extend((int(b) + s["low"], int(b) + s["high"] + WORDS) for b in s["begins"])
                rows += [(doc, a, b, b - a, first, doc != first) for first, own in by_first.items() for a, b in merged(own)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "n_words", "first_doc_id", "repeat"])

    return lists.mapInPandas(frugal(run), "doc_id long, start long, stop long, n_words long, first_doc_id long, repeat boolean")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (sorted, apart) and the blanks that follow them."""
    words = [m.span() for m in _WORD(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : words[a][0]])
        done = words[b][0] if b < len(words) else len(text)
    return ("".join(out) + text[done:]) if spans else text


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` but for each one's first occurrence; ``n_chars``, if there, is
    counted anew. Documents that lose all their words go. A word is cut only if an earlier document has a window around
    it, so one copy of each stays."""
    spans = repeats(docs).where("repeat").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("cuts"))

    @F.pandas_udf("string")
    def apply(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if c is None or t is None else cut(t, merged([(s["start"], s["stop"]) for s in c])) for t, c in zip(text, cuts, strict=True)], dtype=object)

    # Further columns travel in a struct, whatever their names.
    whole = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    joined = whole.join(spans, "doc_id", "left")
    # Python gets the texts only that lose something.
    left = joined.withColumn("left", apply(F.when(F.col("cuts").isNotNull(), F.col("text")), "cuts"))
    out = left.where(F.col("cuts").isNull() | F.col("left").rlike("[^\\x20\\x09-\\x0D]"))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.col("left"))
    n_chars = F.when(F.col("cuts").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long")) if "n_chars" in docs.columns else None
    made = {"text": text, "n_chars": n_chars}
    return out.select(*(made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
