"""Line dedup: lines that several documents have stay in one of them.

A line's key is the line without blanks (space, 0x09 to 0x0D) at both ends, A-Z in lower case. Each task sends the
64-bit hashes of its long keys, once a document, to the filter tile they belong to. A tile has two Bloom filters:
a hash already in the first (seen once) enters the second (seen twice). The first one never leaves its task; the second,
sized by the hashes in it, goes to all tasks and is folded in halves where all tiles together would pass
``MAX_BYTES``: that costs precision, not results. Only keys that it suspects are shuffled, as SHA-256 digests with their
document: those of at least ``least_documents`` documents are confirmed, and lose their lines except in
the largest ``doc_id``. Texts with a suspected line then meet their confirmed digests.

Defined cases: a null or empty text is one empty line; rows that share a ``doc_id`` are one document and are each
judged alike; rows without ``doc_id`` aren't counted and keep all lines; columns other than ``doc_id`` and
``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts, written

#: Lines that one tile of the filters is made for, and bits of its first filter.
TILE_LINES = 1 << 17
TILE_BITS = 1 << 21
#: Hashes a task gathers before it sends them to their tiles.
BUFFER = 1 << 20
#: Bits of the second filter for each hash in it, and bytes that all second filters together may take.
BITS_A_HASH = 16
MAX_BYTES = 64 << 20
#: Odd factors of the filters' three hash functions.
_FACTORS = tuple(np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(3))

FRAGMENT = "tile long, once binary, twice binary"


def key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes, both know ASCII only


def long_enough(key: bytes, least_chars: int) -> bool:
    """Whether ``key`` has ``least_chars`` code points, of one to four bytes each."""
    return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "replace")) >= least_chars)


def places(hashes: np.ndarray, bits: int | np.ndarray) -> list[np.ndarray]:
    """Positions in a filter of ``bits`` bits, a power of two. In one of half the size they are the same modulo its size."""
    low = np.asarray(bits, np.uint64) - np.uint64(1)
    return [((hashes * f) >> np.uint64(20) & low).astype(np.int64) for f in _FACTORS]


def _hashes(data: bytes, least_chars: int) -> set[int]:
    return {xxhash.xxh3_64_intdigest(k) for k in map(key, data.split(b"\n")) if long_enough(k, least_chars)}


def _fragments(docs: DataFrame, tiles: int, least_chars: int) -> DataFrame:
    """By tile, hashes that a task has seen in documents, and those that it has seen in more than one row."""

    def sent(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        tile = values % np.uint64(tiles)
        order = np.argsort(tile, kind="stable")
        values, counts, tile = values[order], counts[order], tile[order]
        names, begins = np.unique(tile, return_index=True)
        ends = [*begins[1:], len(tile)]
        for at in range(0, len(names), 10_000):
            cuts = [(values[a:b], counts[a:b] > 1) for a, b in zip(begins[at : at + 10_000], ends[at : at + 10_000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000].astype(np.int64)), pa.array([v.tobytes() for v, _ in cuts], pa.binary()), pa.array([v[m].tobytes() for v, m in cuts], pa.binary())], ["tile", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text in batch.column("text"):
                found = _hashes(text.as_py().encode("utf-8", "surrogatepass"), least_chars)
                if found:
                    parts.append(np.fromiter(found, np.uint64, len(found)))
                    held += len(found)
                if held >= BUFFER:
                    yield from sent(parts)
                    parts, held = [], 0
        if parts:
            yield from sent(parts)

    return docs.mapInArrow(run, FRAGMENT)


def _filters(fragments: DataFrame) -> DataFrame:
    """``tile, bits``: the second filter of each tile. A tile's fragments stream through its two filters."""

    def done(tile: int, again: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.unique(np.concatenate(again)) if again else np.zeros(0, np.uint64)
        bits = np.zeros(1 << max(6, int(len(hashes) * BITS_A_HASH - 1).bit_length()), bool)
        for at in places(hashes, len(bits)):
            bits[at] = True
        return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["tile", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, once, again = None, np.zeros(TILE_BITS, bool), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != tile:
                    if tile is not None:
                        yield done(tile, again)
                    tile, again = row[0], []
                    once[:] = False
                hashes = np.frombuffer(row[1], np.uint64)
                at = places(hashes, TILE_BITS)
                again += [hashes[once[at[0]] & once[at[1]] & once[at[2]]], np.frombuffer(row[2], np.uint64)]
                for x in at:
                    once[x] = True
        if tile is not None:
            yield done(tile, again)

    return fragments.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "tile long, bits binary")


def fold(bits: bytes, times: int) -> bytes:
    """A filter of ``2 ** times`` less bits, 64 at least, that holds the same hashes."""
    now = np.frombuffer(bits, np.uint8)
    while times and len(now) > 8:
        now, times = now[: len(now) // 2] | now[len(now) // 2 :], times - 1
    return now.tobytes()


class Twice:
    """The second filters of all tiles."""

    def __init__(self, tiles: int, rows: list[tuple[int, bytes]]) -> None:
        self.tiles, self.bits = tiles, np.frombuffer(b"".join(b for _, b in rows) or bytes(8), np.uint8)
        self.size, self.begin = np.zeros(tiles, np.int64), np.zeros(tiles, np.int64)
        at = 0
        for tile, bits in rows:
            self.size[tile], self.begin[tile] = 8 * len(bits), at
            at += len(bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        tile = (hashes % np.uint64(self.tiles)).astype(np.int64)
        size = self.size[tile]
        out = size > 0
        for at in places(hashes, np.maximum(size, 64)):
            out &= (self.bits[self.begin[tile] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def seen_twice(docs: DataFrame, least_chars: int) -> Twice:
    """A filter of the long keys that several documents have; ``docs`` has ``text`` without nulls."""
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + F.lit(1))).first()[0] or 0
    tiles = max(1, -(-n_lines // TILE_LINES))
    filters = written(_filters(_fragments(docs, tiles, least_chars)), "line-filters")
    size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    folds = max(0, -(-size // max(MAX_BYTES, 8 * tiles)) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(b, folds) for b in batch.column(1).to_pylist()], pa.binary())], ["tile", "bits"])

    rows = filters.mapInArrow(run, "tile long, bits binary").collect() if folds else filters.collect()
    return Twice(tiles, [(r["tile"], bytes(r["bits"])) for r in rows])


def _suspected(docs: DataFrame, twice: Twice, least_chars: int) -> DataFrame:
    """``doc_id, text, suspects``: the digests of a text's keys that the filter has, each once."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole = batch.column("doc_id"), batch.column("text")
            keys, owner = [], []
            for i, text in enumerate(whole):
                for k in {k for k in map(key, text.as_py().encode("utf-8", "surrogatepass").split(b"\n")) if long_enough(k, least_chars)}:
                    keys.append(k)
                    owner.append(i)
            hit = sent.value.has(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
            found: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for j in np.flatnonzero(hit).tolist():
                found[owner[j]].append(sha256(keys[j]).digest())
            yield pa.RecordBatch.from_arrays([ids, whole, pa.array(found, pa.list_(pa.binary()))], ["doc_id", "text", "suspects"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, suspects array<binary>")


def repeated_keys(suspects: DataFrame, least_documents: int) -> DataFrame:
    """``digest, last``: keys that so many documents have, and the largest ``doc_id`` among them."""
    by_key = suspects.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    return by_key.where(F.col("n") >= least_documents).select("digest", "last")


def _cut(rows: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of rows with ``text`` and the ``drop`` digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("text"), batch.column("drop").to_pylist(), strict=True):
                lines, gone = text.as_py().encode("utf-8", "surrogatepass").split(b"\n"), set(drop or ())
                stay = [x for x in lines if sha256(key(x)).digest() not in gone] if gone else lines
                kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return rows.select("doc_id", "text", "drop").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long")


def without_repeated_lines(docs: DataFrame, least_documents: int = 3, least_chars: int = 20) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: the texts without the lines that a later document has, too, the lines before
    and those dropped. Keys of fewer than ``least_chars`` code points or ``least_documents`` documents stay."""
    if least_documents < 2 or least_chars < 1:
        raise ValueError("a repeated line has at least one character and two documents")
    bounded_batches(docs.sparkSession)
    docs = texts(docs)
    probed = written(_suspected(docs, seen_twice(docs, least_chars), least_chars), "line-suspects")
    suspects = probed.select("doc_id", F.explode("suspects").alias("digest"))
    keys = written(repeated_keys(suspects, least_documents), "line-keys")
    drop = suspects.join(keys, "digest").where("doc_id <> last").groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))
    clean = probed.where("size(suspects) = 0").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("drop"))
    rest = probed.where("size(suspects) > 0").select("doc_id", "text").join(drop, "doc_id", "left")
    return _cut(clean.unionByName(rest))
