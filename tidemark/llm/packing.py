"""Packing of tokenised documents into fixed-length training sequences.

Documents are tokenised and cut into pieces of at most ``SEQUENCE`` tokens. Only the histogram of piece
lengths (at most ``SEQUENCE`` rows, whatever the corpus) goes to the driver, where shortest-pack-first
places the lengths, longest first, and counts packing patterns. The patterns come back as one interval of
ranks for each place of a length in a pattern; pieces get their rank within their length by a distributed
prefix count, and look their interval up.

Defined cases: a null or empty text is the end token alone; every id lies in exactly one piece; equal
documents are packed each on their own, and so are repeated rows; an empty table packs to an empty one; no sequence is over length
and offsets in a sequence have no gaps.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, load_ranks, pretokens
from .common import bounded_batches, texts, written

#: Tokens in a full sequence.
SEQUENCE = 1024
#: Pieces of one length that one task ranks: a length is dealt to as many hash buckets as that takes.
BUCKET_ROWS = 50_000

#: Pre-tokens of these characters mean the same to both tokenizer libraries.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]+").fullmatch

_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str, ranks: str, pattern: str) -> Encoder:
    """Encoder of a ``tokenizers`` file whose vocabulary is also there as ranks, loaded once for each worker.

    Plain pre-tokens go through the rank file, which gives the same ids sooner; all others through the file itself.
    """
    if (tokenizer, ranks) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(tokenizer)
        exact.encode_special_tokens = True
        quick = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})

        def encode(words: list[str]) -> list[bytes]:
            out = []
            for word in words:
                ids = quick.encode_ordinary(word) if PLAIN(word) else exact.encode(word, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            return out

        _ENCODERS[tokenizer, ranks] = Encoder(pretokens(pattern), encode)
    return _ENCODERS[tokenizer, ranks]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, end_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """Each document's ids and the end id, cut every ``sequence`` tokens: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    bounded_batches(docs.sparkSession)
    end, step = struct.pack("<I", end_id), 4 * sequence

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks, pattern)
        for frame in frames:
            rows = []
            for doc, ids in zip(frame["doc_id"], encode(frame["text"].tolist()), strict=True):
                ids += end
                for a in range(0, len(ids), step):
                    part = ids[a : a + step]
                    rows.append((doc, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how often each is used; lengths are placed longest first.

    A length goes to the open packs with the most room; a group of equal packs takes it as a whole or is split in two.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_packs if open_packs[r] and r >= length), default=None)
            if room is None:
                pattern, count, kept = (), left, 0
                room = sequence
            else:
                pattern, there = open_packs[room].pop()
                count = min(there, left)
                kept = there - count
            if kept:
                open_packs[room].append((pattern, kept))
            grown = ((*pattern, length), count)
            (open_packs[room - length] if room > length else done).append(grown)
            left -= count
    return done + [p for packs in open_packs.values() for p in packs]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, first sequence id, offset): the pieces of a length fill them by rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out[length].append((used[length], base, offset))
            used[length] += count
            offset += length
        base += count
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """``cut`` with ``rank``: 0, 1, ... within each length. A length may hold most rows, so its rows are counted
    by hash bucket first and each bucket starts where those before it end."""
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))
    cut = cut.withColumn("bucket", bucket)
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length as l", "bucket as b", "sum(n) over (partition by length order by bucket) - n as before")
    own = cut.selectExpr("*", "row_number() over (partition by length, bucket order by doc_id, start) - 1 as own")
    joined = own.join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("rank", F.col("own") + F.col("before")).drop("l", "b", "bucket", "own", "before")


def pack(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``cut`` has ``doc_id, start, length`` and may have more columns."""
    cut = written(cut, "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `sequence` rows
    buckets = -(-max(histogram.values(), default=1) // BUCKET_ROWS)
    table = places(shortest_pack_first(histogram, sequence))
    shared = cut.sparkSession.sparkContext.broadcast(table)  # patterns over at most `sequence` lengths

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = np.zeros(len(frame), np.int64)
            offsets = np.zeros(len(frame), np.int64)
            lengths, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                spots = shared.value[length]
                at = np.searchsorted(spots[:, 0], rank[rows], "right") - 1
                ids[rows] = spots[at, 1] + rank[rows] - spots[at, 0]
                offsets[rows] = spots[at, 2]
            yield frame.drop(columns="rank").assign(sequence_id=ids, offset=offsets)

    fields = ", ".join(f"`{name}` {kind}" for name, kind in cut.dtypes)
    return ranked(cut, buckets).mapInPandas(look_up, f"{fields}, sequence_id long, offset long")
