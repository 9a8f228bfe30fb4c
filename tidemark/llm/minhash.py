"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

A document's set has its distinct shingles of ``SHINGLE`` lower-cased words. One hash of each shingle fills
``SLOTS`` slots (the least value in each); empty slots copy from a filled one by a fixed random preference of
their own (optimal densification). Documents of equal sets are one class; class representatives that agree on
a band share a bucket. In each bucket the member with the most bucket mates becomes the centre of a star of
candidates, whose similarity is taken from full sets; a centre's stars are its family.

A family that still spans several components is compared once more, exactly and without all its pairs: two
similar documents have one of their rarest shingles in common (prefix filter), and from the first one that they
have in common on each must have enough shingles left for the overlap (positional filter).

Defined cases: null and empty texts have an empty set and link with nothing; fewer than ``SHINGLE`` words
are one shingle; documents of equal sets always link; a component's id is its least ``doc_id``; repeated rows
get equal results; of rows with one ``doc_id`` and different texts each gets the component of its own text;
columns besides ``doc_id`` and ``text`` are ignored by ``near_duplicates`` and kept by ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, texts, written
from .components import components

#: Words in a shingle; slots of a signature; slots in a band.
SHINGLE = 5
SLOTS = 256
BAND = 8
#: Documents link from this similarity on, in hundredths.
SIMILARITY = 85
#: Documents that one task takes of those with a rare shingle in common.
SHARE = 256

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Place of each slot in the preference order of each empty slot.
_PREFERENCE = np.argsort(np.random.default_rng(1).random((SLOTS, SLOTS)), axis=1).astype(np.int16)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a set that isn't empty; ``hashes`` are sorted."""
    mixed = np.sort(hashes * _FACTOR ^ (hashes >> np.uint64(31)))
    slot = (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(slot, return_index=True)
    out = np.zeros(SLOTS, np.uint64)
    out[filled] = mixed[first]
    if len(filled) < SLOTS:
        empty = np.setdiff1d(np.arange(SLOTS), filled, assume_unique=True)
        out[empty] = out[filled[_PREFERENCE[empty][:, filled].argmin(1)]]
    return out


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = signature(hashes).reshape(-1, BAND)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for k in range(BAND):
        key = (key ^ rows[:, k]) * _FACTOR
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, print, bands``; ``print`` identifies the set. Narrow: no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                s = shingles(text)
                rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(s) if len(s) else []))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "print", "bands"])

    return texts(docs).mapInPandas(frugal(run), "doc_id long, n_shingles long, print binary, bands array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``kind`` (tells texts of one ``doc_id`` apart), ``shingles``: the full set of each document."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shingles(t).view(np.int64) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "kind": [xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in found], "shingles": found})

    return texts(docs).mapInPandas(frugal(run), "doc_id long, kind long, shingles array<long>").dropDuplicates(["doc_id", "kind"])


def overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """``a, b, shared, size_a, size_b, kind`` (of b) of pairs, from their full sets."""
    left = full.select(F.col("doc_id").alias("b"), "kind", F.col("shingles").alias("of_b"))
    right = full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    both = pairs.join(left, "b").join(right, "a")
    return both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("shared"), F.size("of_a").alias("size_a"), F.size("of_b").alias("size_b"), "kind")


def _similar(measured: DataFrame, similarity: int) -> DataFrame:
    return measured.where(100 * F.col("shared") >= similarity * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("a", "b").distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def _by_prefix(members: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """All pairs of one family's different components that can be similar. Shingles are put in an order that the family
    shares, rarest first. Of ``n`` shingles, two similar documents have one in common among the first
    ``n - similarity * n + 1``, and the first one they have in common leaves each enough shingles for the overlap."""
    own = members.where("doc != centre").select("centre", "doc", "kind", "component", "n").distinct()  # stars have the centre's pairs
    apart = own.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("centre")
    own = own.join(apart, "centre")
    rows = written(own.join(full.withColumnRenamed("doc_id", "doc"), ["doc", "kind"]).select("centre", "doc", "kind", "component", "n", F.explode("shingles").alias("shingle")), "family-shingles")
    counts = rows.groupBy("centre", "shingle").agg(F.count("*").alias("k"))
    # One document's shingles: bounded by its text.
    place = F.row_number().over(Window.partitionBy("centre", "doc", "kind").orderBy("k", "shingle"))
    first = rows.join(counts, ["centre", "shingle"]).withColumn("left", F.col("n") - place + 1).where(100 * F.col("left") >= similarity * F.col("n"))
    first = written(first.where("k > 1").drop("k"), "prefixes")
    groups = first.groupBy("centre", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k")).where("low < high")
    first = first.join(groups.select("centre", "shingle", F.ceil(F.col("k") / SHARE).alias("parts")), ["centre", "shingle"])
    one = first.select("centre", "shingle", F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"), F.col("doc").alias("x"), F.col("component").alias("own"), F.col("n").alias("m"), F.col("left").alias("rest"))
    other = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    enough = (100 + similarity) * F.least("rest", "left") >= similarity * (F.col("n") + F.col("m"))
    return one.join(other, ["centre", "shingle", "part"]).where((F.col("x") < F.col("doc")) & (F.col("own") != F.col("component")) & enough).select("x", F.col("doc").alias("y"))


def linked(docs: DataFrame, buckets: DataFrame, similarity: int) -> DataFrame:
    """``node, component`` of the representatives that link; ``buckets`` has ``bucket, doc`` and no lone members."""
    members = buckets.select("doc").distinct()
    full = written(sets(docs.join(members.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")), "sets")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    mates = buckets.join(sizes, "bucket").groupBy("doc").agg(F.sum("n").alias("mates"))
    centres = written(buckets.join(mates, "doc").groupBy("bucket").agg(F.max_by("doc", F.struct("mates", -F.col("doc"))).alias("a")), "centres")
    star = buckets.join(centres, "bucket").select("a", F.col("doc").alias("b")).where("a != b").distinct()
    measured = written(overlaps(star, full), "measured")
    links = written(_similar(measured, similarity), "links")
    found = written(components(links), "components")
    family = measured.select(F.col("a").alias("centre"), F.col("b").alias("doc"), "kind", F.col("size_b").alias("n"))
    placed = family.join(found, family["doc"] == found["node"], "left").select("centre", "doc", "kind", "n", F.coalesce("component", "doc").alias("component"))
    spread = placed.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("centre")
    rest = written(_pairs(_by_prefix(placed.join(spread, "centre"), full, similarity)), "pairs")
    more = written(_similar(overlaps(rest, full), similarity), "links")
    return found if more.isEmpty() else written(components(links.unionByName(more)), "components")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``."""
    made = written(signatures(docs), "signatures")
    some = made.where("n_shingles > 0")
    classes = written(some.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    firsts = classes.select(F.col("first").alias("doc_id"))
    rows = some.join(firsts, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), F.explode("bands").alias("bucket"))
    rows = rows.distinct()
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    buckets = written(rows.join(shared, "bucket"), "buckets")
    found = linked(docs, buckets, similarity)
    named = classes.join(found, classes["first"] == found["node"], "left").select("print", F.coalesce("component", "first").alias("component_id"))
    named = written(named, "named")
    out = made.join(named, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def distinct_documents(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without the rows of documents that aren't their component's first; all columns stay."""
    gone = near_duplicates(docs, similarity).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
