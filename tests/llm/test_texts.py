"""Training-data operators against brute force on small fixtures, edge cases included."""

import base64
import hashlib
import random
import re
import struct
import textwrap
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, licenses, media, minhash, packing, pii, quality, rules, suffix, toxicity
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, bands int, score double"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\n \t", "a", "word " * 3000, "x" * 5000, "Ünïcödé  　 日本語 😀\r\n", "\x00\x1c\x85", "don't  stop", "don't  stop", "one two three four", "0" * 3000, "a@" * 500, "<|endoftext|> it"]


def frame(spark, texts, first=0):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(first + i, t, "en", "s", None if t is None else len(t), "clash", 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_doc(df):
    return {r["doc_id"]: r for r in df.collect()}


# byte-level BPE


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "1", "²", "Ⅷ", "'s", "'ll", "!?", "\xa0", "　", "\x1c", "\x85", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_is_the_library(spark, odd):
    lib, codec = library(MULTI), bpe.codec(MULTI, PATTERN)
    texts = [t or "" for t in ODD] + fuzz(800)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    got = by_doc(bpe.round_trip(odd, MULTI, PATTERN))
    for i, text in enumerate(ODD):
        ids = lib.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_tree_alone(spark):
    ranks = bpe.load_ranks(MULTI)
    one, many, lib = bpe.Merger(ranks), bpe.Forest(ranks), library(MULTI)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeést ") for _ in range(rng.randint(2, 30))).encode()[:60] for _ in range(500)]
    for word, packed in zip(words, many.encode(words), strict=True):
        if word not in ranks:
            assert np.frombuffer(packed, "<u4").tolist() == one.encode(word) == lib._encode_single_piece(word)


def test_bpe_frames(spark, odd, empty):
    ids = bpe.encode(odd, MULTI, PATTERN)
    assert {d: bytes(r["decoded"]) for d, r in by_doc(bpe.decode(ids, MULTI, PATTERN)).items()} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.round_trip(empty, MULTI, PATTERN).count() == 0


# personal data


def base_spans(text):
    """The base rules straight from their patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_pii_base_rules():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-1234", "+", "12", ".", "-", " ", "é", "日", "%_", "5500005555555559"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = [f"{k}:{a}:{b}" for a, k, b in pii.spans(text) if k in pii.BASE]
        assert got == base_spans(text)


def test_pii_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88 3704 0044 0532 0130 00")
    assert [k for _, k, _ in pii.spans("pay to DE89 3704 0044 0532 0130 00 now")] == ["iban"]
    assert [k for _, k, _ in pii.spans("wallet 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")] == ["btc"]
    assert pii.spans("part 123-45-6789") == [] and [k for _, k, _ in pii.spans("SSN 123-45-6789")] == ["ssn"]
    assert pii.spans("SSN in our tracking number 123-45-6789") == []
    assert pii.spans("serial number DE89 3704 0044 0532 0130 00") == [] and [k for _, k, _ in pii.spans("IBAN, not the serial number: DE89 3704 0044 0532 0130 00")] == ["iban"]
    assert pii.spans("commit hash 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") == []


def test_pii_frames(spark, odd, empty):
    docs = frame(spark, [*ODD, "mail me@x.example.com or 10.0.0.1, 😀 then +1 (555) 010-1234"])
    got = by_doc(pii.digests(pii.find(docs)))
    for i, text in enumerate([r["text"] for r in docs.orderBy("doc_id").collect()]):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base_spans(text or "")).encode()).hexdigest()
    last = got[len(ODD)]
    assert (last["n_email"], last["n_ip"], last["n_card"], last["n_phone"]) == (1, 1, 0, 1)
    masked = by_doc(pii.mask(docs))
    assert masked[len(ODD)]["text"] == "mail [EMAIL] or [IP], 😀 then [PHONE]" and masked[0]["text"] is None
    assert masked[len(ODD)]["n_chars"] == len(masked[len(ODD)]["text"]) and pii.mask(docs).columns == docs.columns
    assert pii.find(empty).count() == 0 and pii.mask(empty).count() == 0


# packing


def check_packing(docs, df):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    rows = df.collect()
    for doc, text in ((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) and all(r["doc_tokens"] == len(ids) for r in mine)
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return seqs


def test_packing(spark, odd, empty):
    docs = odd.unionByName(frame(spark, [" ".join(f"w{i}" for i in range(n)) for n in range(1, 400, 7)] + ["hi"] * 40, 100))
    seqs = check_packing(docs, packing.pack(packing.pieces(docs, JSON, RANKS, PATTERN)))
    used = sum(length for parts in seqs.values() for _, length in parts)
    assert len(seqs) <= used / 1024 + 2
    assert packing.pack(packing.pieces(empty, JSON, RANKS, PATTERN)).count() == 0


def test_packing_encoder_is_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    texts = fuzz(800, 9) + [t or "" for t in ODD]
    for text, ids in zip(texts, packing.encoder(JSON, RANKS, PATTERN)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_shortest_pack_first():
    rng = np.random.default_rng(0)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 1025), 300, replace=False), rng.integers(1, 50, 300), strict=True)}
    patterns = packing.shortest_pack_first(histogram)
    used = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 1024
        for length in pattern:
            used[length] = used.get(length, 0) + count
    assert used == histogram


# near-duplicates


def jaccard_components(texts, similarity=85):
    sets = [set(minhash.shingles(t or "").tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, [len(s) for s in sets]


def test_near_duplicates(spark):
    rng = random.Random(2)
    texts = list(ODD)
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 220))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    # Copies that link with the original only, each one with its own edits.
    hub = [f"h{i}" for i in range(300)]
    texts += [" ".join(hub)] + [" ".join("e" if j in (s, s + 50, s + 100) else w for j, w in enumerate(hub)) for s in range(5, 45, 2)]
    # A chain in which only neighbours link.
    texts += [" ".join(f"c{i}" for i in range(12 * s, 12 * s + 200)) for s in range(8)]
    want, sizes = jaccard_components(texts)
    got = by_doc(minhash.near_duplicates(frame(spark, texts)))
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    kept = minhash.distinct_documents(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(want) if w == i] and kept.columns == frame(spark, ["a"]).columns


def test_families_are_compared_to_the_end(spark):
    """In one bucket, two similar documents whose common shingles the centre lacks and many members hold."""
    texts, buckets = [], []
    for f in range(4):
        base = [f"t{f}.{i}" for i in range(160)] + [f"b{f}.{i}" for i in range(40)]
        edited = lambda places: " ".join(f"e{len(texts)}.{i}" if i in places else w for i, w in enumerate(base))  # noqa: B023, E731
        first = len(texts)
        texts.append(edited({20}))
        for k in range(20):
            texts.append(edited({7 + k, 40 + k, 65 + k, 90 + k, 115 + k}))
        texts.append(edited({130}))
        centre = len(texts)
        texts.append(" ".join(base[:160] + [f"h{f}.{i}" for i in range(40)]))
        texts += [f"lone {f} {i} x y z" for i in range(2)]
        buckets += [(10 * f, d) for d in range(first, centre + 1)] + [(10 * f + 1, centre), (10 * f + 1, centre + 1), (10 * f + 2, centre), (10 * f + 2, centre + 2)]
    want, _ = jaccard_components(texts)
    assert len(set(want)) == len(texts) - 4
    found = minhash.linked(frame(spark, texts), spark.createDataFrame(buckets, "bucket long, doc long"), 85).collect()
    assert {r["node"]: r["component"] for r in found} == {d: c for d, c in enumerate(want) if want.count(c) > 1}


def test_near_duplicates_of_nothing(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (4, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}


# repeated passages


def repeated_words(texts, n=50):
    where, words = {}, [(t or "").encode().split() for t in texts]
    for d, ws in enumerate(words):
        for i in range(len(ws) - n + 1):
            where.setdefault(tuple(ws[i : i + n]), []).append((d, i))
    out = [set() for _ in texts]
    for at in where.values():
        if len({d for d, _ in at}) > 1:
            for d, i in at:
                out[d].update(range(i, i + n))
    return out


def test_repeats(spark, empty):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 90, 300)]
    texts = list(ODD)
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(0, 80))]
            if rng.random() < 0.6:
                parts += rng.choice(passages)
        texts.append(" ".join(parts))
    texts += [" ".join(passages[0][:49])] * 2 + ["shti " * 300] * 2
    docs = frame(spark, texts)
    got = [set() for _ in texts]
    rows = suffix.repeats(docs).collect()
    for r in rows:
        got[r["doc_id"]].update(range(r["start"], r["stop"]))
    assert got == repeated_words(texts)
    left = by_doc(suffix.without_repeats(docs))
    assert not any(repeated_words([left[i]["text"] if i in left else "" for i in range(len(texts))]))
    assert left[0]["text"] is None and left[4]["text"] == "a" and suffix.without_repeats(docs).columns == docs.columns
    assert suffix.repeats(empty).count() == 0


def windows_by_first(texts, n=50):
    """Words by (document, first document) of the windows that several documents have, by comparing them all."""
    where, words = {}, [(t or "").split() for t in texts]
    for d, ws in enumerate(words):
        for i in range(len(ws) - n + 1):
            where.setdefault(tuple(ws[i : i + n]), []).append((d, i))
    out = {}
    for at in where.values():
        first = min(d for d, _ in at)
        if any(d != first for d, _ in at):
            for d, i in at:
                out.setdefault((d, first), set()).update(range(i, i + n))
    return out


def same_firsts(docs, texts):
    got = {}
    for r in suffix.repeats(docs).collect():
        assert r["repeat"] == (r["doc_id"] != r["first_doc_id"]) and r["n_words"] == r["stop"] - r["start"]
        got.setdefault((r["doc_id"], r["first_doc_id"]), set()).update(range(r["start"], r["stop"]))
    assert got == windows_by_first(texts)


def test_first_occurrence_is_of_the_passage(spark):
    """Passages that share a frequent line, and extents that differ around one line: one copy of each word stays."""
    rng = random.Random(14)
    fresh = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        line = fresh(12)
        one, two = (fresh(40) + line + fresh(40) for _ in range(2))
        texts += [fresh(5) + one, one + fresh(5), fresh(7) + two, two + fresh(3)]
        long = fresh(130)
        texts += [long[:80] + fresh(20), fresh(9) + long, fresh(4) + long + fresh(4)]
    words = [w for t in texts for w in t]
    texts = [" ".join(t) for t in texts]
    docs = frame(spark, texts)
    same_firsts(docs, texts)
    left = [w for r in suffix.without_repeats(docs).collect() for w in r["text"].split()]
    assert set(left) == set(words)
    passages = {w for i, t in enumerate(texts) for w in t.split() if words.count(w) > 1}
    lines = {w for w in passages if words.count(w) > 3}
    assert all(left.count(w) == 1 for w in passages - lines)


def test_repeats_around_a_frequent_line(spark):
    """Passages whose only shared suffixes may lie in a line that many other documents hold."""
    rng = random.Random(15)
    fresh = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = []
    for _ in range(15):
        line = fresh(12)
        texts += [fresh(rng.randint(1, 60)) + line + fresh(60) for _ in range(40)]
        for _ in range(4):
            before, after = fresh(40), fresh(40)
            texts += [fresh(3) + before + line + fresh(60), before + line + fresh(60)]
            texts += [fresh(60) + line + after, fresh(60) + line + after + fresh(3)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    same_firsts(frame(spark, texts), texts)


@pytest.mark.parametrize("ranges", [1, 60])
def test_matches_across_ranges(spark, ranges):
    """Suffixes with the same words after them, before them or both, over many more ranges than a bucket needs."""
    rng = random.Random(ranges)
    core = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(90):
        before, after = ([f"{side}{rng.randrange(3)}.{k}" for k in range(45)] for side in "ba")
        for words in (before, after):
            if rng.random() < 0.7:  # words that differ somewhere
                words[rng.randrange(45)] = f"x{i % 7}"
        middle = core[: rng.choice([12, 30, 60])] if rng.random() < 0.8 else core[20:45]
        texts.append(" ".join(before + middle + after))
    texts += texts[:5]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {(r["doc_id"], i, r["first_doc_id"]) for r in suffix.repeats(frame(spark, texts)).collect() for i in range(r["start"], r["stop"] - 49)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    where = {}
    for d, text in enumerate(texts):
        words = text.split()
        for i in range(len(words) - 49):
            where.setdefault(tuple(words[i : i + 50]), []).append((d, i))
    want = {(d, i, min(at)[0]) for at in where.values() if len({d for d, _ in at}) > 1 for d, i in at}
    # Spans of one first document that touch are one, so that they may hold further windows.
    assert want <= got and all(any((d, j, f) in want for j in range(i - 49, i + 50)) for d, i, f in got)


def test_clashing_columns_and_repeated_rows_of_cut_texts(spark, empty):
    rng = random.Random(16)
    shared = " ".join(f"v{rng.randint(0, 10**9)}" for _ in range(60))
    texts = [shared + " one", "two " + shared, None, "", shared + " one"]
    extra = {c: F.lit(7) for c in ("cuts", "left", "row", "cut_spans", "node", "component", "kind", "centre")}
    docs = frame(spark, texts[:4]).unionByName(frame(spark, texts[1:2], 1)).withColumns(extra)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"] or "", r["n_chars"], r["cuts"], r["row"]) for r in out.collect())
    assert got == [(0, texts[0], len(texts[0]), 7, 7), (1, "two ", 4, 7, 7), (1, "two ", 4, 7, 7), (2, "", None, 7, 7), (3, "", 0, 7, 7)]
    left = minhash.distinct_documents(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3]
    assert suffix.without_repeats(empty.withColumns(extra)).count() == 0


def test_cut():
    assert suffix.cut("a b  c\nd e", [(1, 3)]) == "a d e" and suffix.cut("a b", [(0, 2)]) == "" and suffix.cut("a b", []) == "a b"


# quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rule_counts():
    rng = random.Random(6)
    for text in [t or "" for t in ODD] + [" ".join(rng.choice(["a", "b", "c#", "d\n", "é|"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]:
        assert rules.counted(text) == brute_counts(text)


def test_rules_frames(spark, odd, empty):
    rng = random.Random(8)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))) for _ in range(150)]
    bad = [" ".join(f"{rng.randint(0, 99999)}{'$' * rng.randint(2, 9)}" for _ in range(80)) for _ in range(15)]
    docs = odd.unionByName(frame(spark, good + bad, 100))
    labels = spark.createDataFrame([(100 + i, int(i < 150), 0) for i in range(165)], "doc_id long, quality int, toxic int")
    got = by_doc(rules.judged(docs, labels))
    assert len(got) == docs.count() and all(got[i]["base_failed"] and not got[i]["kept"] for i in (0, 1, 2, 3, 4, 5))
    assert sum(not got[100 + i]["kept"] for i in range(150)) <= 2
    assert sum(got[250 + i]["kept"] for i in range(15)) <= 1
    assert max(rules.thresholds(rules.judged(docs, labels), labels, 0.2)) <= rules.NONE
    twice = by_doc(rules.judged(docs.unionByName(docs), labels))
    assert rules.judged(docs.unionByName(docs), labels).count() == 2 * len(twice)
    assert rules.judged(empty, labels).count() == 0
    alone = by_doc(rules.judged(docs, labels.limit(0)))
    assert all(r["kept"] == (not r["base_failed"]) for r in alone.values())


def test_isolation_forest_finds_outliers():
    x = np.random.default_rng(1).normal(size=(600, 3))
    forest = rules.grow(x)
    assert forest.score(np.array([[9.0, 9, 9]]))[0] > 0.7 > forest.score(np.zeros((1, 3)))[0] > 0


def test_steps_are_the_forest():
    rng = np.random.default_rng(4)
    x = np.round(rng.exponential(size=(900, 1)), 1)
    forest = rules.grow(x, 20)
    probe = np.concatenate([x, rng.normal(size=(300, 1)) * 5, forest.value.reshape(-1, 1)])
    assert np.array_equal(rules.steps(forest).score(probe), forest.score(probe))
    flat = rules.grow(np.zeros((50, 1)), 5)
    assert np.array_equal(rules.steps(flat).score(probe), flat.score(probe))


def brute_path(forest, tree, row):
    """Mean path length of one row in one tree, a comparison a step."""
    node = 0
    while forest.feature[tree, node] >= 0:
        node = 2 * node + (2 if row[forest.feature[tree, node]] >= forest.value[tree, node] else 1)
    return forest.path[tree, node]


def test_verdicts_by_brute_force(spark, sf):
    """The whole query's verdicts: every path walked, thresholds from sorted scores of all labelled rows."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.counts(docs)
    rows = {r["doc_id"]: r for r in stats.collect()}
    quality_of = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    sample = stats.where("not base_failed").orderBy(F.xxhash64("doc_id", "n_words"), "doc_id").toPandas()
    x = rules.measures(sample)
    forests = [rules.grow(x[:, list(v)]) for v in rules.VIEWS]
    passing = sample["doc_id"].tolist()
    odd = set()
    for view, forest in zip(rules.VIEWS, forests, strict=True):
        score = {}
        for doc, row in zip(passing, x[:, list(view)], strict=True):
            path = np.mean([brute_path(forest, t, row) for t in range(len(forest.feature))])
            score[doc] = int(2.0 ** -(path / float(rules.mean_path(forest.size))) * rules.BINS + 1e-9)
        good = [score[d] for d in passing if quality_of.get(d) == 1]
        bad = [score[d] for d in passing if quality_of.get(d) == 0]
        share = lambda found, least: sum(s >= least for s in found) / len(found)
        least = next(b for b in range(rules.NONE + 1) if share(good, b) <= rules.FALSE_SHARE / len(rules.VIEWS))
        if share(bad, least) > share(good, least):
            odd |= {d for d in passing if score[d] >= least}
    for r in rules.judged(docs, labels).collect():
        assert r["kept"] == (not rows[r["doc_id"]]["base_failed"] and r["doc_id"] not in odd)


# classifiers


def test_trees_learn_and_agree_with_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x[:1500], y[:1500], trees=40)
    score = model.score(x[1500:])
    assert ((score > 0.5) == y[1500:]).mean() > 0.97
    total = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(x[1500, f[node]] > t[node])
        total += leaf[node - len(f)]
    assert score[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_frames(spark, odd, empty):
    rng = random.Random(7)
    text = lambda bad: " ".join((w.upper() + "!!" if bad else w) for w in ("".join(rng.choice("abcdeghr") for _ in range(5)) for _ in range(40)))
    texts = [text(i % 4 == 0) for i in range(400)]
    docs = odd.unionByName(frame(spark, texts, 100))
    labels = spark.createDataFrame([(100 + i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    held = quality.remainder(5) == 0
    model = quality.train(docs, labels, held)
    got = by_doc(quality.scored(docs, model))
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held.alias("h")).collect()}
    assert flags == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in flags}
    assert all((got[100 + i]["score"] > 0.5) == (i % 4 != 0) for i in range(400) if flags[100 + i])
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9]["score"] == got[10]["score"]
    kept = quality.kept(docs, model, 0.3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["score"] >= 0.3}
    assert quality.scored(empty, quality.train(empty, labels, held)).count() == 0


def test_toxicity_frames(spark, odd, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 8)))
    texts = []
    for i in range(600):
        words = [word() for _ in range(60)]
        if i % 6 == 0:
            words[rng.randrange(60)] = rng.choice(["Vilest", "scoundrel,", "DUNCE"])
        texts.append(" ".join(words))
    docs = odd.unionByName(frame(spark, texts, 100))
    labels = spark.createDataFrame([(100 + i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    held = quality.remainder(3) == 1
    got = by_doc(toxicity.scored(docs, toxicity.train(docs, labels, held)))
    unseen = [i for i in range(600) if zlib.crc32(str(100 + i).encode()) % 3 == 1]
    right = sum((got[100 + i]["score"] >= 0.7) == (i % 6 == 0) for i in unseen)
    assert right >= 0.98 * len(unseen) and got[0]["score"] == got[1]["score"] < 0.5
    assert toxicity.scored(empty, toxicity.train(docs, labels.limit(0), held)).count() == 0


# licences


def test_licenses(spark, odd, empty):
    two = "\n".join(["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."])
    texts = ["Intro.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", two, "// SPDX-License-Identifier: MPL-2.0", "Released under the\n mit license!", "an MIT License thing", "Released under the MIT License. Released under the MIT License."]
    got = sorted((r["doc_id"] - 100, r["license"], r["n_sentences"]) for r in licenses.scan(odd.unionByName(frame(spark, texts, 100))).collect())
    assert got == [(0, "MIT", 1), (1, "Apache-2.0", 1), (1, "CC-BY-NC-4.0", 1), (2, "BSD-2-Clause", 2), (3, "MPL-2.0", 1), (4, "MIT", 1), (6, "MIT", 1), (6, "MIT", 1)]
    assert licenses.scan(empty).count() == 0
    assert all(any(m in licenses.normalised(s) for m in licenses.MARKS for s in parts) for _, parts in licenses.all_rules())


def test_licences_as_published(spark):
    apache = """Copyright 2020 A. Name

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software"""
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED"""
    texts = [apache, "\n".join("# " + x for x in gpl.split("\n")), gpl, mpl, bsd, bsd[: bsd.index("\n\n3.")], "Licensed under the GNU General Public License, version\n3. More"]
    wants = ["Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-or-later", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0-only"]
    rules = licenses.all_rules()
    each = [*range(len(licenses.RULES)), *range(len(licenses.RULES), len(rules), 7)]
    for k in each:  # rules by themselves, one word a line as well
        texts += [". ".join(p.rstrip(":") for p in rules[k][1]), "\n".join(" ".join(rules[k][1]).split())]
        wants += [None, None]
    got = {}
    for r in licenses.scan(frame(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["rule"]))
    for d, want in enumerate(wants):
        rule = each[(d - 7) // 2]
        assert len(got[d]) == 1 and (got[d][0][0] == want if want else got[d] == [(rules[rule][0], rule + 1)]), texts[d]


def test_licences_in_comments_and_repeated_rows(spark):
    notice = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    marked = ["\n".join(f"{m} {line}".rstrip() for line in notice.split("\n")) for m in (" *", "#", "//", "--", ";", "%", ">")]
    got = licenses.scan(frame(spark, ["/*\n" + marked[0] + "\n */", *marked[1:]])).collect()
    assert sorted((r["doc_id"], r["license"], r["n_sentences"]) for r in got) == [(i, "Apache-2.0", 4) for i in range(7)]
    bsd = "\n".join(f"{p}." for p in next(p for name, p in licenses.RULES if name == "BSD-3-Clause"))
    rows = frame(spark, [bsd]).unionByName(frame(spark, [bsd])).unionByName(frame(spark, ["Released under the MIT License."]))
    got = [(r["doc_id"], r["license"], r["n_sentences"]) for r in licenses.scan(rows).collect()]
    assert sorted(got) == [(0, "BSD-3-Clause", 4), (0, "MIT", 1)]


def test_licences_in_headings_tags_and_plain_words(spark):
    texts = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause OR MIT) */": ["GPL-2.0-only", "BSD-3-Clause", "MIT"],
        "License: MIT": ["MIT"],
        "MIT License\n\nCopyright (c) 2020 A. Name": ["MIT"],
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright": ["GPL-3.0-only"],
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": ["Apache-2.0"],
        "This product is licensed under the MIT License.": ["MIT"],
        "This project is licensed under the terms of the MIT license.": ["MIT"],
        "MIT or Apache-2.0 license": [],
    }
    got = {}
    for r in licenses.scan(frame(spark, list(texts))).orderBy("sentence").collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert [got.get(i, []) for i in range(len(texts))] == list(texts.values())


def test_licence_rules_need_their_sentences_in_order(spark):
    grant, notice = next(p for name, p in licenses.RULES if name == "MIT")
    a, b, c, d = next(p for name, p in licenses.RULES if name == "BSD-3-Clause")
    texts = [f"{grant}\n\n{notice}.", f"{notice}.\n\n{grant}", f"{grant}\n\nOther words.\n\n{notice}.", f"{a}\n1.\n{b}.\n2.\n{c}.\n{d}.", f"{a}\n{c}.\n{b}."]
    got = sorted((r["doc_id"], r["license"], r["n_sentences"]) for r in licenses.scan(frame(spark, texts)).collect())
    assert got == [(0, "MIT", 2), (3, "BSD-3-Clause", 4)]


def test_licence_sql_on_wrapped_and_commented_texts(spark):
    rules = licenses.all_rules()
    texts = ["Released under the MIT License", "# SPDX-License-Identifier: MIT OR Zlib\n# More"]
    for k in range(0, len(rules), 40):
        whole = ". ".join(rules[k][1]) + "."
        wrapped = textwrap.wrap(whole, 60)
        texts += [whole, "\n".join(wrapped), "\n".join(f" * {x}" for x in wrapped), "1.\n" + "\n2) ".join(rules[k][1]), "Intro\n" + "\n".join(whole.split())]
    docs = frame(spark, [None, "", *texts, "\n".join(texts)])
    with duckdb.connect() as db:
        db.register("documents", docs.select("doc_id", "text").toPandas())
        want = db.execute(licenses.scan_sql()).fetchall()
    got = [tuple(r) for r in licenses.scan(docs).select("doc_id", "sentence", "n_sentences", "rule", "license").collect()]
    assert sorted(got) == sorted(want) and len(got) > len(texts)


def test_a_text_of_many_licence_lines(spark):
    got = licenses.scan(frame(spark, ["Licensed under the Apache License, Version 2.0.\n" * 20_000])).groupBy("license").count().collect()
    assert [tuple(r) for r in got] == [("Apache-2.0", 20_000)]


# media


def test_sequence_keeps_order_and_captions():
    page = "<head><title>x</title></head><p>one <b>two</b></p><figure><img src='sha256:aa' alt='no'><figcaption>the cap</figcaption></figure>three<img src='sha256:bb' alt='alt'><script>var x</script><img alt='none'><p>four &amp; five"
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.sequence(page)] == [
        (0, "text", "one two", None), (1, "media", "sha256:aa", "the cap"), (2, "text", "three", None), (3, "media", "sha256:bb", "alt"), (4, "text", "four & five", None)]
    assert media.sequence(None) == [] and media.sequence("") == []


def test_media_resolve(spark, odd, empty):
    payloads = media.described(media.store(odd))
    pages = spark.createDataFrame([(1, "<p>a</p><img src='sha256:00' alt='gone'>"), (2, None)], "page_id long, html string")
    items = media.interleaved(pages, "page_id").selectExpr("page_id", "inline(items)").where("kind = 'media'")
    refs = items.withColumn("digest", F.substring_index("ref", ":", -1)).withColumn("n_bytes", F.lit(1).cast("long"))
    assert [(r["caption"], r["payload_sha256"]) for r in media.resolved(refs, payloads, ["digest", "n_bytes"]).collect()] == [("gone", None)]
    rows = payloads.collect()
    for text in ODD:
        raw = (text or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        (row,) = [r for r in rows if r["digest"] == hashlib.sha256(want).hexdigest() and r["n_bytes"] == len(raw)]
        assert (row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert media.samples(media.raster(want)).tobytes() == want and row["media_sha256"] == hashlib.sha256(media.raster(want)).hexdigest()
    assert media.described(media.store(empty)).count() == 0
