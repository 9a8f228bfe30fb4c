"""Corpus queries without SQL, run over whole small tables and held against brute force."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import media, pii, quality, toxicity
from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def by_doc(spark, sf, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(out)]


def test_personal_data(spark, sf, documents):
    got = by_doc(spark, sf, "op2_pii")
    assert got.keys() == documents.keys()
    for doc, text in documents.items():
        want, row = base_spans(text), got[doc]
        assert row["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode())
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want) for k in pii.BASE]
        kept = [tuple(x.split(":")) for x in row["spans"].split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in kept if k in pii.BASE] == want


def test_media_columns(spark, sf, documents):
    got = by_doc(spark, sf, "op3_media")
    assert got.keys() == documents.keys()
    for doc, text in documents.items():
        data, row = text.encode(), got[doc]
        payload = data + bytes(64 if not data else -len(data) % 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(data), len(payload), sha(payload))
        assert (row["tail_crc32"], row["media_bytes"], row["media_sha256"]) == (zlib.crc32(payload[-64:]), len(stored), sha(stored))
        lines = [" ".join(x.split()) for x in text.split("\n") if x.split()]
        assert (row["position"], row["n_items"]) == (min(1, len(lines)), len(lines) + 1)
        assert row["caption_sha256"] == sha((lines or [""])[0].encode())


def test_media_of_real_pages(spark, sf):
    """Whole raw pages: the same sequences as plain parsing gives, positions in order, no markup in texts."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["items"] for r in media.interleaved(pages, "page_id").collect()}
    for r in pages.collect():
        items = got[r["page_id"]]
        assert [i["position"] for i in items] == list(range(len(items)))
        assert sum(i["kind"] == "media" for i in items) <= len(re.findall(r"<(?:img|audio|video|source|embed)\b", r["html"] or "", re.I))
        plain = html.unescape(re.sub(r"<[^>]*>", " ", r["html"] or ""))
        assert all(set(i["text"].split()) <= set(plain.split()) or "<" in plain for i in items if i["kind"] == "text")


def test_packed_ids(spark, sf, documents):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*exact.encode(t, add_special_tokens=False).ids, 0] for d, t in documents.items()}
    rows = QUERIES["op8_packing"](spark, sf).collect()
    sequences, pieces = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans in (*sequences.values(), *pieces.values()):
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert max(sum(n for _, n in s) for s in sequences.values()) <= 1024
    assert all(sum(n for _, n in pieces[d]) == len(ids[d]) for d in documents)




def test_quality_scores(spark, sf, documents):
    """Every score by itself, from the text alone; labels only from rows that aren't held out."""
    got = by_doc(spark, sf, "op6_quality")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("held_out") if "held_out" in docs.columns else quality.remainder(5) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    same = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.train(docs, turned, held)).collect()}
    assert got.keys() == documents.keys()
    for doc, row in got.items():
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0) and row["predicted"] == int(row["score"] >= 0.3)
        assert 0 <= row["score"] <= 1 and row["score"] == pytest.approx(same[doc], abs=1e-12)


def test_toxicity_scores(spark, sf, documents):
    """Scores by a plain sum over each text's distinct n-grams, a dictionary look-up each."""
    got = by_doc(spark, sf, "op10_toxicity")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, quality.remainder(3) == 1)
    weights = {int(k): float(model.weight[k]) for k in np.flatnonzero(model.weight)}
    mask = (1 << 64) - 1
    assert got.keys() == documents.keys()
    for doc, text in documents.items():
        chars = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {text.lower()} "]
        found = set()
        for n in toxicity.SIZES:
            for i in range(len(chars) - n + 1):
                h = chars[i]
                for c in chars[i + 1 : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) & mask
                found.add(((h * 0x9E3779B97F4A7C15) & mask) >> 44)
        total = model.intercept + sum(weights.get(f, 0.0) for f in found)
        row = got[doc]
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1) and row["predicted"] == int(row["score"] >= 0.7)
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-4)
