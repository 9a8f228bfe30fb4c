"""Line dedup, periodic runs and embedding whitening against brute force, edge cases included."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import lines, periods, whitening
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, drop string, runs int, suspects double, digest string, n_lines string"
ODD = [None, "", " ", "\n\n \t", "a", "word " * 3000, "x" * 5000, "Ünïcödé  　 日本語 😀\r\n", "\x00\x1c\x85", "0\n" * 3000, "same line, long enough\n" * 40]


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", 1, 0.5, "clash", "clash") for i, t in rows], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# line dedup


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def dropped_by_hand(rows, least_documents=3, least_chars=20):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars and doc is not None:
                holders.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        gone = [len(h := holders.get(key_of(x), ())) >= least_documents and doc is not None and doc != max(h) for x in all_lines]
        out.append((doc, "\n".join(x for x, g in zip(all_lines, gone, strict=True) if not g), len(all_lines), sum(gone)))
    return sorted(out, key=str)


def line_rows(n, seed=5):
    rng = random.Random(seed)
    pool = [f"shared line number {k} of the pool" for k in range(30)] + ["ÄÖÜ äöü ﬀ ſ İ long enough", "short line", "nineteen characters", "日本語" * 7, "é" * 20, "é" * 19]
    made = lambda: rng.choice(["", "  ", "\t", "\r"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", " \x0b", "\x1c", "\xa0"])
    return [(i, "\n".join(made() if rng.random() < 0.5 else f"own line {i} {k} of this text" for k in range(rng.randint(0, 12)))) for i in range(n)]


def test_lines_by_hand(spark):
    rows = line_rows(120) + [(500 + i, t) for i, t in enumerate(ODD)] + line_rows(20, 6) + [(None, t) for _, t in line_rows(5, 7)]
    docs = frame(spark, rows).repartition(7)
    for least in (2, 3):
        got = sorted(map(tuple, lines.without_repeated_lines(docs, least).collect()), key=str)
        assert got == dropped_by_hand(rows, least)
        assert sum(r[3] for r in got) > 100


def test_lines_of_hot_text_stay_in_the_largest_document(spark):
    text = "One copy of a line that all have\nand a second line, also shared\nx"
    got = {r["doc_id"]: r for r in lines.without_repeated_lines(frame(spark, [(i, text) for i in range(300)])).collect()}
    assert got[299]["text"] == text and all(got[i]["text"] == "x" and got[i]["n_dropped"] == 2 for i in range(299))


def test_filters_that_fold_or_split_lose_nothing(spark, monkeypatch):
    rows = line_rows(150)
    for name, value in (("TILE_LINES", 16), ("BUFFER", 8), ("MAX_BYTES", 1), ("TILE_BITS", 64)):
        monkeypatch.setattr(lines, name, value)
        got = sorted(map(tuple, lines.without_repeated_lines(frame(spark, rows).repartition(5)).collect()), key=str)
        assert got == dropped_by_hand(rows)


def test_fold_keeps_hashes():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    bits = np.zeros(1 << 14, bool)
    for at in lines.places(hashes, len(bits)):
        bits[at] = True
    whole = np.packbits(bits, bitorder="little").tobytes()
    for times in (0, 1, 3, 20):
        assert lines.Twice(1, [(0, lines.fold(whole, times))]).has(hashes).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert lines.Twice(1, [(0, whole)]).has(other).mean() < 0.01
    assert len(lines.fold(whole, 20)) == 8


def test_lines_of_an_empty_table(spark):
    out = lines.without_repeated_lines(frame(spark, []))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"] and out.count() == 0
    with pytest.raises(ValueError):
        lines.without_repeated_lines(frame(spark, []), 1)


# periodic runs


def runs_by_hand(w, least=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            part = w[i : i + length]
            if length >= max(least, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out)


def periodic_words(rng):
    n, a = rng.randint(0, 120), rng.choice([1, 2, 3, 30])
    w = [rng.randint(0, a) for _ in range(n)]
    if n and rng.random() < 0.6:
        k, s = rng.randint(1, 20), rng.randint(0, n - 1)
        w = [w[i if i < s else s + (i - s) % k] for i in range(n)]
    return (w[: rng.randint(1, 30)] * 9)[:n] if rng.random() < 0.3 else w


def test_runs_by_hand(monkeypatch):
    rng = random.Random(11)
    for pairs in (1 << 18, 7):
        monkeypatch.setattr(periods, "PAIRS", pairs)
        for _ in range(600):
            w = periodic_words(rng)
            for least in (2, 5, 12):
                assert periods.find(np.array(w, np.int64), least) == runs_by_hand(w, least)


def test_long_sequences_stay_near_linear():
    n = 200_000
    assert periods.find(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert len(periods.find(np.repeat(np.arange(n // 20), 20))) == n // 20
    assert periods.find(np.tile(np.arange(n // 3), 3)) == [(0, n // 3 * 3, n // 3)]
    assert periods.find(np.arange(n)) == []


def query_by_hand(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return {
        "doc_id": doc, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), "collapsed_sha256": sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()),
    }


def test_runs_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    short = {d for d, t in docs.items() if len((t or "").split()) <= 1500}  # brute force is quadratic
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert got.keys() == docs.keys() and len(short) > 0.9 * len(docs)
    assert all(got[d] == query_by_hand(d, docs[d]) for d in short)
    assert sum(r["n_runs"] > 0 for r in got.values()) > 10


def test_runs_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, "a b c " * 9, "a b c " * 9 + "z " + "q " * 13])] + [(3, "a b c " * 9), (None, "k " * 20)]
    got = periods.periodic_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {r["doc_id"]: r for r in got if r["doc_id"] not in (3, None)}
    assert by_text[5]["text"] == "word" and [tuple(r) for r in by_text[5]["runs"]] == [(0, 3000, 1)]
    assert by_text[0]["runs"] == [] and by_text[0]["text"] == "" and by_text[0]["n_words"] == 0
    assert by_text[12]["text"] == "a b c z q" and [tuple(r) for r in by_text[12]["runs"]] == [(0, 27, 3), (28, 13, 1)]
    assert sorted(r["text"] for r in got if r["doc_id"] == 3) == ["", "a b c"]
    assert [r["text"] for r in got if r["doc_id"] is None] == ["k"]
    assert periods.periodic_runs(frame(spark, [])).count() == 0
    changed = periods.made_periodic(frame(spark, rows))
    assert changed.columns == ["doc_id", "text"] and changed.where("text is null").count() == 0


# whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, whitened string, component int")


def whitened_by_hand(rows):
    usable = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}), float)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    return usable, n, [int(s) for s in sums], cov


def check_rows(got, rows, components):
    usable, n, sums, cov = whitened_by_hand(rows)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1][:components]
    assert len(got) == len(usable) * components
    by = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-6 and abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) <= 1e-6 * r["explained"]
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    x = dict(usable)
    whole = np.array([[by[i][k]["whitened"] for k in range(1, components + 1)] for i in by])
    centred = np.array([np.array(x[i], float) - np.array(sums, float) / n for i in by])
    axes, *_ = np.linalg.lstsq(centred, whole * np.sqrt(values), rcond=None)  # the components that the rows were projected on
    assert np.allclose(axes.T @ axes, np.eye(components), atol=1e-6) and np.allclose(cov @ axes, axes * values, atol=1e-6 * values[0])
    assert np.allclose(centred @ axes / np.sqrt(values), whole, atol=1e-6)
    for i in by:
        assert by[i][1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))


def test_whitening_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_rows(QUERIES["op13_whitening"](spark, sf).collect(), rows, 16)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1])]
    odd = [(200, None), (201, [None] * 5), (202, [1.0, float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf")] * 5), (204, [])]
    got = whitening.whiten(vectors_of(spark, rows + odd).repartition(6)).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in rows} and sum(r["vec_id"] == 7 for r in got) == 10
    check_rows([r for r in got if r["vec_id"] != 7], [r for r in rows if r[0] != 7], 5)
    with_short = whitening.whiten(vectors_of(spark, rows + [(300, [1.0, 2.0])])).collect()
    assert len(with_short) == len(got) and all(r["n"] == 60 for r in with_short)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None)])).count() == 0
    one = whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["explained"] == 0 and r["n"] == 1 for r in one)
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), 1.0]) for i in range(9)])).collect()
    assert all(r["whitened"] == 0 for r in flat if r["component"] == 2) and flat[0]["identity_error"] < 1e-9
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in huge)
