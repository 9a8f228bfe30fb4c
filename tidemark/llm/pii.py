"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (``email ip card phone``) follow fixed patterns and are kept whenever their own check holds.
Further kinds (``iban ssn btc``) start from a score of their own, which words nearby raise or lower; they count
from ``MIN_SCORE`` on. Spans are code points, end exclusive, sorted by start and then kind.

Defined cases: null and empty texts have no spans; overlapping spans of different kinds are all reported and
masked as one; equal texts have equal spans; repeated rows each get theirs; columns besides ``doc_id`` and ``text`` are ignored by ``find``
and kept by ``mask``. All patterns are linear in the text, also for one very long run of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts

#: Kinds in the order that breaks ties of spans with the same start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "btc")
BASE = KINDS[:4]
#: A proposed span counts from this score on.
MIN_SCORE = 0.6
#: Code points on either side that are searched for context words.
CONTEXT = 48
#: Score of a proposal whose check holds, what words nearby add or take, and the words.
SCORES = {"iban": 0.7, "ssn": 0.4, "btc": 0.7}
BOOST = PENALTY = 0.3
WORDS = {
    "iban": ("iban", "bank", "konto", "compte", "cuenta", "account"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
    "btc": ("bitcoin", "btc", "wallet"),
}
#: Words of numbers that are no personal data.
OTHERS = ("serial", "part no", "part number", "order number", "order no", "tracking", "isbn", "version", "commit", "hash", "placeholder", "sample value")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])").finditer
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])").finditer
_BTC = re.compile(r"(?<![A-Za-z0-9])[13][1-9A-HJ-NP-Za-km-z]{25,34}(?![A-Za-z0-9])").finditer
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of IBANs: moved to the end, letters as numbers, the rest by 97 is 1."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def base58check(address: str) -> bool:
    """The checksum of addresses: four bytes of a double SHA-256."""
    n = 0
    for c in address:
        n = n * 58 + _BASE58.index(c)
    if n >> 200:
        return False
    raw = n.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with its run of local characters on the left and a dotted domain on the right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        follow = at + 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            yield start, m.end()
            done = follow = m.end()
        else:
            done = at + 1
        at = text.find("@", follow)


def _whole(words: tuple[str, ...]) -> Callable[[str], Iterator[re.Match]]:
    return re.compile(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])").finditer


_NEAR = {kind: _whole(words) for kind, words in WORDS.items()}
_OTHER = _whole(OTHERS)


def scored(kind: str, text: str, start: int, end: int) -> float:
    """The score of a confirmed proposal: words of its kind nearby raise it, words of other numbers lower it. Whole words count
    that lie within ``CONTEXT`` code points; one more on either side shows whether they are whole."""
    low, high = max(0, start - CONTEXT - 1), min(len(text), end + CONTEXT + 1)
    near = text[low:high].lower()
    begin, stop = max(0, start - CONTEXT) - low, len(near) - (high - min(len(text), end + CONTEXT))
    has = lambda found: any(m.start() >= begin and m.end() <= stop for m in found(near))
    return round(SCORES[kind] + BOOST * has(_NEAR[kind]) - PENALTY * has(_OTHER), 6)


def spans(text: str) -> list[tuple[int, str, int]]:
    """All (start, kind, end) of a text, sorted by start and then by the order of ``KINDS``."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE(text) if 9 <= len(_digits(m[0])) <= 15]
    for m in _CARD(text):
        if 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    more = [(4, m) for m in _IBAN(text) if mod97(m[0])] + [(6, m) for m in _BTC(text) if base58check(m[0])]
    if "-" in text:
        more += [(5, m) for m in _SSN(text)]
    if more:
        found += [(m.start(), kind, m.end()) for kind, m in more if scored(KINDS[kind], text, m.start(), m.end()) >= MIN_SCORE]
    return [(a, KINDS[kind], b) for a, kind, b in sorted(found)]


def find(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``spans`` (array of kind, start, end). Narrow: no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in spans(t)] for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": found})

    return texts(docs).mapInPandas(run, "doc_id long, spans array<struct<kind:string, start:long, end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text, from what ``find`` returns."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: str) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, done = [], 0
    merged: list[list] = []
    for a, kind, b in spans(text):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, kind, b])
    for a, kind, b in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked (a null text stays null) and ``n_chars``, if there, counted anew."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else masked(t))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
