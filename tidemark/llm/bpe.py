"""Byte-level BPE encoding and decoding.

A text is cut by the pre-token pattern; each pre-token is merged on its own. The merge keeps the byte
positions in a segment tree whose nodes hold the least (rank, position) of the pairs below, so the root
is the leftmost pair of least rank; a merge touches the pair itself, its left neighbour and the right
part's own leaf, each one a logarithmic point update. A pre-token of n bytes costs O(n log n).
Short pre-tokens of a batch are merged together, one tree a row of a numpy array.

Defined cases: null and empty texts have no ids; equal texts have equal ids; ids decode to the text's
UTF-8 bytes exactly; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, texts

#: Unicode White_Space, spelled out so that every regex engine means the same by a blank.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries that a worker's cache holds before it starts anew.
CACHE = 600_000
#: Texts with all characters below this are cut by the standard library's regex engine.
LATIN = 0x250
#: Bytes of the longest pre-token that is merged together with others.
TOGETHER = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pretokens(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts a text by ``pattern``, with blanks (the s class) meaning Unicode White_Space."""
    inner = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    full = regex.compile(inner).findall
    # The same pattern for texts below U+0250, with the letters and numbers there listed, in the faster engine.
    listed = {kind: "".join(chr(c) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
    quick = re.compile(inner.replace(r"[^" + SPACE + r"\p{L}\p{N}]", f"[^{SPACE}{listed['L']}{listed['N']}]").replace(r"\p{L}", f"[{listed['L']}]").replace(r"\p{N}", f"[{listed['N']}]")).findall
    last = chr(LATIN)
    return lambda text: quick(text) if text.isascii() or max(text, default="") < last else full(text)


class Merger:
    """Merges the bytes of one pre-token by a segment tree over byte positions."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, rank, longest = len(piece), self.ranks.get, self.longest
        size = 1 << max(1, n - 1).bit_length()
        shift = size.bit_length()
        never = 1 << 62
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def pair(i: int) -> int:
            """Key of the pair that starts at byte ``i``: its rank, then its position; ``never`` if it can't merge."""
            j = after[i]
            if j >= n or after[j] - i > longest or (r := rank(piece[i : after[j]])) is None:
                return never
            return r << shift | i

        tree = [never] * (2 * size)
        tree[size : size + n] = map(pair, range(n))
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            while i > 1:
                other = tree[i ^ 1]
                key = key if key < other else other
                i >>= 1
                if tree[i] == key:
                    return
                tree[i] = key

        while (least := tree[1]) != never:
            i = least & ((1 << shift) - 1)
            j = after[i]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            put(j, never)
            put(i, pair(i))
            if (h := before[i]) >= 0:
                put(h, pair(h))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids


class Forest:
    """Many short pre-tokens at once: one segment tree a row, all rows take their next merge together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {
            left << 32 | right: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    NEVER = np.int64(1 << 62)

    def keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and position of each pair of ids; ``NEVER`` for those that don't merge (an id of -1 never does)."""
        wanted = left << 32 | right
        found = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        ok = (self.pairs[found] == wanted) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[found] << 6 | at, self.NEVER)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word; a word has 2 to 64 bytes."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for size in (4, 8, 16, 32, 64):
            rows = np.flatnonzero((sizes <= size) & (sizes > (size // 2 if size > 4 else 0)))
            for some in np.array_split(rows, len(rows) * size // 1_000_000 + 1):
                for row, ids in zip(some.tolist(), self._same([words[i] for i in some.tolist()], size), strict=True):
                    out[row] = ids
        return out

    def _same(self, words: list[bytes], size: int) -> list[bytes]:
        if not words:
            return []
        n = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(len(words), size)
        at = np.arange(size)
        ids = np.full((len(words), size + 1), -1, np.int64)
        ids[:, :size] = np.where(at < n[:, None], self.byte_ids[data], -1)
        after = np.broadcast_to(np.minimum(np.arange(1, size + 2), size), (len(words), size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (len(words), size + 1)).copy()
        tree = np.full((len(words), 2 * size), self.NEVER, np.int64)
        tree[:, size:] = self.keys(ids[:, :size], ids[:, 1:], at[None, :])
        for low in (1 << k for k in range(size.bit_length() - 2, -1, -1)):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        row = np.flatnonzero(tree[:, 1] != self.NEVER)
        while len(row):
            least = tree[row, 1]
            i = least & 63
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            ids[row, i] = least >> 6
            ids[row, j] = -1
            after[row, i] = k
            before[row, k] = i
            tree[row, size + j] = self.NEVER
            tree[row, size + i] = self.keys(ids[row, i], ids[row, k], i)
            back = h >= 0
            tree[row[back], size + h[back]] = self.keys(ids[row[back], h[back]], ids[row[back], i[back]], h[back])
            for changed in (size + j, size + i, np.where(back, size + h, size + i)):
                while changed[0] > 1:
                    changed = changed >> 1
                    tree[row, changed] = np.minimum(tree[row, 2 * changed], tree[row, 2 * changed + 1])
            row = row[tree[row, 1] != self.NEVER]
        alive = ids[:, :size] >= 0
        packed = ids[:, :size][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Texts to packed ids (little-endian unsigned 32 bit); ``encode`` gets the pre-tokens of a batch not known yet.

    What repeats is encoded once for each worker and cache fill, so the cost follows the distinct pre-tokens.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], cache: int = CACHE) -> None:
        self.cut, self.encode, self.cache = cut, encode, cache
        self.known: dict[str, bytes] = {}

    def __call__(self, batch: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.cache:
            known.clear()
        words = list(map(self.cut, batch))
        found = [list(map(known.get, ws)) for ws in words]
        new = dict.fromkeys(w for ws, ids in zip(words, found, strict=True) if None in ids for w, x in zip(ws, ids, strict=True) if x is None)
        fresh = dict(zip(new, self.encode(list(new)), strict=True))
        out = [b"".join([fresh[w] if x is None else x for w, x in zip(ws, ids, strict=True)] if None in ids else ids) for ws, ids in zip(words, found, strict=True)]
        known.update((w, x) for w, x in fresh.items() if len(w) < TOGETHER)
        return out


class Bpe:
    """A rank file's codec: ``encode`` texts to packed ids, ``decode`` them to bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.single, self.forest = Merger(self.ranks), Forest(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.encode = Encoder(pretokens(pattern), self.merge)

    def merge(self, words: list[str]) -> list[bytes]:
        """The packed ids of each pre-token."""
        out, together = [b""] * len(words), []
        for i, word in enumerate(words):
            data = word.encode("utf-8")
            if (whole := self.ranks.get(data)) is not None:
                out[i] = struct.pack("<I", whole)
            elif len(data) <= TOGETHER:
                together.append((i, data))
            else:
                ids = self.single.encode(data)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        for (i, _), ids in zip(together, self.forest.encode([data for _, data in together]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Bpe] = {}


def codec(path: str, pattern: str) -> Bpe:
    """The codec of a rank file, loaded once for each worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Bpe(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32 bit). Narrow: no shuffle, a batch of texts at a time."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": bpe.encode(frame["text"].tolist())})

    return texts(docs).mapInPandas(run, "doc_id long, ids binary")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``decoded`` (binary) of a frame that ``encode`` made."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "decoded": [bpe.decode(x) for x in frame["ids"]]})

    return ids.mapInPandas(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of both directions in one pass over the texts: ids never leave the worker that made them."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for frame in frames:
            rows = [(len(ids) // 4, sha(ids), sha(bpe.decode(ids))) for ids in bpe.encode(frame["text"].tolist())]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
