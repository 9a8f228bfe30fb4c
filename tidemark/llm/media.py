"""Interleaved document sequences with media columns.

A page is parsed into an ordered sequence of text and media-reference structs; a reference names its payload
by SHA-256. Payloads live once each task in a media table of raster images (portable graymap, 8-bit samples,
``WIDTH`` a row); digest joins resolve references, and each struct keeps its position and caption.

Defined cases: null and empty texts and pages give an empty sequence, an empty payload still fills one row
of zero samples; equal payloads share a digest and all derived values; a reference that no payload resolves
keeps its struct with null payload columns; repeated references resolve each on their own, and so do repeated
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts, written

#: Samples in a row of a raster; payloads are padded with zeros to whole rows.
WIDTH = 64
#: How a reference names its payload.
SCHEME = "sha256:"
#: Elements whose text isn't shown, those that may be in a head, those that end a run of text, and those that
#: refer to media.
HIDDEN = frozenset(("script", "style", "template", "noscript", "title"))
HEAD = HIDDEN | {"head", "html", "base", "link", "meta"}
BLOCKS = frozenset(("p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "table", "tr", "td", "th", "br", "nav", "blockquote", "pre", "body"))
MEDIA = frozenset(("img", "audio", "video", "source", "embed"))

SEQUENCE = "array<struct<position:int, kind:string, text:string, ref:string, caption:string>>"


@dataclass
class Figure:
    """An open figure: its own media, those of figures in it left out, and the words of its caption, if any."""

    media: list[dict] = field(default_factory=list)
    caption: list[str] | None = None
    open: bool = False


class Sequencer(HTMLParser):
    """Collects the ordered text and media-reference structs of a page.

    Tags that may be left out are taken as given: a head ends at the first text or element that can't be in it, a caption
    with its figure, and figures with the page. A caption may come before or after its media.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden: list[str] = []
        self.head = False
        self.figures: list[Figure] = []

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_figure(self) -> None:
        figure = self.figures.pop()
        if figure.caption is not None:
            text = " ".join("".join(figure.caption).split())
            for item in figure.media:
                item["caption"] = text

    def in_caption(self) -> bool:
        return bool(self.figures) and self.figures[-1].open

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden or tag in HIDDEN:
            if tag in HIDDEN:
                self.hidden.append(tag)
            return
        self.head = tag == "head" or self.head and tag in HEAD
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
            if self.in_caption():
                self.figures[-1].caption.append(" ")
        if tag == "figure":
            self.figures.append(Figure())
        elif tag == "figcaption" and self.figures:
            self.figures[-1].caption, self.figures[-1].open = self.figures[-1].caption or [], True
        elif tag in MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.items.append({"kind": "media", "text": None, "ref": found["src"], "caption": found.get("alt")})
                if self.figures:
                    self.figures[-1].media.append(self.items[-1])

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            return
        if tag == "head":
            self.head = False
        if tag in BLOCKS:
            self.flush()
            if self.in_caption():
                self.figures[-1].caption.append(" ")
        if tag == "figcaption" and self.figures:
            self.figures[-1].open = False
        elif tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if self.hidden or self.head and not data.strip():
            return
        self.head = False
        (self.figures[-1].caption if self.in_caption() else self.run).append(data)

    def end(self) -> None:
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()


def sequence(page: str | None) -> list[dict]:
    """The structs of one page in order, with their positions."""
    parser = Sequencer()
    parser.feed(page or "")
    parser.end()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleaved(pages: DataFrame, key: str) -> DataFrame:
    """``key``, ``items``: each page's sequence. Narrow: no shuffle."""
    bounded_batches(pages.sparkSession)
    kind = dict(pages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "items": [sequence(p) for p in frame["html"]]})

    return pages.select(key, "html").mapInPandas(run, f"`{key}` {kind}, items {SEQUENCE}")


def padded(text: str) -> bytes:
    """The payload of a text: its UTF-8 bytes, zeros up to a positive multiple of ``WIDTH``."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def raster(payload: bytes) -> bytes:
    """The stored form: a binary portable graymap with one 8-bit sample a byte."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(media: bytes) -> np.ndarray:
    """The samples of a stored raster, a row each ``WIDTH``."""
    magic, size, depth, data = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(data):
        raise ValueError("not an 8-bit raster")
    return np.frombuffer(data, np.uint8).reshape(height, width)


def feature(pixels: np.ndarray) -> str:
    """A 64-bit difference hash of an 8 by 9 thumbnail of row means, as hex; equal rasters have equal ones."""
    height, width = pixels.shape
    rows = np.linspace(0, height, 9).astype(np.int64)
    cols = np.linspace(0, width, 10).astype(np.int64)
    sums = pixels.astype(np.float64).cumsum(0).cumsum(1)
    sums = np.pad(sums, ((1, 0), (1, 0)))
    low, high = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    low, high = np.minimum(low, height - 1), np.minimum(high, height)
    area = (high - low)[:, None] * np.diff(cols)[None, :]
    block = (sums[high][:, cols[1:]] - sums[high][:, cols[:-1]] - sums[low][:, cols[1:]] + sums[low][:, cols[:-1]]) / area
    bits = (block[:, 1:] > block[:, :-1]).ravel()
    return np.packbits(bits).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """The media table of all texts: ``digest, n_bytes, media``, written to the shared folder and read back.

    A task stores each digest once; no payload is shuffled.
    """
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there: set[bytes] = set()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                payload = padded(text)
                digest = hashlib.sha256(payload).digest()
                # Texts that end in zeros may share a payload but not a length.
                size = len(text.encode("utf-8", "surrogatepass"))
                if (mark := digest + size.to_bytes(8, "big")) not in there:
                    there.add(mark)
                    rows.append((digest.hex(), size, raster(payload)))
            yield pd.DataFrame(rows, columns=["digest", "n_bytes", "media"])

    return written(texts(docs).mapInPandas(run, "digest string, n_bytes long, media binary"), "media")


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes show: one row for each digest and length with the digests and the feature of its raster."""
    bounded_batches(media.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, size, stored in frame.itertuples(index=False):
                pixels = samples(stored)
                payload = pixels.tobytes()
                rows.append((digest, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pixels)))
            yield pd.DataFrame(rows, columns=["digest", "n_bytes", *NAMES])

    columns = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    each = media.mapInPandas(run, columns)
    return each.groupBy("digest", "n_bytes").agg(*(F.min(c).alias(c) for c in NAMES))  # equal rows: any of them


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def page(text: str, digest: str) -> str:
    """A document as a page: a paragraph a line, and after the first one a figure with the text's payload, which has that
    line as its caption."""
    head, *rest = [html.escape(x, quote=False) for x in text.split("\n") if x and not x.isspace()] or [""]
    return f'<p>{head}</p><figure><img src="{SCHEME}{digest}"><figcaption>{head}</figcaption></figure>' + "".join(f"<p>{x}</p>" for x in rest)


def as_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page that refers to its text's payload: ``doc_id, n_bytes, html``."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                digest = hashlib.sha256(padded(text)).hexdigest()
                rows.append((doc, len(text.encode("utf-8", "surrogatepass")), page(text, digest)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "html"])

    return texts(docs).mapInPandas(run, "doc_id long, n_bytes long, html string")


def resolved(refs: DataFrame, payloads: DataFrame, on: list[str]) -> DataFrame:
    """``refs`` (one row a reference) with the columns of ``payloads``. Both sides are light tables read from disk,
    so that a digest that most references share is split by adaptive execution."""
    return written(refs, "refs").join(written(payloads, "payloads"), on, "left")
