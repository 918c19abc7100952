"""Interleaved document sequences with media columns.

HTML parsing turns a page into an ordered array of structs, text or media reference, each with its position
and, for media, the caption (figcaption, else alt) that belongs to it. References name a digest; a digest join
resolves them against a store of payloads, and the positions keep text, media and captions aligned.

The payload codec is lossless 8-bit grey PNG, 192 samples a row, made with zlib alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared
from .units import slices

ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<pos:int,kind:string,text:string,src:string,caption:string>"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(payload: bytes) -> bytes:
    """Spaces appended up to a positive multiple of 192 bytes."""
    return payload + b" " * (max(1, -(-len(payload) // ROW)) * ROW - len(payload))


def write_png(samples: bytes, level: int = 1) -> bytes:
    """8-bit grey, 192 wide; every row has filter 0."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    body = np.zeros((len(rows), ROW + 1), np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    """Samples of a PNG of ``write_png``; checks signature and chunk checksums."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], (0, 0)
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a row has another filter than 0")
    return rows[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Difference hash of the picture at 9 x 8 block means, with mean and deviation: hex,mean,deviation."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW).astype(np.float64)
    ys = np.linspace(0, len(rows), 9).astype(int)
    xs = np.linspace(0, ROW, 10).astype(int)
    grid = np.array([[rows[a : max(b, a + 1)][: len(rows) - a, c:d].mean() if a < len(rows) else rows[-1, c:d].mean() for c, d in zip(xs, xs[1:], strict=False)] for a, b in zip(ys, ys[1:], strict=False)])
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()
    return f"{bits},{rows.mean():.3f},{rows.std():.3f}"


class _Sequence(HTMLParser):
    """Collects text runs and media references in order."""

    SKIP, MEDIA = {"script", "style", "template", "noscript"}, {"img", "video", "audio", "source", "embed"}
    BREAK = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "figure", "ul", "ol", "table", "nav", "header", "footer", "pre", "blockquote", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.figures: list[dict] = []  # open ones: their media and caption
        self.caption: list[str] | None = None
        self.opened = 0  # items before the open caption

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "caption": None})

    def end_caption(self, closed: bool):
        """A caption belongs to its figure; outside of one, or where nothing closes it, its words are text."""
        text, self.caption = " ".join("".join(self.caption or []).split()), None
        if closed and self.figures:
            self.figures[-1]["caption"] = text or self.figures[-1]["caption"]
        elif text:
            self.items.insert(self.opened, {"kind": "text", "text": text, "src": None, "caption": None})

    def end_figure(self):
        figure = self.figures.pop()
        for item in figure["media"] if figure["caption"] else []:
            item["caption"] = figure["caption"]

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        if self.caption is not None:
            self.end_caption(False)
        while self.figures:
            self.end_figure()
        return self.items

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BREAK or tag in self.MEDIA:
            self.flush()
            if self.caption is not None:  # words on either side of a break are not one word
                self.caption.append(" ")
        if tag == "figure":
            self.figures.append({"media": [], "caption": None})
        if tag == "figcaption":
            self.flush()
            if self.caption is not None:
                self.end_caption(False)
            self.caption, self.opened = [], len(self.items)
        at = dict(attrs)
        if tag in self.MEDIA and at.get("src"):
            self.items.append({"kind": "media", "text": None, "src": at["src"], "caption": at.get("alt") or None})
            if self.figures:
                self.figures[-1]["media"].append(self.items[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.SKIP:
            self.skip -= 1

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in self.BREAK:
            self.flush()
        if self.caption is not None and tag in ("figcaption", "figure"):
            self.end_caption(True)
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Ordered items of a page: pos, kind (text or media), text, src, caption. None and '' give no items. The caption of a
    figure, before or after its media, is that of all of them; else the alternative text is. A caption that
    nothing closes, or outside a figure, is text."""
    if not html:
        return []
    parser = _Sequence()
    parser.feed(html)
    return [{"pos": i, **x} for i, x in enumerate(parser.finish())]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and sequence array<struct<pos,kind,text,src,caption>> for each row of ``pages``; null or
    empty HTML gives an empty sequence, broken HTML what the parser still finds."""

    def run(batches):
        kind = pa.list_(pa.struct([("pos", pa.int32()), *[(k, pa.string()) for k in ("kind", "text", "src", "caption")]]))
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_sequence(x) for x in batch.column(1).to_pylist()], kind)], ["id", "sequence"])

    kind = dict(pages.dtypes)[id_col]
    out = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, sequence array<{ITEM}>")
    return out.withColumnRenamed("id", id_col)


def store_payloads(payloads: DataFrame, column: str) -> DataFrame:
    """Write the padded payloads as PNGs under the SHA-256 of the unpadded bytes, in the shared folder, and
    return (digest, n_bytes, media) as read back. A task writes a digest once; equal digests of different
    tasks hold equal bytes."""

    def run(batches):
        seen = set()
        for whole in batches:
            for batch in slices(whole, 0):
                digests, sizes, media = [], [], []
                for payload in batch.column(0).to_pylist():
                    digest = hashlib.sha256(payload).digest()
                    if digest not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(digest)
                        digests.append(digest.hex())
                        sizes.append(len(payload))
                        media.append(write_png(padded(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["digest", "n_bytes", "media"])

    made = payloads.select(F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("p")).mapInArrow(run, "digest string, n_bytes long, media binary")
    return write_shared(made, "media").df


def media_columns(store: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one
    row for each digest, from the stored bytes of ``store``."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2):
                out: list[list] = [[] for _ in range(6)]
                for media in batch.column(2).to_pylist():
                    samples = read_png(media)
                    for k, v in enumerate((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples))):
                        out[k].append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["digest", "n_bytes", *MEDIA])

    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    read = store.select("digest", "n_bytes", "media").mapInArrow(run, f"digest string, n_bytes long, {kinds}")
    return read.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("n_bytes", *MEDIA)])


MEDIA = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def resolve(sequences: DataFrame, media: DataFrame, id_col: str, prefix: str = "sha256:") -> DataFrame:
    """One row for each media reference: ``id_col``, pos, caption, src, digest and the columns of ``media``;
    a reference that no digest resolves has nulls there. Rows of ``sequences`` that repeat give theirs each; a null
    sequence gives none."""
    refs = sequences.select(id_col, F.explode("sequence").alias("i")).where("i.kind = 'media'")
    refs = refs.select(id_col, "i.pos", "i.caption", "i.src", F.when(F.col("i.src").startswith(prefix), F.substring("i.src", len(prefix) + 1, 64)).alias("digest"))
    return refs.join(media, "digest", "left")
