"""Interleaved documents: ordered text and media references, payloads joined by digest.

HTML is parsed into an ordered sequence of text parts and media references
with their captions.  Payloads live in a media table written to the shared
folder, one lossless 8-bit RGB image (PNG) a payload; references resolve by the
digest of the stored bytes.  The join carries features and digests, never the
payloads themselves: the media table is read back once, in place, and what it
gives is reduced to one row a digest (partial aggregation first, so copies do
not meet in one task) before it meets the references.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoint import fresh
from tessera.llm.common import blocks, map_arrow, only, read, text_bytes, written

#: Bytes of one image row: 64 samples of red, green and blue.
ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PART = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
_BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section header footer nav aside figure figcaption blockquote pre title".split())
_MEDIA = frozenset("img audio video source embed".split())
#: Their content is no text; only the first two may hold an end tag of others, so only they stay open until their own.
_RAW, _SILENT = frozenset("script style".split()), frozenset("script style template noscript".split())


class _Sequence(HTMLParser):
    """Collects text parts and media references in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.silent: list[str] = []
        self.figures: list[tuple[list[int], list[tuple[int, str]]]] = []  # media parts, and captions with their places, of each open figure
        self.caption: list[str] | None = None
        self.caption_at = 0

    def _close(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        self._text(len(self.parts), text)

    def _text(self, at: int, text: str) -> None:
        if text:
            self.parts.insert(at, {"position": at, "kind": "text", "text": text, "ref": None, "caption": None})

    def _end_caption(self) -> None:
        """The open caption goes to its figure; without a figure it is text."""
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figures:
            self.figures[-1][1].append((self.caption_at, text))
        else:
            self._text(self.caption_at, text)

    def _end_figure(self) -> None:
        """A figure's captions go to all its media; without media they are text where they stood."""
        self._end_caption()
        media, captions = self.figures.pop()
        whole = " ".join(t for _, t in captions if t)
        for at in media:
            self.parts[at]["caption"] = whole or self.parts[at]["caption"]
        if not media:
            for at, text in reversed(captions):
                self._text(at, text)

    def finish(self) -> list[dict]:
        """All parts, once the input has ended."""
        self._close()
        self._end_caption()
        while self.figures:
            self._end_figure()
        return [{**p, "position": k} for k, p in enumerate(self.parts)]

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent.append(tag)
        elif tag in _MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self._close()
                if self.figures:
                    self.figures[-1][0].append(len(self.parts))
                self.parts.append({"position": len(self.parts), "kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt") or given.get("title")})
        elif tag in _BREAKS:
            self._close()
            if tag == "figure":
                self._end_caption()
                self.figures.append(([], []))
            elif tag == "figcaption":
                self._end_caption()
                self.caption, self.caption_at = [], len(self.parts)

    def handle_endtag(self, tag):
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
            return
        if self.silent:
            if self.silent[-1] in _RAW or tag not in _BREAKS:
                return
            self.silent.clear()  # an unclosed template ends where a block around it ends
        if tag == "figcaption" and self.caption is not None:
            self._end_caption()
        elif tag in _BREAKS:
            self._close()
            if tag == "figure" and self.figures:
                self._end_figure()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """The ordered parts of an HTML text; a figure's caption goes to all its media; null or empty: none."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.finish()


def interleaved(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, parts) of each row: an array of PART structs in document order.

    A null or empty page has no parts; rows that repeat and null keys pass
    through; columns of other names take no part.
    """
    kind = pages.schema[key].dataType.simpleString()
    part = pa.list_(pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "ref", "caption")]]))

    def run(batches):
        for batch in batches:
            parts = [parse_html(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, part)], names=[key, "parts"])

    return map_arrow(only(pages, key, html), run, f"`{key}` {kind}, parts array<{PART}>")


def padded(payload: bytes) -> bytes:
    """The payload with bytes 32 up to a positive multiple of ROW."""
    return payload.ljust(max(1, -(-len(payload) // ROW)) * ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, level: int = 1) -> bytes:
    """A payload as an image of 8-bit RGB samples that also tells the payload's length."""
    samples = np.frombuffer(padded(payload), np.uint8).reshape(-1, ROW)
    rows = np.zeros((len(samples), ROW + 1), np.uint8)  # each row after its filter byte 0
    rows[:, 1:] = samples
    header = struct.pack(">IIBBBBB", ROW // 3, len(samples), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"Length\0%d" % len(payload)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_image(image: bytes) -> tuple[bytes, int]:
    """(samples, length of the payload without padding) of what encode_image() made."""
    if not image.startswith(_SIGNATURE):
        raise ValueError("not an image")
    at, data, length, shape = len(_SIGNATURE), [], None, (0, 0)
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged image")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], 3 * shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that is not written here")
    return rows[:, 1:].tobytes(), len(rows) * 3 * shape[0] if length is None else length


def feature(samples: bytes) -> str:
    """Shape, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    deviation = max(0.0, float(counts @ np.arange(256) ** 2) / len(samples) - mean * mean) ** 0.5
    return f"{ROW // 3}x{len(samples) // ROW}x3 mean={mean:.3f} dev={deviation:.3f} entropy={float(-(share * np.log2(share)).sum()):.3f}"


def store_media(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write each row's text as an image to the shared folder: (key, digest, media), read from there.

    A row gives a row, repeated rows and null keys too; a null text is stored
    as an empty one.  Columns of other names take no part.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for block in blocks(rows, lambda r: len(r[1])):
                media = [encode_image(t) for _, t in block]
                digests = [hashlib.sha256(m).hexdigest() for m in media]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in block], batch.schema.field(0).type), pa.array(digests), pa.array(media, pa.binary())], names=[key, "digest", "media"])

    frame = map_arrow(only(docs, key, text).select(key, text_bytes(text).alias("raw")), run, f"`{key}` {kind}, digest string, media binary")
    path = fresh(spark, "media")
    frame.write.option("compression", "none").parquet(path)  # images are compressed already
    return spark.read.schema(frame.schema).parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """One row a digest with what the stored bytes, read back, give."""
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            out = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, length = decode_image(image)
                out.append((digest, length, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=names)

    read_back = map_arrow(media.select("digest", "media"), run, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read_back.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])


def resolve(sequences: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(key, position, caption, digest and the features) of each media part; a part whose digest is unknown keeps nulls."""
    parts = sequences.select(key, F.explode(F.filter("parts", lambda p: p["kind"] == "media")).alias("p"))
    wanted = parts.select(key, F.col("p.position").alias("position"), F.col("p.caption").alias("caption"), F.regexp_replace("p.ref", "^sha256:", "").alias("digest"))
    return wanted.join(features, "digest", "left")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an image and referred to from an interleaved sequence.

    One row per row of documents; a null text is stored as an empty one.  The
    page that refers to it has 0 to 15 paragraphs before its figure, by the
    digest's first digit, and the caption before or after the image, by its second.
    """
    media = store_media(spark, read(spark, sf_dir, "documents"))
    first, second = (F.conv(F.substring("digest", k, 1), 16, 10).cast("int") for k in (1, 2))
    image, caption = F.concat(F.lit('<img src="sha256:'), "digest", F.lit('">')), F.concat(F.lit("<figcaption>Payload "), F.substring("digest", 1, 8), F.lit("</figcaption>"))
    figure = F.when(second < 8, F.concat(caption, image)).otherwise(F.concat(image, caption))
    page = F.concat(F.lit("<article>"), F.repeat(F.lit("<p>Before.</p>"), first), F.lit("<figure>"), figure, F.lit("</figure><p>After.</p></article>"))
    sequences = interleaved(media.select("doc_id", page.alias("html")), key="doc_id")
    features = written(spark, media_features(media), "features")  # a shuffle of its own, so a join may split a digest with many references
    found = resolve(sequences, features, "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
