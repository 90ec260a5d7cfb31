"""Media columns: interleaved document sequences.

HTML becomes an ordered list of text and media-reference structs. Media are stored once
per digest in a table of their own, and a join by digest resolves references, so that
positions, captions and payloads stay aligned. Byte payloads are stored losslessly as
PNG images of 8-bit RGB samples, 64 pixels a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, small_batches, stored, take_over, text_bytes

#: Samples of a row: 64 pixels of 3.
ROW = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
REFERENCE = "sha256:"
ITEM = "struct<pos: int, kind: string, text: string, digest: string, url: string, caption: string>"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_of(payload: bytes, level: int = 6) -> bytes:
    """A PNG whose samples, row by row, are the payload: a positive multiple of ROW bytes. Equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line starts with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def payload_of(png: bytes) -> bytes:
    """The samples of an image that png_of wrote; anything else raises ValueError."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body = 8, None, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        part = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, size, depth, colour, *rest = struct.unpack(">IIBBBBB", part)
            if (width, depth, colour, *rest) != (ROW // 3, 8, 2, 0, 0, 0):
                raise ValueError("not a payload image")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, and mean and deviation of each colour, of the image."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    mean, dev = samples.mean(0), samples.std(0)
    return f"rgb64x{len(payload) // ROW};mean=" + ",".join(f"{v:.3f}" for v in mean) + ";std=" + ",".join(f"{v:.3f}" for v in dev)


class _Items(HTMLParser):
    """Texts and media references in document order."""

    _SKIP = frozenset(("script", "style", "template", "noscript"))
    _BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table td th article section nav header footer blockquote pre figure figcaption hr".split())
    _MEDIA = frozenset(("img", "audio", "video", "source", "embed"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._skip = 0
        self._caption: list[str] | None = None
        self._figure: list[dict] | None = None
        self._captions: list[tuple[int, str]] = []

    def end_caption(self) -> None:
        if self._caption is not None:
            words = " ".join("".join(self._caption).split())
            if words:
                self._captions.append((len(self.items), words))
            self._caption = None

    def end_figure(self) -> None:
        """The last caption is that of all media of the figure; other captions, and all of a figure without media, are texts."""
        self.end_caption()
        if self._figure and self._captions:
            _, words = self._captions.pop()
            for item in self._figure:
                item["caption"] = words
        for at, words in reversed(self._captions):
            self.items.insert(at, {"kind": "text", "text": words})
        self._captions.clear()
        self._figure = None

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self._SKIP:
            self._skip += 1
        elif tag in self._MEDIA:
            a = dict(attrs)
            src = a.get("src") or ""
            if src:
                self._flush()
                item = {"kind": "media", "caption": a.get("alt") or None}
                item["digest" if src.startswith(REFERENCE) else "url"] = src.removeprefix(REFERENCE)
                self.items.append(item)
                if self._figure is not None:
                    self._figure.append(item)
        elif tag in self._BREAK:
            self._flush()
            if tag == "figure":
                self.end_figure()
                self._figure = []
            elif tag == "figcaption":
                self.end_caption()
                self._caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SKIP:
            self._skip = max(0, self._skip - 1)
        elif tag == "figcaption" and self._caption is not None:
            self.end_caption()
        elif tag in self._BREAK:
            self._flush()
            if tag == "figure":
                self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)


def items_of(html: str | None) -> list[dict]:
    """[{pos, kind, text, digest, url, caption}] of a page; none for null or empty HTML.

    A figure's last caption is that of all media in it; without one, the alt text is. Any other caption is a text of
    its own; an open one ends with its figure or the page. Text of scripts and styles is no item.
    """
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    parser.end_figure()
    return [{"pos": i, "text": None, "digest": None, "url": None, "caption": None} | x for i, x in enumerate(parser.items)]


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id and items (array of ITEM) of each page; ids may be null or repeat, other columns are ignored."""
    ddl = f"{id_col} long, items array<{ITEM}>"
    schema = arrow_schema(ddl)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for big in batches:
            for batch in small_batches(big, html_col, 4 << 20):
                yield pa.record_batch([batch.column(id_col).cast(pa.int64()), pa.array([items_of(h) for h in batch.column(html_col).to_pylist()], schema.field("items").type)], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInArrow(parse, ddl)


#: A digest with more references than HOT_LEAST, and than one of HOT_SHARE of all, is dealt to several tasks.
HOT_LEAST, HOT_SHARE = 1_024, 65_536


def resolve(sequences: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """One row per media reference: id, pos, caption, digest and the media's columns (null where its digest is unknown).

    media has one row per digest. Hot digests are counted first: their references are dealt out in parts by id, position and
    source partition, and each part meets a copy of the media's row. There are fewer than HOT_SHARE hot digests, so their
    list may be broadcast. References by URL alone have no digest to meet and are dealt out likewise.
    """
    refs = sequences.select(id_col, F.size("items").alias("n_items"), F.explode(F.expr("filter(items, i -> i.kind = 'media')")).alias("m"))
    flat = refs.select(id_col, "n_items", F.col("m.pos").alias("pos"), F.col("m.caption").alias("caption"), F.col("m.digest").alias("digest"))
    bar = max(HOT_LEAST, flat.count() // HOT_SHARE)
    counted = flat.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("_refs"))
    hot = F.broadcast(counted.where(F.col("_refs") > bar).select("digest", F.ceil(F.col("_refs") / bar).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.when(F.col("digest").isNull(), HOT_SHARE).otherwise(1))
    dealt = flat.join(hot, "digest", "left").withColumn("_part", F.pmod(F.xxhash64(id_col, "pos", F.spark_partition_id()), parts).cast("int"))
    copies = media.join(hot, "digest", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(copies.drop("_parts"), ["digest", "_part"], "left").drop("_part")


def page_of(digest: str, title: str, text: str) -> str:
    return f'<article><h1>{escape(title)}</h1><figure><img src="{REFERENCE}{digest}" alt=""><figcaption>{escape(text)}</figcaption></figure></article>'


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> tuple[DataFrame, DataFrame, str]:
    """Stores each whole text as media and refers to it: (sequences, media table, its path).

    A payload is the text in UTF-8 with bytes 32 up to a positive multiple of ROW; null is the empty text. Each
    task stores a digest once; the table may hold it again from other tasks. Sequences: id, n_bytes and items of
    a page whose figure refers to the payload by digest, with the text's size and digest as a caption of bounded length.
    Very long texts are stored whole; repeated rows and ids each have their sequence.
    """
    ddl = f"{id_col} long, n_bytes long, items array<{ITEM}>, digest string, png binary"
    schema = arrow_schema(ddl)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        given: set[bytes] = set()
        for big in batches:
            for batch in small_batches(big, text_col, 4 << 20):
                data, at = text_bytes(batch.column(text_col))
                raw, items, digests, pngs = data.tobytes(), [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    payload = raw[a:b] + b" " * (-(b - a) % ROW if b > a else ROW)
                    digest = hashlib.sha256(payload)
                    items.append(items_of(page_of(digest.hexdigest(), f"{b - a} bytes", f"{b - a} bytes & {digest.hexdigest()[:12]}")))
                    if digest.digest() in given:
                        digests.append(None)
                        pngs.append(None)
                    else:
                        if len(given) < 500_000:
                            given.add(digest.digest())
                        digests.append(digest.hexdigest())
                        pngs.append(png_of(payload, level))
                yield pa.record_batch(
                    [batch.column(id_col).cast(pa.int64()), pa.array(np.diff(at)), pa.array(items, schema.field("items").type), pa.array(digests, pa.string()), pa.array(pngs, pa.binary())],
                    schema=schema,
                )

    table, path = stored(docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(store, ddl), "media")
    return table.select(id_col, "n_bytes", "items"), table.where("digest is not null").select("digest", "png"), path


def media_facts(media: DataFrame) -> DataFrame:
    """Reads stored images back; one row per digest: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Payloads stay where they are read: only facts are shuffled, pre-aggregated by digest.
    """
    ddl = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = arrow_schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for batch in batches:
            rows = []
            for digest, png in zip(batch.column("digest").to_pylist(), batch.column("png"), strict=True):
                png = png.as_py()
                p = payload_of(png)
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(p)))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    facts = media.mapInArrow(read, ddl)
    columns = [f.name for f in schema if f.name != "digest"]
    return facts.groupBy("digest").agg(F.min(F.struct(*columns)).alias("facts")).select("digest", *(F.col(f"facts.{c}").alias(c) for c in columns))
