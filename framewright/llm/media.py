"""Media columns: interleaved document sequences whose media are resolved by digest.

HTML becomes an ordered list of text and media structs. Media live once each in container files as
8-bit grey PNG images; a reference carries a digest, and a join on it finds the stored bytes, so that
no payload moves through a shuffle and each item keeps its position and caption.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import filesystem, new_folder, pieces, spread_join, stored, text_column, tidy

WIDTH = 192
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
SCHEME = "sha256:"
SILENT = {"script", "style", "template"}
MEDIA = {"img", "audio", "video", "source", "embed"}


class _Sequence(HTMLParser):
    """Collects the items of one page in reading order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in MEDIA:
            given = dict(attrs)
            source = given.get("src") or ""
            if source:
                self.flush()
                if self.figure:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "digest": source.removeprefix(SCHEME) if source.startswith(SCHEME) else hashlib.sha256(source.encode()).hexdigest(), "caption": given.get("alt")})
        elif tag == "figure":
            self.flush()
            self.figure = [-1]
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "li", "br", "h1", "h2", "h3", "h4", "article", "section", "tr"):
            self.flush() if tag != "br" else self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            owners = [i for i in self.figure if i >= 0]
            for i in owners:
                self.items[i]["caption"] = text
            if not owners and text:
                self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "article", "section", "tr"):
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_interleaved(html: str | None) -> list[dict]:
    """Items of a page in order: position, kind (text or media), text, digest, caption.

    A media source of the form ``sha256:<hex>`` names its payload; any other source has the digest of
    its own address. A caption goes to the media of its figure. Null or empty pages have no items.
    """
    page = _Sequence()
    page.feed(html or "")
    page.close()
    page.flush()
    return [{"position": i} | x for i, x in enumerate(page.items)]


def interleaved(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, items) with the parsed sequence of each row's HTML."""
    kind = pages.schema[key].dataType.simpleString()
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_html"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse_interleaved(x) for x in part.column(1).to_pylist()], pa.list_(item))], names=[key, "items"])

    return pages.select(F.col(key), F.col(html).alias("_html")).mapInArrow(tidy(run, True), f"`{key}` {kind}, items array<{ITEM}>")


def resolve(sequences: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """(key, position, digest, caption, before, after, media columns) of each media item whose digest ``media`` holds.

    ``before`` and ``after`` are the texts next to the item in its sequence, null at the page's ends or beside other
    media, so that a payload stays where it stood.
    """
    beside = lambda i: F.get("items", F.col("p") + i)
    text = lambda i: F.when((F.col("p") + i >= 0) & (beside(i)["kind"] == "text"), beside(i)["text"])
    items = sequences.select(key, "items", F.posexplode("items").alias("p", "item")).where("item.kind = 'media'")
    own = items.select(key, "item.position", "item.digest", "item.caption", text(-1).alias("before"), text(1).alias("after"))
    return spread_join(own, media, ["digest"], [key, "position"])


def to_png(payload: bytes) -> bytes:
    """8-bit grey PNG, 192 samples a line; the payload's length is a multiple of that."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 6)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote."""
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a line has a filter")
    return lines[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def feature_of(samples: bytes) -> str:
    """Average hash of an 8 x 8 reduction (sample order), mean and standard deviation."""
    x = np.frombuffer(samples, np.uint8).astype("f8")
    cells = np.add.reduceat(x, np.arange(64) * len(x) // 64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = int("".join("1" if c > x.mean() else "0" for c in cells), 2)
    return f"{bits:016x}:{x.mean():.4f}:{x.std():.4f}"


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def store_documents(docs: DataFrame, folder: str, roll_bytes: int = 16 << 20, remember: int = 50_000) -> DataFrame:
    """Store each text's padded bytes as an image and write the page that refers to it; returns the stored list.

    The page has the image in the middle of its texts: a heading, none to two paragraphs by the doc_id, the figure
    with its caption, and a closing one. A payload that a task has lately stored is not stored again. Files end after ``roll_bytes`` of
    payload. A null text is empty and has the image of 192 spaces; equal texts have equal images; repeated rows,
    other texts of one doc_id and null doc_ids have a page each; a text is stored whole, however long; an empty
    table makes no file.
    """

    def run(batches):
        fs, where = filesystem(folder)
        fs.create_dir(where, recursive=True)
        out, name, at, raw = None, "", 0, 0
        seen: dict[str, tuple] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = text.encode()
                    payload = padded(own)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in seen:
                        if out is None:
                            name, at, raw = uuid.uuid4().hex, 0, 0
                            out = fs.open_output_stream(f"{where}/{name}.media")
                        data = to_png(payload)
                        out.write(data)
                        if len(seen) >= remember:
                            seen.clear()
                        seen[digest] = (name, at, len(data))
                        at, raw = at + len(data), raw + len(payload)
                        if raw >= roll_bytes:
                            out.close()
                            out = None
                    lead = "".join(f"<p>Part {k} before {doc}</p>" for k in range((doc or 0) % 3))
                    html = f'<article><h1>Document {doc}</h1>{lead}<figure><img src="{SCHEME}{digest}"><figcaption>{len(own)} bytes</figcaption></figure><p>End of {doc}</p></article>'
                    rows.append((doc, len(own), html, digest, *seen[digest]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KEPT, strict=True)], schema=KEPT)
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return stored(rows.mapInArrow(tidy(run, True), "doc_id long, n_bytes long, html string, digest string, file string, offset long, length long"), "media-list")


def read_media(places: DataFrame, folder: str) -> DataFrame:
    """Read stored media of ``places(digest, file, offset, length)`` and describe each."""
    count = max(1, places.select("file").distinct().count())
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        fs, where = filesystem(folder)
        name = source = None
        for batch in batches:
            rows = []
            for digest, file, at, size in zip(*(batch.column(c).to_pylist() for c in ("digest", "file", "offset", "length")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{where}/{file}.media")
                data = source.read_at(size, at)
                samples = from_png(data)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
        if source is not None:
            source.close()

    dealt = places.repartition(count, "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(tidy(run, True), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all texts as images, parse the pages that refer to them, and join what is read back by digest.

    A row a document, with the image's place among the page's texts, its caption and the texts beside it; the awkward
    cases are those of ``store_documents``.
    """
    folder = new_folder(spark, "media")
    made = store_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    places = made.groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("at")).select("digest", "at.*")
    media = stored(read_media(places, folder), "media-features")
    pages = made.select(F.struct("doc_id", "n_bytes").alias("page"), "html")
    found = resolve(interleaved(pages, "page", "html"), media, "page")
    return found.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "before", "after")
