"""WARC archives: whole-file gzip streams rewritten as one member a record, with an offset index.

Crawls often arrive as one gzip stream a file, which no reader can enter in the middle. The
normaliser inflates such a stream once, writes each record as a gzip member of its own, turns repeated
payloads into revisit records, and keeps a sidecar index of offsets for random reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import delete_folder, filesystem, group_minimum, new_folder, pieces, stored, tidy

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: bytes, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One uncompressed record."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, *(k + b": " + v for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join([*lines, b"", b""]) + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes) -> bytes:
    """The response record of a page; a null id or url leaves its header out."""
    headers = [(b"WARC-Record-ID", b"<urn:page:%d>" % page_id)] if page_id is not None else []
    if url is not None:
        headers.append((b"WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode())))
    headers += [(b"WARC-Date", b"2024-01-01T00:00:00Z"), (b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(digest))]
    return record(b"response", headers, HTTP % len(payload) + payload)


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Inflate a gzip file of one member or many, piece by piece."""
    state = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            out = state.decompress(chunk)
            if out:
                yield out
            chunk = state.unused_data if state.eof else b""
            if state.eof:
                state = zlib.decompressobj(31)


def parse_head(head: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-case name; ``b""`` is the version line."""
    first, *rest = head.split(b"\r\n")
    return {b"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in rest)}


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields and block of each record of an inflated stream."""
    held, source = bytearray(), iter(chunks)

    def more() -> bool:
        chunk = next(source, None)
        if chunk is None:
            return False
        held.extend(chunk)
        return True

    while True:
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not more():
                if held.strip():
                    raise ValueError("the stream ends inside a record's header")
                return
            at = held.find(b"\r\n\r\n")
        head = parse_head(bytes(held[:at]))
        size = int(head[b"content-length"])
        while len(held) < at + 4 + size + 4:
            if not more():
                raise ValueError("the stream ends inside a record")
        yield head, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size + 4]


def rebuilt(head: dict[bytes, bytes], block: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The record's bytes again, as a revisit without its payload if it repeats another."""
    names = {b"warc-record-id": b"WARC-Record-ID", b"warc-target-uri": b"WARC-Target-URI", b"warc-date": b"WARC-Date", b"content-type": b"Content-Type", b"warc-payload-digest": b"WARC-Payload-Digest"}
    headers = [(names.get(k, k), v) for k, v in head.items() if k not in (b"", b"warc-type", b"content-length")]
    if not revisit:
        return record(head[b"warc-type"], headers, block)
    headers.append((b"WARC-Profile", PROFILE))
    if refers_to is not None:
        headers.append((b"WARC-Refers-To", b"<urn:page:%d>" % refers_to))
    return record(b"revisit", headers, block[: block.index(b"\r\n\r\n") + 4])


MANIFEST = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("page_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64())])
INDEX = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_monolithic(pages: DataFrame, folder: str, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write a response record a row of ``pages(page_id, url, html)`` into whole-file gzip streams; returns the stored record list.

    A null html is an empty payload, a null url or page_id leaves its header out, and repeated rows are
    written each. A page is held whole, whatever its length; an empty table writes nothing. A file ends after ``roll_bytes`` of records. Each attempt of a task writes files of its own names,
    and the stored list names those of the attempt that counted.
    """

    def run(batches):
        fs, where = filesystem(folder)
        fs.create_dir(where, recursive=True)
        out = packed = None
        name, seq, size = "", 0, 0
        for batch in batches:
            for part in pieces(batch, "html"):
                rows = []
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if out is None:
                        name, seq, size = uuid.uuid4().hex, 0, 0
                        out, packed = fs.open_output_stream(f"{where}/{name}.warc.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    payload = (html or "").encode()
                    digest = hashlib.sha1(payload).digest()
                    data = page_record(page_id, url, payload, digest)
                    out.write(packed.compress(data))
                    rows.append((name, seq, page_id, digest, len(payload)))
                    seq, size = seq + 1, size + len(data)
                    if size >= roll_bytes:
                        out.write(packed.flush())
                        out.close()
                        out = None
                yield batch_of(rows, MANIFEST)
        if out is not None:
            out.write(packed.flush())
            out.close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(rows.mapInArrow(tidy(run, True), "file string, seq long, page_id long, digest binary, n_bytes long"), "warc-records")


def revisits(manifest: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Records that repeat another's payload: (file, seq, refers_to).

    The largest page_id keeps its payload, one record of it where rows repeat; a null page_id is the
    smallest. Records of a null page_id that revisit each other refer to null.
    """
    long_ones = manifest.where(F.col("n_bytes") >= least_bytes).select("digest", "n_bytes", F.struct("page_id", "file", "seq").alias("at"))
    led = group_minimum(long_ones, ["digest", "n_bytes"], "at", pick=F.max)
    return led.where("at <> leader").select("at.file", "at.seq", F.col("leader.page_id").alias("refers_to"))


def normalise(manifest: DataFrame, repeats: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each whole-file stream as one member a record, with a sidecar index; returns the stored index."""
    files = manifest.select("file").distinct()
    count = max(1, files.count())
    turned = repeats.groupBy("file").agg(F.collect_list(F.struct("seq", "refers_to")).alias("turned"))  # at most the records of one file
    work = files.join(turned, "file", "left").repartition(count, "file")

    def run(batches):
        fs_in, where_in = filesystem(source)
        fs, where = filesystem(target)
        fs.create_dir(where, recursive=True)
        for batch in batches:
            for file, turned in zip(batch.column("file").to_pylist(), batch.column("turned").to_pylist(), strict=True):
                turn = {x["seq"]: x["refers_to"] for x in turned or ()}
                made, at, name = [], 0, f"{file}-{uuid.uuid4().hex}"
                with fs_in.open_input_stream(f"{where_in}/{file}.warc.gz", compression=None) as stream, fs.open_output_stream(f"{where}/{name}.warc.gz", compression=None) as out:
                    for seq, (head, block) in enumerate(records(inflated(iter(lambda: stream.read(1 << 20), b"")))):
                        packed = zlib.compressobj(4, zlib.DEFLATED, 31)
                        data = packed.compress(rebuilt(head, block, turn.get(seq), seq in turn)) + packed.flush()
                        out.write(data)
                        made.append((name, seq, at, len(data)))
                        at += len(data)
                with fs.open_output_stream(f"{where}/{name}.idx") as side:
                    side.write("".join(f"{s} {o} {n}\n" for _, s, o, n in made).encode())
                yield batch_of(made, INDEX)

    return stored(work.mapInArrow(tidy(run, True), "file string, seq long, offset long, length long"), "warc-index")


def parsed(member: bytes) -> tuple:
    """A row of OUT from one gzip member."""
    head, block = next(records(inflated([member])))
    kind = head[b"warc-type"].decode()
    at = block.index(b"\r\n\r\n") + 4
    if kind == "revisit":
        size = int(parse_head(block[: at - 4])[b"content-length"])
        digest = base64.b32decode(head[b"warc-payload-digest"][5:]).hex()
    else:
        size, digest = len(block) - at, hashlib.sha1(memoryview(block)[at:]).hexdigest()
    ids = [int(x[10:-1]) if (x := head.get(k)) else None for k in (b"warc-record-id", b"warc-refers-to")]
    url = head.get(b"warc-target-uri")
    return ids[0], size, digest, kind, ids[1], None if url is None else url.decode()


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the indexed records by offset; each needs its own member only."""
    count = max(1, index.select("file").distinct().count())

    def run(batches):
        fs, where = filesystem(folder)
        name = source = None
        for batch in batches:
            rows = []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{where}/{file}.warc.gz")
                rows.append(parsed(source.read_at(size, at)))
            yield batch_of(rows, OUT)
        if source is not None:
            source.close()

    dealt = index.repartition(count, "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(tidy(run, True), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to whole-file streams, normalise those, and read the records back by offset.

    A row a page; the awkward cases are those of ``write_monolithic`` and ``revisits``.
    """
    first, last = new_folder(spark, "warc-streams"), new_folder(spark, "warc")
    manifest = write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), first)
    index = normalise(manifest, revisits(manifest), first, last)
    delete_folder(first)
    return read_records(index, last)
