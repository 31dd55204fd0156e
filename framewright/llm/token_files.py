"""Token-id Parquet files: list columns, controlled row groups, page indexes, selective reads.

A document's ids form one list row. ids are dictionary-coded where the vocabulary fits 16 bits and
delta-coded otherwise; row groups end at a token budget, so that a reader gets a document or a
metadata column without touching the rest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.base import filesystem, new_folder, pieces, stored, text_column, tidy
from framewright.llm.tokens import encoder, tokenizer_path

FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.uint32()))])
MANIFEST = "part int, file string, row_group int, first_row long, n_docs long, n_tokens long, file_start long, least_doc long, largest_doc long, bytes long"
#: Documents a page holds at most, so that the page index tells them apart.
PAGE_ROWS = 16
FILE_DDL = "doc_id long, start_in_file long, n_tokens long, ids array<long>"


def write_partition(batches: Iterator[pa.RecordBatch], part: int, folder: str, path: str, end_id: int, group_tokens: int, delta: bool) -> Iterator[tuple]:
    """Encode the texts of one sorted partition into one file; yields a manifest row for each row group."""
    encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
    name = f"part-{part:06d}-{uuid.uuid4().hex}.parquet"
    writer = out = None
    docs: list[int | None] = []
    ids: list[bytes] = []
    held = total = group = rows = 0
    made = []

    def flush():
        nonlocal held, total, group, rows, writer, out
        if not docs:
            return
        if writer is None:
            fs, where = filesystem(folder)
            fs.create_dir(where, recursive=True)
            out = fs.open_output_stream(f"{where}/{name}")
            coding = {"column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED", "start_in_file": "DELTA_BINARY_PACKED"}, "use_dictionary": False} if delta else {"use_dictionary": ["ids.list.element"], "dictionary_pagesize_limit": 4 << 20}
            writer = pq.ParquetWriter(out, FILE_SCHEMA, compression="zstd", compression_level=1, write_page_index=True, data_page_size=256 << 10, max_rows_per_page=PAGE_ROWS, write_statistics=["doc_id", "start_in_file", "n_tokens"], **coding)
        sizes = np.array([len(x) // 4 for x in ids], "i8")
        ends = np.cumsum(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        starts = total + ends - sizes
        writer.write_table(pa.table([pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes), lists], schema=FILE_SCHEMA), row_group_size=len(docs))
        known = [d for d in docs if d is not None]
        made.append((part, name, group, rows, len(docs), int(ends[-1]), total, known[0] if known else None, known[-1] if known else None))
        total, rows, group = total + int(ends[-1]), rows + len(docs), group + 1
        docs.clear()
        ids.clear()
        held = 0

    for batch in batches:
        for row, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            docs.append(row)
            ids.append(encode(text) + end)
            held += len(ids[-1]) // 4
            if held >= group_tokens:
                flush()
    flush()
    if writer is not None:
        writer.close()
        out.close()
        fs, where = filesystem(folder)
        size = fs.get_file_info(f"{where}/{name}").size
        yield from ((*x, size) for x in made)


def ranges(rows: DataFrame, range_bytes: int) -> tuple[int, ...]:
    """The number of ranges for so many bytes of text each; nothing where the session's own number is enough."""
    whole = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-whole // range_bytes)
    return (parts,) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, group_tokens: int = 1 << 19, delta: bool = False, range_bytes: int = 512 << 20) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order; returns the stored manifest.

    Documents are dealt by ranges of doc_id and, within one, of the text's hash, so the files hold consecutive
    ranges, a doc_id that many rows share (null too) is dealt to many tasks, and only whole texts move, once. The
    counted bytes make the ranges: one holds about ``range_bytes`` of text at most, however large the table.
    Null ids come first; equal ids are ordered by the hash of the text. A null text is empty and has only
    the end id; repeated rows are written each; a text is encoded whole, its ids never leave the task but
    in the file. An empty table has no files. The manifest has a row for each row group; ``start`` is the number of ids before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    ordered = rows.repartitionByRange(*ranges(rows, range_bytes), *order).sortWithinPartitions(*order, "text")

    def write(batches):
        from pyspark import TaskContext

        cut = (p for b in batches for p in pieces(b, "text"))
        rows = list(write_partition(cut, TaskContext.get().partitionId(), folder, path, end_id, group_tokens, delta))
        yield pa.RecordBatch.from_pydict(dict(zip(("part", "file", "row_group", "first_row", "n_docs", "n_tokens", "file_start", "least_doc", "largest_doc", "bytes"), map(list, zip(*rows, strict=True)) if rows else [[]] * 10, strict=True)), schema=MANIFEST_ARROW)

    made = stored(ordered.mapInArrow(tidy(write), MANIFEST), "token-manifest")
    files = made.groupBy("part", "file").agg(F.sum("n_tokens").alias("in_file"))
    # One row a file: a running sum over the file list, not over documents.
    before = files.select("file", (F.sum("in_file").over(Window.orderBy("part")) - F.col("in_file")).alias("before"))
    return stored(made.join(before, "file").withColumn("start", F.col("before") + F.col("file_start")).drop("before"), "token-index")


MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("file", pa.string()), ("row_group", pa.int32()), ("first_row", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file_start", pa.int64()), ("least_doc", pa.int64()), ("largest_doc", pa.int64()), ("bytes", pa.int64())])


def read_row_groups(index: DataFrame, folder: str, columns: list[str], make, schema: str) -> DataFrame:
    """Read chosen columns of the indexed row groups and turn each into a batch with ``make(table, start)``."""

    def read(batches):
        held = (None, None, None)
        for batch in batches:
            for file, group, start in zip(*(batch.column(c).to_pylist() for c in ("file", "row_group", "start")), strict=True):
                if held[0] != file:
                    if held[2] is not None:
                        held[2].close()
                    fs, where = filesystem(folder)
                    source = fs.open_input_file(f"{where}/{file}")
                    held = (file, pq.ParquetFile(source), source)
                yield make(held[1].read_row_group(group, columns=columns), start)
        if held[2] is not None:
            held[2].close()

    return index.select("file", "row_group", "start").mapInArrow(tidy(read), schema)


def digests(table: pa.Table, start: int) -> pa.RecordBatch:
    """Per document of a row group: its place among all ids, its length and the checksum of its ids."""
    ids = table.column("ids").combine_chunks()
    values = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)).view(np.uint8)
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype("i8"))
    sizes = np.diff(ends, prepend=0)
    crcs = [zlib.crc32(values[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(index: DataFrame, folder: str, doc_ids: list[int], columns: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """Chosen columns of the documents with the given ids (a stated, short list).

    The index names the files whose id ranges match; in those, statistics of row groups and the page
    index leave other pages unread, and other columns are not touched.
    """
    spark = index.sparkSession
    wanted = F.array(*[F.lit(int(d)) for d in doc_ids]) if doc_ids else F.array().cast("array<bigint>")
    near = F.exists(wanted, lambda d: (d >= F.col("least_doc")) & (d <= F.col("largest_doc")))
    files = sorted(r.file for r in index.where(near).select("file").distinct().collect())
    if not files:
        return spark.createDataFrame([], FILE_DDL).select(*columns)
    found = spark.read.schema(FILE_DDL).parquet(*[f"{folder}/{f}" for f in files])
    return found.where(F.col("doc_id").isin(doc_ids)).select(*columns)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the byte-BPE ids of all documents to token files and digest what is read back.

    A row a document; the awkward cases are those of ``write_token_files``.
    """
    folder = new_folder(spark, "token-files")
    index = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_row_groups(index, folder, ["doc_id", "ids"], digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
