"""Bounded-space online best-fit packing of token pieces into sequences of a fixed length.

Open bins are keyed by free space in a bitset: the tightest bin that takes a piece is the lowest set
bit at or above its length. When a new bin would exceed the bound, the fullest open bin closes.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import pieces, stored, text_column, tidy
from framewright.llm.tokens import encoder, tokenizer_path


class BestFit:
    """Online best-fit over at most ``open_bins`` bins of ``capacity``; bins are numbered from ``first``."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.bits, self.open = 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _put(self, bin_id: int, free: int) -> None:
        if free == 0:
            return
        self.by_free[free].append(bin_id)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_id = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self._take(fullest)
            bin_id, free = self.next, self.capacity
            self.next += 1
        self._put(bin_id, free - length)
        return bin_id, self.capacity - free

    def still_open(self) -> set[int]:
        return {b for held in self.by_free.values() for b in held}


PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")] + [("done", pa.bool_())])
PIECE_DDL = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean"


class Placed:
    """Rows of placed pieces, 64 bytes each; those whose bin has closed leave, the others wait."""

    def __init__(self, packer: BestFit):
        self.packer, self.next_flush = packer, 1 << 16
        self.columns = [array("q") for _ in range(7)]
        self.null = array("b")

    def add(self, doc: int | None, piece: int, start: int, length: int, crc: int) -> None:
        for column, value in zip(self.columns, (doc or 0, piece, start, length, crc, *self.packer.add(length)), strict=True):
            column.append(value)
        self.null.append(doc is None)

    def full(self) -> bool:
        return len(self.null) >= self.next_flush

    def flush(self, last: bool = False) -> pa.RecordBatch:
        """The rows of closed bins; the ``last`` time all rows."""
        rows, null = [np.frombuffer(c, "i8") for c in self.columns], np.frombuffer(self.null, "i1").astype(bool)
        done = ~np.isin(rows[5], np.fromiter(self.packer.still_open(), "i8"))
        go = done | last
        out = [pa.array(rows[0][go], mask=null[go]), *(pa.array(c[go]) for c in rows[1:]), pa.array(done[go])]
        self.columns = [array("q", c[~go].tobytes()) for c in rows]
        self.null = array("b", null[~go].astype("i1").tobytes())
        self.next_flush = 2 * len(self.null) + (1 << 16)
        return pa.RecordBatch.from_arrays(out, schema=PIECE)


def _placed(rows, level: int, capacity: int, open_bins: int):
    """Pack a task's pieces (doc_id, piece, start, length, ids_crc32) as they stream by.

    A sequence is named by the round, the task and the bin, so that names differ and a retry keeps them.
    """
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    if level >= 1 << 5 or task >= 1 << 24:
        raise ValueError("too many rounds or partitions for the names of sequences")
    placed = Placed(BestFit(capacity, open_bins, (level << 58) | (task << 34)))
    for row in rows:
        placed.add(*row)
        if placed.full():
            yield placed.flush()
    yield placed.flush(True)


def encode_and_pack(docs: DataFrame, path: str, end_id: int, capacity: int, open_bins: int) -> DataFrame:
    """Encode each document, cut those over ``capacity``, and pack each partition as it streams by."""

    def run(batches):
        encode, end, width = encoder(path).encode, np.array([end_id], "<u4").tobytes(), 4 * capacity

        def rows():
            for batch in batches:
                for part in pieces(batch, "text"):
                    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        ids = encode(text) + end
                        for k, at in enumerate(range(0, len(ids), width)):
                            cut = ids[at : at + width]
                            yield doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)

        yield from _placed(rows(), 0, capacity, open_bins)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(tidy(run), PIECE_DDL)


def repack(rows: DataFrame, level: int, capacity: int, open_bins: int) -> DataFrame:
    """Pack the pieces of bins that were still open once more, one packer a partition."""

    def run(batches):
        columns = ("doc_id", "piece", "start", "length", "ids_crc32")
        yield from _placed((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)), level, capacity, open_bins)

    return rows.mapInArrow(tidy(run), PIECE_DDL)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, open_bins: int = 256, fan_in: int = 16) -> DataFrame:
    """Pack all documents of ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    Every partition packs its own stream with ``open_bins`` open bins. The pieces of bins that are
    still open at a partition's end go to other packers, each of which takes ``fan_in`` times the tokens
    that it can leave open; so every round leaves ``fan_in`` times fewer, until one packer takes the rest,
    longest first and with as many open bins as that rest can need.
    Null or empty texts are one end token. Rows with equal or null doc_id are packed as separate
    documents. A packer holds the pieces of its open bins only, however long a text or many the rows.
    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    share = fan_in * open_bins * capacity
    packed = stored(encode_and_pack(docs, path, end_id, capacity, open_bins), "packed")
    done, level = packed.where("done"), 0
    while tokens := packed.where("not done").agg(F.sum("length")).first()[0]:
        level, tasks = level + 1, -(-tokens // share)
        rest = packed.where("not done")
        if tasks == 1:
            one = rest.repartition(1).sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
            done = done.unionByName(stored(repack(one, level, capacity, 2 * fan_in * open_bins), "repacked"))
            break
        packed = stored(repack(rest.repartition(tasks), level, capacity, open_bins), "repacked")
        done = done.unionByName(packed.where("done"))
    return done.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 2048 word-BPE ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
