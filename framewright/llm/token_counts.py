"""Token counts without token ids: pieces of each distinct pretoken, joined to the documents' pretoken frequencies.

Documents are taken in blocks of some megabytes. A block keeps its distinct pretokens once and, for each
document, which of them it has and how often. The blocks' pretokens are dealt by pretoken, each is counted
once, and one number for each comes back to its blocks; a document's count is a sum of products.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import pieces, stored, text_column, tidy
from framewright.llm.tokens import UNSURE, Encoder, encoder, tokenizer_path

#: Bytes of the texts of a block; a longer text is a block by itself.
BLOCK = 16 << 20
#: A pretoken never goes on over a space behind a visible ASCII character, whatever follows.
SAFE_CUT = re.compile(r"(?<=[!-~])[ \n]")
BLOCKS = "block long, words array<string>, doc_ids array<long>, n_bytes array<long>, kinds array<int>, which binary, often binary"


def parts_of(text: str, size: int = 1 << 18) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where pretokens end in any case."""
    at = 0
    while len(text) - at > size and (m := SAFE_CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def frequencies(text: str, own: Encoder) -> Counter[str]:
    """How often each pretoken stands in the text, added tokens among them.

    Parts with characters outside the proven range are split by the library's own pretokenizer.
    """
    found: Counter[str] = Counter()
    segments = [text]
    for token in own.added:
        if token in text:
            cut = [s.split(token) for s in segments]
            found[token] += sum(len(c) - 1 for c in cut)
            segments = [x for c in cut for x in c]
    for part in (p for s in segments for p in parts_of(s)):
        if UNSURE.search(part):
            part = own.whole.normalizer.normalize_str(part) if own.lower else part
            found.update(part[a:b] for _, (a, b) in own.whole.pre_tokenizer.pre_tokenize_str(part))
        else:
            found.update(own.split(part.lower() if own.lower else part))
    return found


def shrunk(numbers: np.ndarray) -> bytes:
    """Whole numbers as their four byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unshrunk(data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), "u1")
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype("i8")


def frequency_blocks(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Stored blocks of ``docs(doc_id, text)``: distinct pretokens, and each document's (which, often) among them.

    ``kinds`` is the number of different pretokens of each document, whose pairs follow each other in
    ``which`` (ascending, as steps from the last) and ``often``.
    """

    def run(batches):
        from pyspark import TaskContext

        number, own = TaskContext.get().partitionId() << 32, encoder(path)
        for batch in batches:
            for piece in pieces(batch, "text", block):
                place: dict[str, int] = {}
                kinds, which, often = [], [], []
                for text in piece.column("text").to_pylist():
                    has = frequencies(text, own)
                    at = np.fromiter((place.setdefault(w, len(place)) for w in has), "i8", len(has))
                    order = np.argsort(at, kind="stable")
                    which.append(np.diff(at[order], prepend=0))
                    often.append(np.fromiter(has.values(), "i8", len(has))[order])
                    kinds.append(len(has))
                lists = [list(place), piece.column("doc_id").to_pylist(), pc.binary_length(piece.column("text")).to_pylist(), kinds]
                columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(lists, (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                columns += [pa.array([shrunk(np.concatenate(x))], pa.binary()) for x in (which, often)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], names=["block", "words", "doc_ids", "n_bytes", "kinds", "which", "often"])
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return stored(rows.mapInArrow(tidy(run, True), BLOCKS), "pretoken-blocks", "zstd")


def piece_counts(placed: DataFrame, path: str) -> DataFrame:
    """(block, cell) of ``placed(block, i, word)``: pieces of each pretoken, counted once by the library's model for all blocks that have it.

    A cell holds i and the number, i in the upper half.
    """

    def run(batches):
        own, last = encoder(path), (None, 0)
        for batch in batches:
            words = batch.column("word").dictionary_encode()  # in order of appearance, so equal ones of two batches meet
            made = []
            for w in words.dictionary.to_pylist():
                if w != last[0]:
                    last = (w, 1 if w in own.added else len(own.model.tokenize("".join([own.letters[b] for b in w.encode()]))))
                made.append(last[1])
            cell = (batch.column("i").to_numpy().astype("i8") << 32) | np.array(made, "i8")[words.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(cell)], names=["block", "cell"])

    return placed.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(run), "block long, cell long")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document of blocks with their pretokens' counts."""
    for batch in batches:
        for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
            flat = {c: row.column(c).flatten() for c in ("doc_ids", "n_bytes", "kinds", "counts")}
            counts, cell = np.zeros(len(flat["counts"]), "i8"), flat["counts"].to_numpy()
            counts[cell >> 32] = cell & 0xFFFFFFFF
            kinds = flat["kinds"].to_numpy().astype("i8")
            ends = np.cumsum(kinds)
            steps, often = (unshrunk(row.column(c)[0].as_py()) for c in ("which", "often"))
            running = np.concatenate([[0], np.cumsum(steps)])
            which = running[1:] - np.repeat(running[ends - kinds], kinds)
            running = np.concatenate([[0], np.cumsum(counts[which] * often)])
            yield pa.RecordBatch.from_arrays([flat["doc_ids"], flat["n_bytes"], pa.array(running[ends] - running[ends - kinds])], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs(doc_id, text)`` by the tokenizers file at ``path``.

    The counts are those of the library's defaults: no begin or end tokens, the string of an added token
    in a text is that token, nothing is cut. Every row has its own result, also repeated rows, other texts
    of one doc_id and rows with a null doc_id. A null text is an empty one, with no byte and no token; a text
    of any length is counted whole, in parts that end where pretokens do. An empty table has no rows.
    """
    blocks = frequency_blocks(docs, path, block)
    placed = blocks.select("block", F.posexplode("words").alias("i", "word"))
    found = piece_counts(placed, path).groupBy("block").agg(F.collect_list("cell").alias("counts"))  # a block's own pretokens
    whole = blocks.select("block", "doc_ids", "n_bytes", "kinds", "which", "often").join(found, "block", "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<long>")))
    rows = whole.mapInArrow(tidy(summed), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-BPE token counts of all documents, and whether they are over 1024.

    A row a document; the awkward cases are those of ``count_tokens``.
    """
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
