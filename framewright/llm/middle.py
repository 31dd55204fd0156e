"""Fill-in-middle transformation, cut at units of the text by a sparse checkpoint index.

Counting a text's units leaves a checkpoint, the byte and code-point offset, after every so many units. A
cut is found by binary search over the checkpoints and a short scan from there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import pieces, text_column, tidy

#: A unit of the text (white space is ASCII, so that bytes and code points cut alike), and the marks.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between checkpoints, and bytes that are counted at a time.
EVERY, WINDOW = 256, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Checkpoints:
    """Number of units of a UTF-8 text, and its byte and code-point offsets after every ``every`` units."""

    def __init__(self, text: bytes, every: int = EVERY, window: int = WINDOW):
        self.text, self.every = text, every
        self.units, self.bytes, self.chars = [0], [0], [0]
        count = points = 0
        raw = np.frombuffer(text, np.uint8)
        for at in range(0, len(raw), window):
            own = raw[at : at + window]
            space = _SPACE[own]
            follows = np.append(space[1:], _SPACE[raw[at + window]] if at + window < len(raw) else True)
            ends = np.flatnonzero(~space & follows) + 1  # a unit ends behind its last visible byte
            lead = (own & 0xC0) != 0x80
            marks = ends[every - 1 - count % every :: every]
            if len(marks):
                seen = np.concatenate([[0], np.cumsum(lead)])
                self.units += range((count // every + 1) * every, (count + len(ends)) // every * every + 1, every)
                self.bytes += (at + marks).tolist()
                self.chars += (points + seen[marks]).tolist()
            count += len(ends)
            points += int(np.count_nonzero(lead))
        self.n = count + bool(len(raw) and _SPACE[raw[-1]])  # white space at the end is a unit
        self.length = points

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset behind ``unit`` units."""
        if unit >= self.n:
            return len(self.text), self.length
        k = bisect_right(self.units, unit) - 1
        at = start = self.bytes[k]
        for _ in range(unit - self.units[k]):
            at = UNIT.match(self.text, at).end()
        return at, self.chars[k] + int(np.count_nonzero((np.frombuffer(self.text[start:at], np.uint8) & 0xC0) != 0x80))


def draws(key: str) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex sha256 of the key."""
    from hashlib import sha256

    return tuple(int.from_bytes(sha256(key.encode()).digest()[4 * k : 4 * k + 4], "big") for k in range(4))


def transformed(text: bytes, key: str, rate: int, spm: int, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    h1, h2, h3, h4 = draws(key)
    index = Checkpoints(text, every)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not text or h3 % 100 >= rate or p in text or s in text or m in text:
        return index.n, "plain", None, None, text
    (a, first), (b, second) = (index.cut(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return index.n, "spm", first, second - first, b"".join([s, suffix, p, prefix, m, middle])
    return index.n, "psm", first, second - first, b"".join([p, prefix, s, suffix, m, middle])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from.

    A mark begins with the only ``<`` in it and the text holds no mark, so the first of each kind is the mark itself.
    """
    part = lambda after, before: F.substring_index(F.substring(output, F.instr(output, after) + len(after), F.length(output)), before, 1) if before else F.substring(output, F.instr(output, after) + len(after), F.length(output))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, every: int = EVERY) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of ``docs(doc_id, text)``.

    Cuts and form are drawn from the sha256 of ``seed:doc_id``: of a hundred texts about ``rate`` are transformed,
    and of those ``spm`` of a hundred have the suffix first. Texts that are empty or hold a mark stay
    plain. A null text is an empty one; a null doc_id draws as an empty one; repeated rows are transformed each, equal
    rows alike. A text of any length is indexed in windows of a megabyte and cut whole; an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids = piece.column("doc_id").to_pylist()
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                made = [transformed(t, f"{seed}:{'' if i is None else i}", rate, spm, every) for i, t in zip(ids, texts, strict=True)]
                n, form, prefix, middle, out = map(list, zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, as digests of the output and of the text restored from it.

    A row a document; the awkward cases are those of ``fill_in_middle``.
    """
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
