"""Language identification by cross-parsing: the language that needs the fewest normalised phrases wins.

For each language a suffix automaton of a bounded sample of labelled text accepts exactly the sample's
substrings. A text is cut greedily into longest matches; phrases times the bits that name one, over
the text's length, estimate the cross entropy.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.base import broadcast, held, pieces, text_column, tidy
from framewright.llm.words import lowered

ASCII_LETTER, LETTER = re.compile("[A-Za-z]"), regex.compile(r"\p{L}")


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def symbols(data: bytes) -> np.ndarray:
    """Bytes of lower-cased text with every run of ASCII non-letters as one space."""
    raw = np.frombuffer(data, np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    kept = letter | np.concatenate([[True], letter[:-1]])[: len(raw)]
    return np.where(letter, raw, 32)[kept].astype(np.uint8)


def suffix_automaton(text: bytes, width: int) -> np.ndarray:
    """Transitions (states x width, -1 for none) of the minimal automaton of all substrings of ``text``; state 0 is the start."""
    none = array("i", [-1]) * width
    moves = array("i", none)
    link, longest, last = array("i", [-1]), array("i", [0]), 0
    for c in text:
        new = len(link)
        moves += none
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and moves[p * width + c] < 0:
            moves[p * width + c] = new
            p = link[p]
        if p >= 0:
            q = moves[p * width + c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(link)
                moves += moves[q * width : (q + 1) * width]
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p * width + c] == q:
                    moves[p * width + c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return np.frombuffer(moves, "i4").reshape(-1, width)


class CrossParser:
    """Counts the phrases of many texts in step, against all languages at once."""

    def __init__(self, samples: dict[str, bytes], chunk: int = 1024):
        self.languages, self.chunk = sorted(samples), chunk
        text = {k: symbols(v) for k, v in samples.items()}
        seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *text.values()]))
        self.width = len(seen) + 1  # the last symbol is any that no sample has
        self.code = np.full(256, len(seen), np.uint8)
        self.code[seen] = np.arange(len(seen))
        moves, roots = array("i"), []
        for name in self.languages:  # one language's table beside the whole, no more: a worker has little to spare
            table = suffix_automaton(self.code[text[name]].tobytes(), self.width)
            roots.append(len(moves) // self.width)
            np.add(table, roots[-1], out=table, where=table >= 0)
            moves.frombytes(table.data.cast("B"))
        self.next = np.frombuffer(moves, "i4") if moves else np.zeros(0, "i4")
        self.root = np.array(roots, "i4")
        self.bits = np.array([np.log2(max(len(text[k]), 2)) for k in self.languages])

    def phrases(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (texts x languages) and symbols of each text.

        Long texts are parsed in chunks of ``chunk`` symbols, all of them; a phrase ends with its chunk.
        """
        total, sizes, _ = self.parsed(texts)
        return total, sizes

    def parsed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``phrases``, and how many of each text's symbols the samples have at all."""
        data, ends = lowered(texts)
        coded, owner, sizes, known = [], [], [], []
        at = 0
        for i, end in enumerate(ends.tolist()):
            own = self.code[symbols(data[at:end])]
            at = end + 1
            sizes.append(len(own))
            known.append(int((own < self.width - 1).sum()))
            for k in range(0, len(own), self.chunk):
                coded.append(own[k : k + self.chunk])
                owner.append(i)
        n = len(self.languages)
        total = np.zeros((len(ends), n))
        if not coded or not n:
            return total, np.array(sizes), np.array(known)
        length = np.array([len(x) for x in coded])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        grid = np.zeros((length[0], len(coded)), np.uint8)
        for k, i in enumerate(order.tolist()):
            grid[: length[k], k] = coded[i]
        live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # chunks longer than t
        state = np.repeat(self.root[:, None], len(coded), 1)
        count = np.zeros(state.shape, "i4")
        root = self.root[:, None]
        for t in range(length[0]):
            m = live[t]
            c, s = grid[t, :m], state[:, :m]
            to = self.next[s * self.width + c]
            failed = to < 0
            if failed.any():
                first = self.next[root * self.width + c]
                unknown = first < 0
                count[:, :m] += failed * ((s != root) + unknown.astype("i4"))
                to = np.where(failed, np.where(unknown, root, first), to)
            state[:, :m] = to
        count += state != root
        np.add.at(total, np.array(owner)[order], count.T)
        return total, np.array(sizes), np.array(known)


def parser_of(samples: dict[str, bytes]) -> CrossParser:
    return held("parser", tuple(sorted(samples.items())), lambda: CrossParser(samples))


def passages(text: Column, most: int, n: int = 16) -> Column:
    """``text``, or ``n`` passages evenly spread over it, of about ``most`` bytes together, where it has more."""
    chars = F.length(text).cast("long")
    each = F.greatest(F.lit(1), F.floor(chars * F.lit(most) / F.octet_length(text) / n)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substr(text, F.floor((chars - each) * k / (n - 1)).cast("int") + 1, each))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat_ws("\n", spread))


def labelled_samples(docs: DataFrame, per_language: int = 16, shortest: int = 200, longest: int = 8192, most_bytes: int = 40_000, all_bytes: int = 400_000) -> dict[str, bytes]:
    """Text of each language to learn from: texts, at most ``per_language`` of them.

    ``docs(text, lang)`` are the rows that may be learnt from. Every language that a row with a text has is
    learnt. Its distinct texts between ``shortest`` and ``longest`` characters teach first, then shorter ones,
    both by least hash, then longer ones from the shortest on; no further text is taken once they
    have ``most_bytes`` bytes, or the language's equal share of ``all_bytes`` if that is less (``longest``
    is then no more than the share). A text with more bytes than the share and ``longest`` teaches by
    ``passages`` evenly spread over it, of as many bytes as the larger of the two, so that no text, however long,
    makes a sample that workers cannot hold. Null languages and null or empty texts teach nothing.
    """
    rows = docs.where("lang is not null and text is not null").where(F.length("text") > 0)
    languages = rows.select("lang").distinct().count()
    share = min(most_bytes, max(1, all_bytes // max(1, languages)))
    longest, whole = min(longest, max(shortest, share)), max(share, longest)
    chars = F.length("text")
    rows = rows.select("lang", "text", F.when(chars > longest, 2).when(chars < shortest, 1).otherwise(0).alias("kind"), F.xxhash64("text").alias("h"))
    keys = rows.groupBy("lang", "kind", "h").agg(F.max(F.octet_length("text")).alias("bytes"))
    # Twice as many of the least hashes as can be needed go on, so that no language gathers in one task.
    sizes = rows.groupBy("lang", "kind").agg(F.approx_count_distinct("h").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # three rows a language
    limits = sizes.withColumn("before", before).where(F.col("before") < 2 * per_language).select("lang", "kind", (F.least(F.lit(1.0), 4.0 * per_language / F.col("n")) * 2.0**64 - 2.0**63).alias("limit"))
    few = keys.join(F.broadcast(limits) if languages <= 100_000 else limits, ["lang", "kind"]).where(F.col("h") <= F.col("limit"))
    order = Window.partitionBy("lang").orderBy("kind", F.when(F.col("kind") == 2, F.col("bytes")).otherwise(0), "h")
    ranked = few.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes"))
    chosen = ranked.where((F.col("n") <= per_language) & (F.col("before") < share)).select("lang", "kind", "h", "n")  # a bounded number a language
    picked = rows.join(F.broadcast(chosen), ["lang", "kind", "h"]).groupBy("lang", "n").agg(F.first(passages(F.col("text"), whole)).alias("text"))
    texts: dict[str, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.n)):
        texts.setdefault(r.lang, []).append(r.text.lower().encode())
    return {lang: b"\n".join(own) for lang, own in texts.items()}


PREDICTION = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("phrase_length", pa.float64()), ("symbols", pa.int64()), ("known", pa.int64())])
PREDICTION_DDL = "lang_pred string, score double, phrase_length double, symbols long, known long"


def predictions(texts: pa.Array, parser: CrossParser) -> list[list]:
    """Language, margin, mean phrase length, symbols and known symbols of each text; ``und`` without a letter or a language."""
    count, size, known = parser.parsed(texts)
    rows = []
    cost = count * parser.bits if parser.languages else count
    best = cost.argmin(1) if parser.languages else None
    for i, text in enumerate(texts.to_pylist()):
        if not parser.languages or not text or not (ASCII_LETTER.search(text) or LETTER.search(text)):
            rows.append(("und", 0.0, 0.0, int(size[i]), int(known[i])))
            continue
        order = np.sort(cost[i])
        margin = float(1 - order[0] / order[1]) if len(order) > 1 and order[1] > 0 else float(len(order) == 1)
        rows.append((parser.languages[best[i]], margin, float(size[i] / max(1, count[i, best[i]])), int(size[i]), int(known[i])))
    return list(map(list, zip(*rows, strict=True)))


def identify(docs: DataFrame, samples: dict[str, bytes], keep: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the PREDICTION columns, renamed by ``names``.

    These are the language, the margin of the best over the next (score), the mean phrase length, the
    number of symbols and of those that the samples have.
    Only ``text`` is looked at, whole, each row by itself: equal texts have equal results and repeated rows stay.
    A null text, or one without a letter, is ``und`` with score 0, as is every text if no language is
    learnt. Languages that need equally many normalised phrases: the first by name wins, with score 0.
    """
    shared = broadcast(docs.sparkSession, samples)  # bounded by the rows that teach
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], text_column().alias("_text"))
    head = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches):
        parser = parser_of(shared.value)
        for batch in batches:
            for part in pieces(batch, "_text"):
                made = [pa.array(column, field.type) for column, field in zip(predictions(part.column("_text"), parser), PREDICTION, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=[*(f"c{i}" for i in range(len(keep))), *PREDICTION.names])

    out = rows.mapInArrow(tidy(run), f"{head}, {PREDICTION_DDL}" if head else PREDICTION_DDL)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias((names or {}).get(c, c)) for c in PREDICTION.names])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows outside the held-out fold; a null doc_id counts as the empty id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = labelled_samples(docs.where(fold(4) != 2).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), samples, ["doc_id"])
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), *PREDICTION.names)
