"""Near-duplicate documents by DartMinHash over weighted word shingles, banded joining and exact checks.

A document is the multiset of its shingles of five words. Hashed darts fall on each element's weight
axis as a Poisson process over ranks; the earliest dart of each coordinate is the signature, and two
documents share a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import group_minimum, pieces, spread_join, stored, text_column, tidy
from framewright.llm.graph import connected_components
from framewright.llm.words import hashed_words, mixed

WORDS, BANDS, ROWS = 5, 20, 4
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their multiplicities and their texts, ordered by text.

    A text of fewer than five words has one shingle of all its words, one without words none.
    """
    ends = np.cumsum(counts)
    start = ends - counts
    n = np.where(counts >= WORDS, counts - WORDS + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    value = np.zeros(len(first), "u8")
    for k in range(WORDS):
        value += hashes[first + k] * _STEP[k]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    few = np.array([sum(int(hashes[start[i] + k]) * int(_STEP[k]) for k in range(counts[i])) + int(counts[i]) & (1 << 64) - 1 for i in short], "u8")
    value, owner = mixed(np.concatenate([value, few])), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])[: len(value)]
    at = np.flatnonzero(new)
    return value[at], np.diff(np.append(at, len(value))), owner[at]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype("f8") + 1) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k earliest darts of weighted sets; zero rows for empty sets.

    Each element's weight axis is cut into cells [0, 1), [1, 2), [2, 4), ...; in a cell of width W darts
    arrive at rate W along the rank axis, at hashed gaps, with a hashed place on the weight axis
    and a hashed coordinate. Those at or beyond the weight miss. A set throws until rank
    k (ln k + 3) / |x| and doubles that while a coordinate is empty.
    """
    out, rank_of = np.zeros((n, k), "u8"), np.full((n, k), np.inf)
    total = np.bincount(owner, weights=weights, minlength=n)
    limit = np.where(total > 0, k * (np.log(k) + 3) / np.maximum(total, 1e-300), 0)
    cells = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype("i8")
    todo = total > 0
    while todo.any():
        use = np.flatnonzero(todo[owner])
        own_cells = cells[use]
        of = np.repeat(use, own_cells)
        level = np.arange(len(of)) - np.repeat(np.cumsum(own_cells) - own_cells, own_cells)
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        width = np.maximum(low, 1.0)
        key = mixed(elements[of] + level.astype("u8") * np.uint64(0xA0761D6478BD642F))
        weight, whose, rank = weights[of], owner[of], np.zeros(len(of))
        found = []
        turn = 0
        while len(key):
            draw = mixed(key + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank = rank - np.log(_uniform(draw)) / width
            live = rank <= limit[whose]
            key, weight, whose, rank, low, width, draw = (x[live] for x in (key, weight, whose, rank, low, width, draw))
            dart = mixed(draw ^ np.uint64(0xE7037ED1A0B428DB))
            hit = low + width * _uniform(mixed(dart + np.uint64(1))) < weight + 1e-12
            found.append((whose[hit], dart[hit], rank[hit]))
            turn += 1
        whose, dart, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        slot = whose * k + (mixed(dart + np.uint64(2)) % np.uint64(k)).astype("i8")
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)]
        out.ravel()[slot[first]] = dart[first]
        rank_of.ravel()[slot[first]] = 0
        todo = todo & np.isinf(rank_of).any(1)
        rank_of[todo] = np.inf
        limit = np.where(todo, 2 * limit, limit)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands hashes of ``rows`` consecutive coordinates each."""
    value = np.arange(bands, dtype="u8")[None, :] * np.uint64(0x8EBC6AF09C88C6E3) + np.zeros((len(signature), 1), "u8")
    for r in range(rows):
        value = mixed(value ^ signature[:, r : bands * rows : rows] if r == 0 else value + mixed(signature[:, r : bands * rows : rows]))
    return value


def similarity(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets of (sorted hashes, multiplicities)."""
    _, i, j = np.intersect1d(first[0], second[0], assume_unique=True, return_indices=True)
    both = np.minimum(first[1][i], second[1][j]).sum()
    whole = first[1].sum() + second[1].sum() - both
    return float(both / whole) if whole else 0.0


def sets_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's multiset of shingles."""
    value, weight, owner = shingles(*hashed_words(texts))
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(value[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, weight, bands): key is equal for equal word sequences, for equal texts where there are no words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                texts = part.column("text")
                hashes, counts = hashed_words(texts)
                value, weight, owner = shingles(hashes, counts)
                keys = band_keys(dart_signatures(value, weight.astype("f8"), owner, len(counts), bands * rows), bands, rows)
                ends = np.cumsum(counts)
                digest = [xxhash.xxh3_128_digest(hashes[e - c : e].tobytes()) if c else xxhash.xxh3_128_digest(b"\0" + t.encode()) for c, e, t in zip(counts.tolist(), ends.tolist(), texts.to_pylist(), strict=True)]
                total = np.bincount(owner, weights=weight, minlength=len(counts)).astype("i8")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype("i4")), pa.array(keys[counts > 0].ravel().view("i8")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(total), lists], names=["doc_id", "key", "weight", "bands"])

    return docs.mapInArrow(tidy(run, True), "doc_id long, key binary, weight long, bands array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """Stored (doc_id, text) of the documents in ``ids(doc_id)``; ids are broadcast only if counted and few."""
    few = ids.count() <= most_broadcast
    return stored(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "pair-texts")


def verified(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts have a weighted Jaccard similarity of ``least`` or more."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    members = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    whole = spread_join(members, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), ["a"], ["b"])

    def run(batches):
        last, held = None, None
        for batch in batches:
            for part in pieces(batch, "text_b", 1 << 20):
                found = []
                for a, text, b, own in zip(part.column("a").to_pylist(), part.column("text_a"), part.column("b").to_pylist(), sets_of(part.column("text_b")), strict=True):
                    if a != last:
                        last, held = a, sets_of(pa.array([text.as_py()]))[0]
                    if similarity(held, own) >= least:
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return whole.select("a", "text_a", "b", "text_b").mapInArrow(tidy(run, True), "a long, b long")


def labelled(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    """``rows(rep, ...)`` with the component found so far, at first the row's own id."""
    if components is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(components.select(F.col("node").alias("rep"), F.col("component").alias("_c")), "rep", "left").withColumn("component", F.coalesce("_c", "rep")).drop("_c")


def star_pairs(rows: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs of each group's least member with its members of other components, where sizes allow ``least``."""
    led = group_minimum(rows.select(key, F.struct("rep", "weight", "component").alias("at")), [key], "at")
    return led.where("at.rep <> leader.rep and at.component <> leader.component").where(F.least("at.weight", "leader.weight") >= least * F.greatest("at.weight", "leader.weight")).select(F.col("leader.rep").alias("a"), F.col("at.rep").alias("b")).distinct()


def mixed_groups(rows: DataFrame, key: str) -> DataFrame:
    """The rows of groups that still hold several components."""
    several = rows.groupBy(key).agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select(key)
    return spread_join(rows, several, [key], ["rep"])


def block_rows(docs: DataFrame, apart: DataFrame, bands: int, rows: int) -> DataFrame:
    """Stored (rep, signature, elements, bands) of the documents in ``apart(rep)``.

    signature has the low 16 bits of each dart, elements are the sorted hashes of (shingle, occurrence),
    bands the bucket keys.
    """
    texts = texts_of(docs, apart.select(F.col("rep").alias("doc_id")).distinct())

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                hashes, counts = hashed_words(part.column("text"))
                value, weight, owner = shingles(hashes, counts)
                darts = dart_signatures(value, weight.astype("f8"), owner, len(counts), bands * rows)
                each = np.repeat(value, weight) + (np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)).astype("u8") * np.uint64(0x9FB21C651E98DF25)
                whose = np.repeat(owner, weight)
                element = mixed(each).astype("<u8")
                order = np.lexsort((element, whose))
                cut = np.searchsorted(whose, np.arange(len(counts) + 1))
                element = element[order]
                sets = [element[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                short = (darts & np.uint64(0xFFFF)).astype("<u2")
                keys = band_keys(darts, bands, rows).astype("<u8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.binary()) for x in ([s.tobytes() for s in short], sets, [k.tobytes() for k in keys]))], names=["rep", "signature", "elements", "bands"])

    return stored(texts.mapInArrow(tidy(run, True), "rep long, signature binary, elements binary, bands binary"), "block-rows")


def links_within(rows: list[tuple], bucket: int, cross: bool, least: float, agree: int) -> list[tuple[int, int]]:
    """Links of one block that join components: rows of (rep, component, chunk, signature, elements, bands).

    A pair is looked at in the first bucket that both share only, in a block of two chunks (``cross``) only
    if it lies in different ones, and only if its signatures agree in ``agree`` places or more and its
    components are still apart; then the sets decide.
    """
    rows = sorted(rows)
    sign, keys = (np.stack([np.frombuffer(r[k], t) for r in rows]) for k, t in ((3, "<u2"), (5, "<u8")))
    earlier = np.arange(keys.shape[1])[None, :] < np.argmax(keys == np.uint64(bucket & (1 << 64) - 1), 1)[:, None]  # bands before this one
    sets = [np.frombuffer(r[4], "<u8") for r in rows]
    size = np.array([len(x) for x in sets])
    cut = np.concatenate([[0], np.cumsum(size)])
    every = np.concatenate(sets)
    chunk = np.unique([r[2] for r in rows], return_inverse=True)[1]
    own = np.unique([r[1] for r in rows], return_inverse=True)[1]
    found = []
    for i in range(len(rows) - 1):
        rest = np.arange(i + 1, len(rows))
        apart = (own[rest] != own[i]) & (np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]))
        rest = rest[apart & (chunk[rest] != chunk[i])] if cross else rest[apart]
        rest = rest[(sign[rest] == sign[i]).sum(1) >= agree]
        rest = rest[~((keys[rest] == keys[i]) & earlier[i]).any(1)]
        if not len(rest):
            continue
        picked = np.concatenate([every[cut[j] : cut[j + 1]] for j in rest])
        at = np.minimum(np.searchsorted(sets[i], picked), size[i] - 1)
        both = np.add.reduceat((sets[i][at] == picked).astype("i8"), np.concatenate([[0], np.cumsum(size[rest])[:-1]]))
        for j in rest[both >= least * (size[i] + size[rest] - both) - 1e-9]:
            if own[j] != own[i]:
                own[own == own[j]] = own[i]
                found.append((rows[i][0], rows[j][0]))
    return found


def block_links(members: DataFrame, apart: DataFrame, least: float, k: int, chunk: int = 256) -> DataFrame:
    """(a, b): links between components among the documents that share a bucket.

    ``members`` are block_rows, ``apart(bucket, rep, component)`` the rows of buckets with several components.
    A bucket's documents are cut into chunks of about ``chunk``, a component that fills one has its own,
    and every two chunks that may hold different components form a block. So a task holds two chunks
    however large the bucket, and a large group of copies meets only what is not yet linked to it.
    """
    part = apart.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    part = part.select("bucket", "component", "n", F.when(F.col("n") >= chunk, F.col("component").cast("string")).otherwise("-").alias("name"))
    chunks = stored(part.groupBy("bucket", "name").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks")), "chunks")
    named = part.select("bucket", "component", "name").join(chunks, ["bucket", "name"])
    dealt = spread_join(apart, named, ["bucket", "component"], ["rep"])
    own = F.concat_ws("/", "name", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").cast("string"))
    dealt = dealt.select("bucket", "rep", "component", "name", own.alias("own"))
    cells = chunks.select("bucket", "name", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")).select("bucket", "name", F.concat_ws("/", "name", F.col("k").cast("string")).alias("own"))
    other = cells.select("bucket", F.col("name").alias("name_b"), F.col("own").alias("other"))
    meets = cells.join(other, "bucket").where("name <> name_b or name = '-'").select("bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    blocks = dealt.select("bucket", "rep", "component", "own").join(meets, ["bucket", "own"])
    full = blocks.join(members, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    agree = int(k * least - 4 * (k * least * (1 - least)) ** 0.5)

    def run(batches):
        block, held = None, []
        for batch in batches:
            found = []
            for *row, bucket, i, j in zip(*(batch.column(c).to_pylist() for c in ("rep", "component", "own", "signature", "elements", "bands", "bucket", "i", "j")), strict=True):
                if (bucket, i, j) != block:
                    if len(held) > 1:
                        found += links_within(held, block[0], block[1] != block[2], least, agree)
                    block, held = (bucket, i, j), []
                held.append(tuple(row))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])
        found = links_within(held, block[0], block[1] != block[2], least, agree) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return full.mapInArrow(tidy(run, True), "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, component_id, kept) of ``docs(doc_id, text)``: classes of documents linked at ``least`` or more.

    Documents with equal word sequences fall together first. In each bucket of a band the least
    document is checked against the others, so a group of copies costs a check for each member, not for
    each pair. Documents of buckets that still hold several components then meet in blocks: those of
    different components are compared by signature, and exactly where that allows the similarity. No
    bucket is capped; only links leave a block.

    component_id is the least doc_id of the class and kept is true for that document. A null text is
    empty; empty texts are copies of each other. Rows of one doc_id are one document. Documents with
    a null doc_id are kept and have no component.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    known = own.where("doc_id is not null")
    signed = stored(signatures(known, bands, rows), "signatures")
    members = stored(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "representatives")
    buckets = members.select("rep", "weight", F.explode("bands").alias("bucket")).distinct()
    shared = stored(group_minimum(buckets, ["bucket"], "rep").select("bucket", "rep", "weight"), "buckets")
    links = stored(verified(known, stored(star_pairs(labelled(shared, None), "bucket", least), "pairs"), least), "links")
    found = stored(connected_components(links), "components")

    apart = stored(mixed_groups(labelled(shared, found), "bucket").select("bucket", "rep", "component").distinct(), "apart")
    if not apart.isEmpty():
        rest = block_rows(known, apart, bands, rows)
        more = stored(block_links(rest, apart, least, bands * rows), "links")
        if not more.isEmpty():
            found = stored(connected_components(links.unionByName(more)), "components")

    classes = labelled(members.select("key", "rep"), found).select("key", "component")
    whole = spread_join(signed.select("doc_id", "key"), classes, ["key"], ["doc_id"]).groupBy("doc_id").agg(F.min("component").alias("component_id"))
    # Two rows of one doc_id may have different texts: their classes then meet in that document.
    out = whole.select("doc_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
