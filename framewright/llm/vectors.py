"""Near-duplicate vectors: inverted lists with product-quantised residuals and exact reranking.

Vectors are kept in the list of their nearest coarse centroid with the codes of their residual. A
query probes every list that a vector similar enough may lie in, estimates inner products by table
lookups, drops what the quantisation error rules out, and computes the cosine of the rest in doubles.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import broadcast, spread_join, stored, tidy
from framewright.llm.graph import connected_components

SUBSPACES, CODES = 8, 256


@dataclass
class Quantiser:
    """Unit centroids (lists x d), residual codewords (subspaces x codes x d / subspaces), and a root of the residuals' second moments."""

    centroids: np.ndarray
    codewords: np.ndarray
    shape: np.ndarray
    gaps: np.ndarray | None = None

    def lists(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centroids.T).argmax(1)

    def codes(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the norm of what they miss."""
        rest = (unit - self.centroids[home]).reshape(len(unit), SUBSPACES, -1)
        half = (self.codewords**2).sum(2) / 2
        code = np.stack([(rest[:, m] @ self.codewords[m].T - half[m]).argmax(1) for m in range(SUBSPACES)], 1)
        made = np.stack([self.codewords[m][code[:, m]] for m in range(SUBSPACES)], 1)
        return code.astype(np.uint8), np.sqrt(((rest - made) ** 2).sum((1, 2)))

    def apart(self) -> np.ndarray:
        """lists x lists: how far two centroids lie apart, seen in the shape of the residuals.

        Times |q - v| this is one deviation of (q - v)(c - h), if near vectors differ in the directions in which
        residuals spread: for residuals that fill the space the distance over the root of d, for those of a plane
        the distance over the root of two.
        """
        if self.gaps is None:
            seen = self.centroids @ self.shape
            squares = (seen**2).sum(1)
            self.gaps = np.sqrt(np.maximum(squares[:, None] + squares - 2 * seen @ seen.T, 0))
        return self.gaps

    def probes(self, unit: np.ndarray, least: float, spread: float) -> np.ndarray:
        """queries x lists: which lists a vector of cosine ``least`` or more may lie in.

        If v lies in list c and q nearest to list h, then v(c - h) >= 0, so q(c - h) >= (q - v)(c - h). The
        right side is at least -|q - v| |c - h|, which is the bound itself, and ``spread`` deviations are allowed.
        """
        near = unit @ self.centroids.T
        home = near.argmax(1)
        squares = (self.centroids**2).sum(1)
        sure = np.sqrt(np.maximum(squares[home][:, None] + squares - 2 * self.centroids[home] @ self.centroids.T, 0))
        reach = np.sqrt(2 - 2 * least) * np.minimum(spread * self.apart()[home], sure)
        return near >= near[np.arange(len(unit)), home][:, None] - reach - 1e-9

    def needed(self, short: np.ndarray, home: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
        """Deviations to allow so that lists ``home`` probe lists ``other``, which queries are ``short`` nearer to than to their own."""
        return np.where(home == other, 0.0, (short - 1e-9) / np.maximum(np.sqrt(2 - 2 * least) * self.apart()[home, other], 1e-12))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    """Lloyd's algorithm from random rows; an empty cluster keeps its centre."""
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        score = x @ centre.T if spherical else x @ centre.T - (centre**2).sum(1) / 2
        of = score.argmax(1)
        n = np.bincount(of, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, of, x)
        some = n > 0
        centre[some] = total[some] / n[some][:, None]
        if spherical:
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def fitted(sample: np.ndarray, lists: int, seed: int = 7) -> Quantiser:
    """Quantiser of a sample of unit vectors; fewer lists and codes if the sample is small."""
    rng = np.random.default_rng(seed)
    centroids = k_means(sample, lists, 8, rng, True)
    q = Quantiser(centroids, np.zeros((SUBSPACES, 1, sample.shape[1] // SUBSPACES)), np.eye(sample.shape[1]))
    rest = sample - centroids[q.lists(sample)]
    moments = rest.T @ rest
    if moments.trace() > 0:
        size, axes = np.linalg.eigh(moments / moments.trace())
        q.shape = axes * np.sqrt(np.maximum(size, 0))
    rest = rest.reshape(len(sample), SUBSPACES, -1)
    q.codewords = np.stack([k_means(rest[:, m], CODES, 6, rng, False) for m in range(SUBSPACES)])
    return q


def matrix(column: pa.Array, width: int, kind: str = "f8") -> np.ndarray:
    """Lists of floats as rows, filled up with zeros to a multiple of the subspaces."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)
    return np.pad(flat, ((0, 0), (0, -width % SUBSPACES)))


def packed(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long binary values as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "u1")[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    y = x / scale
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows with a non-null id whose vector is finite, not null and not zero, all its parts known."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False)))


def estimates(query: np.ndarray, codes: np.ndarray, q: Quantiser, home: int) -> np.ndarray:
    """base x queries: inner products by table lookups, of the list's centroid and the residual codes."""
    out = np.repeat((query @ q.centroids[home]).astype("f4")[None, :], len(codes), 0)
    parts = query.reshape(len(query), SUBSPACES, -1)
    for m in range(SUBSPACES):
        out += (q.codewords[m] @ parts[:, m].T).astype("f4")[codes[:, m]]
    return out


def at_least(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have an inner product of ``least`` or more; the same for (x, y) and (y, x)."""
    product = x @ y.T
    out = product >= least
    i, j = np.nonzero(np.abs(product - least) < 1e-12)  # the order of a matrix product's sums may decide these
    out[i, j] = (x[i] * y[j]).sum(1) >= least
    return out


def smallest(near: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that rows ``x`` and columns ``y`` reach over the marked pairs."""
    most = np.iinfo("i8").max
    while True:
        low_y = np.minimum(y, np.where(near, x[:, None], most).min(0))
        low_x = np.minimum(x, np.where(near, low_y[None, :], most).min(1))
        if (low_x == x).all() and (low_y == y).all():
            return x, y
        x, y = low_x, low_y


def block_output(query: dict, base: dict, q: Quantiser, home: int, least: float, rows: int = 1024) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of each query into the base rows of one list (weighted by copies), and links that join parts.

    ``rows`` queries at a time are estimated against all base rows; what the error of the codes cannot rule
    out is computed in doubles, in one matrix product of the rows and columns concerned.
    """
    total = np.zeros(len(query["id"]), "i8")
    joins = []
    bound = (least - base["miss"] - 1e-5).astype("f4")[:, None]  # the estimates are single-precision sums
    for at in range(0, len(total), rows):
        ids, unit = query["id"][at : at + rows], query["unit"][at : at + rows]
        open_at = estimates(unit, base["code"], q, home) >= bound
        j, i = np.flatnonzero(open_at.any(1)), np.flatnonzero(open_at.any(0))
        if not len(j):
            continue
        near = at_least(base["unit"][j], unit[i], least) & open_at[np.ix_(j, i)] & (base["id"][j][:, None] != ids[i][None, :])
        total[at + i] += base["copies"][j] @ near
        j, i, near = j[near.any(1)], i[near.any(0)], near[near.any(1)][:, near.any(0)]
        if len(j):
            for own, low in zip((base["id"][j], ids[i]), smallest(near, base["id"][j], ids[i]), strict=True):
                joins.append((own[own != low], low[own != low]))
    return total, joins


def blocks_of(batches, names: tuple[str, ...]):
    """Consecutive rows of equal ``names``, over the borders of batches, as tables."""
    last, held = None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and tuple(key[a]) != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            last = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def measured_spread(classes: DataFrame, shared, width: int, least: float, asked: np.ndarray, margin: float = 1.15) -> float:
    """Deviations that the links of the queries ``asked`` (unit rows) need, found by comparing them with every class, and ``margin`` times that."""
    queries = broadcast(classes.sparkSession, asked)

    def run(batches):
        most, q = 0.0, shared.value
        theirs = queries.value @ q.centroids.T  # queries x lists
        y = theirs.argmax(1)
        for batch in batches:
            unit = unit_rows(matrix(batch.column("embedding"), width))
            for at in range(0, len(unit), 1024):
                own = unit[at : at + 1024] @ q.centroids.T
                x = own.argmax(1)
                i, j = np.nonzero(unit[at : at + 1024] @ queries.value.T >= least)
                if len(i):
                    most = max(most, q.needed(own[i, x[i]] - own[i, y[j]], x[i], y[j], least).max(), q.needed(theirs[j, y[j]] - theirs[j, x[i]], y[j], x[i], least).max())
        yield pa.RecordBatch.from_arrays([pa.array([float(most)])], names=["most"])

    return margin * (classes.select("embedding").mapInArrow(tidy(run, True), "most double").agg(F.max("most")).first()[0] or 0.0)


def links_of(classes: DataFrame, width: int, single: bool, least: float, sample: int, most_lists: int, spread: float, base_chunk: int, query_chunk: int, trial: int) -> DataFrame:
    """Stored (a, b, n) of ``classes(h, rep, copies, embedding)`` of one length: n links of a, or a joining link of a and b."""
    spark = classes.sparkSession
    n = classes.count()
    taken = classes.orderBy("h", "rep").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    units = unit_rows(matrix(taken, width))
    q = fitted(units, int(min(most_lists, max(1, round(n**0.5)))))
    shared = broadcast(spark, q)  # at most most_lists centroids and the codewords
    spread = max(spread, measured_spread(classes, shared, width, least, units[:trial]))
    kind = "f4" if single else "f8"  # what the input has travels

    def assign(batches):
        for batch in batches:
            raw = matrix(batch.column("embedding"), width, kind)
            unit = unit_rows(raw.astype("f8"))
            home = shared.value.lists(unit)
            code, miss = shared.value.codes(unit, home)
            probe = shared.value.probes(unit, least, spread)
            at = np.concatenate([[0], np.cumsum(probe.sum(1))]).astype("i4")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(home.astype("i4")), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(miss), pa.ListArray.from_arrays(pa.array(at), pa.array(np.nonzero(probe)[1].astype("i4")))], names=["rep", "copies", "raw", "home", "code", "miss", "probes"])

    dealt = classes.select("rep", "copies", "embedding").repartition(max(8, min(4096, n // 4096)))
    index = stored(dealt.mapInArrow(tidy(assign, True), "rep long, copies long, raw binary, home int, code binary, miss double, probes array<int>"), "vector-index")
    asked = index.select("rep", "raw", F.explode("probes").alias("home"))
    held = index.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / base_chunk).cast("int").alias("base_chunks"))
    asks = index.select(F.explode("probes").alias("home")).groupBy("home").agg(F.ceil(F.count(F.lit(1)) / query_chunk).cast("int").alias("query_chunks"))
    plan = F.broadcast(held.join(asks, "home"))  # at most most_lists rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    none = F.lit(None)
    queries = asked.join(plan, "home").select("home", every("base_chunks").alias("b"), part("query_chunks").alias("c"), F.lit(1).alias("side"), "rep", "raw", F.lit(0).cast("long").alias("copies"), none.cast("binary").alias("code"), none.cast("double").alias("miss"))
    base = index.join(plan, "home").select("home", part("base_chunks").alias("b"), every("query_chunks").alias("c"), F.lit(0).alias("side"), "rep", "raw", "copies", "code", "miss")
    blocks = queries.unionByName(base).repartition("home", "b", "c").sortWithinPartitions("home", "b", "c", "side")

    def link(batches):
        for (home, *_), table in blocks_of(batches, ("home", "b", "c")):
            cut = int((table["side"].to_numpy() == 0).sum())
            if cut in (0, table.num_rows):
                continue
            both = []
            for rows in (table.slice(cut), table.slice(0, cut)):
                rows = rows.combine_chunks()
                own = {c: rows[c].chunk(0) for c in ("rep", "raw", "copies", "code", "miss")}
                both.append({"id": own["rep"].to_numpy(), "unit": unit_rows(packed(own["raw"], kind).astype("f8"))})
            both[1] |= {"copies": own["copies"].to_numpy(), "code": packed(own["code"], "u1"), "miss": own["miss"].to_numpy()}
            total, joins = block_output(*both, shared.value, home, least)
            some = total > 0
            a = np.concatenate([both[0]["id"][some], *(x for x, _ in joins)])
            b = np.concatenate([np.zeros(some.sum(), "i8"), *(y for _, y in joins)])
            count = np.concatenate([total[some], np.zeros(len(a) - some.sum(), "i8")])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=count > 0), pa.array(count)], names=["a", "b", "n"])

    return stored(blocks.mapInArrow(tidy(link, True), "a long, b long, n long"), "vector-links")


def near_vectors(vectors: DataFrame, least: float = 0.9, sample: int = 16_384, most_lists: int = 1024, spread: float = 3.0, base_chunk: int = 1024, query_chunk: int = 4096, trial: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors(vec_id, embedding)`` at a cosine of ``least`` or more.

    Equal vectors are one class, which counts with all its copies. The quantiser is fitted on at most
    ``sample`` classes (least hashes); every class is indexed and every class is a query. ``trial`` classes of the
    sample are compared with all classes first: probes reach as far as their links need, and ``spread``
    deviations at least. A list is cut
    into chunks of ``base_chunk`` vectors and its queries into chunks of ``query_chunk``; a task holds one block
    of two chunks at a time, and only counts and joining links leave a block. Vectors of each length are
    searched by themselves, one length after another.

    Null, zero or non-finite vectors, empty ones and those with null parts link with nothing. Rows of one
    vec_id with different vectors are counted as one vector each and meet in one component. Rows with
    a null vec_id are left out; an empty table has no rows.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    single = "array<float>" in own.schema["embedding"].dataType.simpleString()
    own = own.withColumn("embedding", F.col("embedding").cast("array<float>" if single else "array<double>"))
    good = valid_vectors(own).select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    known = own.where("vec_id is not null").select("vec_id").distinct()
    classes = stored(good.groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    widths = sorted(r.d for r in classes.select(F.size("embedding").alias("d")).distinct().collect())  # the lengths that occur
    if not widths:
        return known.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = [links_of(classes.where(F.size("embedding") == d), d, single, least, sample, most_lists, spread, base_chunk, query_chunk, trial) for d in widths]
    linked = functools.reduce(DataFrame.unionByName, found)
    counts = linked.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    found = connected_components(linked.where("b is not null").select("a", "b"))
    of = classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("h", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    got = spread_join(good, of, ["h", "embedding"], ["vec_id"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    whole = known.join(got, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return whole.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
