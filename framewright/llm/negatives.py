"""Hard negatives by vantage-point trees over norm-augmented integer vectors.

A vector v gets one more component, the root of the largest squared norm less its own; a query gets zero
there. Then |q - v|^2 = |q|^2 + largest - 2 qv: the distance falls as the inner product rises, and a window of
scores is an annulus around the query. A tree fitted on a sample deals the vectors to leaves; each
chunk of a leaf is a tree of its own, walked nearest first inside the annulus until k rows are nearer than
all that is left.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.base import broadcast, stored, tidy
from framewright.llm.vectors import blocks_of

#: Rows of the leaf of a chunk's tree, whose scores are one product.
LEAF_ROWS = 256
#: Part of the largest distance by which floating-point distances may be off.
SLACK = 1e-6
#: Scores are below this, as no squared norm is above it.
MOST = 1 << 62


@dataclass
class Tree:
    """Vantage-point tree: node i parts its rows by their distance to ``vantage[i]``.

    ``child`` has the nearer and the farther half (-1 at a leaf), ``range`` the least and largest distance of each
    half, ``span`` a leaf's first and last place in ``order``.
    """

    vantage: np.ndarray
    child: np.ndarray
    range: np.ndarray
    span: np.ndarray
    order: np.ndarray


def distances(x: np.ndarray, norms: np.ndarray, at: int, rows: np.ndarray, largest: float) -> np.ndarray:
    """Distances of ``rows`` to row ``at``, all with their further component."""
    far = norms[rows].astype("f8") + float(norms[at]) - 2.0 * (x[rows] @ x[at]).astype("f8")
    extra = np.sqrt(largest - norms[rows]) - np.sqrt(largest - norms[at])
    return np.sqrt(np.maximum(far + extra**2, 0.0))


def grown(x: np.ndarray, norms: np.ndarray, largest: float, leaf_rows: int) -> Tree:
    """Tree of all rows, halved at the median distance; rows that a vantage point cannot tell apart stay a leaf."""
    order = np.arange(len(x))
    vantage, child, spread, span = [], [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        node = len(vantage)
        if parent >= 0:
            child[parent][side] = node
        vantage.append(-1)
        child.append([-1, -1])
        spread.append([[0.0, np.inf], [0.0, np.inf]])
        span.append((a, b))
        if b - a <= leaf_rows:
            continue
        rows = order[a:b]
        at = rows[distances(x, norms, rows[0], rows, largest).argmax()]  # from the edge the rest looks most different
        far = distances(x, norms, at, rows, largest)
        if far.max() - far.min() <= SLACK * (1 + far.max()):
            continue
        half = (b - a) // 2
        by = np.argpartition(far, half)
        order[a:b], far = rows[by], far[by]
        vantage[node] = at
        spread[node] = [[far[:half].min(), far[:half].max()], [far[half:].min(), far[half:].max()]]
        todo += [(a + half, b, node, 1), (a, a + half, node, 0)]
    return Tree(np.array(vantage), np.array(child), np.array(spread), np.array(span), order)


@dataclass
class Router:
    """The top of the index: vantage points of a sample, and for each leaf the distances to them that it may hold."""

    points: np.ndarray
    norms: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # nodes, and leaves as -1 - leaf
    low: np.ndarray  # leaves x points
    high: np.ndarray
    largest: float

    def far(self, x: np.ndarray, norms: np.ndarray, query: bool) -> np.ndarray:
        """rows x points: distances; a query has no further component."""
        far = norms.astype("f8")[:, None] + self.norms.astype("f8") - 2.0 * (x @ self.points.T).astype("f8")
        own = np.zeros(len(x)) if query else np.sqrt(self.largest - norms)
        return np.sqrt(np.maximum(far + (own[:, None] - np.sqrt(self.largest - self.norms)) ** 2, 0.0))

    def leaves(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        far, at = self.far(x, norms, False), np.zeros(len(x), int) if len(self.points) else np.full(len(x), -1)
        while (at >= 0).any():
            i = np.flatnonzero(at >= 0)
            at[i] = self.child[at[i], (far[i, at[i]] > self.threshold[at[i]]).astype(int)]
        return -1 - at

    def bounds(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """queries x leaves: the least and largest distance of a leaf's rows that the triangle inequality allows."""
        far = self.far(x, norms, True)
        low, high = np.zeros((len(x), len(self.low))), np.full((len(x), len(self.low)), np.inf)
        for p in range(len(self.points)):
            d = far[:, p : p + 1]
            low = np.maximum(low, np.maximum(self.low[:, p] - d, d - self.high[:, p]))
            high = np.minimum(high, d + self.high[:, p])
        return low, high


def fitted_router(x: np.ndarray, norms: np.ndarray, largest: float, leaves: int) -> Router:
    """Router with at most ``leaves`` leaves from a sample's tree."""
    tree = grown(x, norms, largest, max(1, -(-len(x) // leaves)))
    inner = np.flatnonzero(tree.vantage >= 0)
    place = {int(n): k for k, n in enumerate(inner)}
    leaf = {int(n): k for k, n in enumerate(np.flatnonzero(tree.vantage < 0))}
    # Between the halves: all rows, also those that the sample lacks, are on one side of it.
    threshold = np.array([tree.range[n][0][1] for n in inner])
    child = np.array([[place[c] if c in place else -1 - leaf[c] for c in map(int, tree.child[n])] for n in inner]).reshape(-1, 2)
    low, high = np.zeros((len(leaf), len(inner))), np.full((len(leaf), len(inner)), np.inf)

    def descend(node: int, above: list[tuple[int, int]]) -> None:
        if node < 0:
            for p, side in above:
                (high if side == 0 else low)[-1 - node, p] = threshold[p]
            return
        for side in (0, 1):
            descend(int(child[node, side]), [*above, (node, side)])

    descend(0 if len(inner) else -1, [])
    at = tree.vantage[inner].astype(int)
    return Router(x[at], norms[at], threshold, child, low, high, largest)


class Walker:
    """Nearest-first walks over one chunk's tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norms: np.ndarray, largest: float):
        self.tree, self.largest = grown(x, norms, largest, LEAF_ROWS), largest
        order = self.tree.order
        inner = self.tree.vantage >= 0
        self.points, self.place = x[self.tree.vantage[inner]], np.cumsum(inner) - 1
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]

    def nearest(self, query: np.ndarray, norm: int, own: int, label: int, same: bool, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the first k rows with scores from ``low`` to ``high``, of the label or of others, the row itself aside."""
        whole = float(norm) + self.largest
        reach = lambda score: max(whole - 2.0 * float(score), 0.0) ** 0.5
        slack = SLACK * (1 + whole**0.5)
        inside, limit = reach(high) - slack, reach(low) + slack
        # A vantage point's further component is its distance from the query's plane, which |q|^2 + largest - 2qp holds.
        to = np.sqrt(np.maximum(whole - 2.0 * (self.points @ query).astype("f8"), 0.0)).tolist()
        ids, scores = np.zeros(0, "i8"), np.zeros(0, self.x.dtype)
        heap = [(0.0, 0)]
        while heap:
            least, node = heapq.heappop(heap)
            if least > limit:
                break
            if self.tree.vantage[node] < 0:
                a, b = self.tree.span[node]
                score = self.x[a:b] @ query
                fits = (score >= low) & (score <= high) & ((self.labels[a:b] == label) == same) & (self.ids[a:b] != own)
                if fits.any():
                    ids, scores = np.concatenate([ids, self.ids[a:b][fits]]), np.concatenate([scores, score[fits]])
                    first = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[first], scores[first]
                    if len(ids) == k:
                        low = max(low, int(scores[-1]))
                        limit = reach(low) + slack
                continue
            d = to[self.place[node]]
            for child, (near, far) in zip(self.tree.child[node], self.tree.range[node], strict=True):
                bound = max(least, near - d, d - far)
                if bound <= limit and d + far >= inside:
                    heapq.heappush(heap, (bound, int(child)))
        return ids, scores.astype("i8")


def whole_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v, norm, anchor) of the rows that take part, v in whole numbers, one row a vec_id.

    Left out are null labels, ids and vectors, null and non-finite components, and vectors with a squared norm of
    2^61 or more, whose scores a long need not hold. Of several rows of one vec_id the least by label and
    vector stands for it.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("embedding"), "anchor").where("vec_id is not null and label is not null and embedding is not null")
    cells = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    own = own.where(F.coalesce(finite, F.lit(False))).withColumn("f", cells).where(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x) < 2.0**61)
    one = own.groupBy("vec_id").agg(F.min(F.struct("label", F.col("f").cast("array<long>").alias("v"), "anchor")).alias("r")).select("vec_id", "r.*")
    return one.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


def search(index: DataFrame, router, queries: DataFrame, width: int, kind: str, same: bool, k: int, first: int, chunk: int, query_chunk: int) -> DataFrame:
    """Stored (a, p, vec_id, score): the first k rows of each of ``queries(a, p, label, v, norm, low, high)``.

    Every query first visits its ``first`` nearest leaves inside its annulus; the others are visited only where
    the k-th score found so far does not rule them out.
    """
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("base_chunks"))
    most = [F.col("score").desc(), F.col("vec_id")]

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(Window.partitionBy("a", "p").orderBy(*most))).where(F.col("n") <= k).drop("n")

    def routed(rows: DataFrame, begin: int, end: int | None) -> DataFrame:
        def route(batches):
            r = router.value
            for batch in batches:
                x, norms = matrix_of(batch.column("v"), width, kind), batch.column("norm").to_numpy()
                whole = norms + r.largest
                reach = [np.sqrt(np.maximum(whole - 2.0 * batch.column(c).to_numpy(), 0.0))[:, None] for c in ("low", "high")]
                slack = SLACK * (1 + np.sqrt(whole))[:, None]
                low, high = r.bounds(x, norms)
                rank = np.argsort(np.argsort(low, axis=1, kind="stable"), axis=1, kind="stable")
                go = (low <= reach[0] + slack) & (high >= reach[1] - slack) & (rank >= begin) & (rank < (end or len(r.low)))
                at = np.concatenate([[0], np.cumsum(go.sum(1))]).astype("i4")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "p", "label", "v", "norm", "low", "high")), pa.ListArray.from_arrays(pa.array(at), pa.array(np.nonzero(go)[1].astype("i4")))], names=["a", "p", "label", "v", "norm", "low", "high", "leaves"])

        return rows.mapInArrow(tidy(route), "a long, p long, label long, v array<long>, norm long, low long, high long, leaves array<int>")

    def visit(rows: DataFrame) -> DataFrame:
        asked = stored(rows, "negative-visits")
        asks = asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / query_chunk).cast("int").alias("query_chunks"))
        plan = F.broadcast(sizes.join(asks, "leaf"))  # at most one row a leaf of the router
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
        zero = F.lit(0).cast("long")
        queries = asked.withColumn("leaf", F.explode("leaves")).join(plan, "leaf").select("leaf", every("base_chunks").alias("b"), part("query_chunks", "a", "p").alias("c"), F.lit(1).alias("side"), F.col("a").alias("id"), "p", "label", "v", "norm", "low", "high")
        base = index.join(plan, "leaf").select("leaf", part("base_chunks", "vec_id").alias("b"), every("query_chunks").alias("c"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), zero.alias("p"), "label", "v", "norm", zero.alias("low"), zero.alias("high"))
        blocks = queries.unionByName(base).repartition("leaf", "b", "c").sortWithinPartitions("leaf", "b", "c", "side")

        def walk(batches):
            for _, table in blocks_of(batches, ("leaf", "b", "c")):
                cut = int((table["side"].to_numpy() == 0).sum())
                if cut in (0, table.num_rows):
                    continue
                both = [t.combine_chunks() for t in (table.slice(0, cut), table.slice(cut))]
                base, asked = ({c: t[c].to_numpy() for c in ("id", "p", "label", "norm", "low", "high")} | {"v": matrix_of(t["v"].chunk(0), width, kind)} for t in both)
                walker = Walker(base["id"], base["label"], base["v"], base["norm"], router.value.largest)
                out = [walker.nearest(asked["v"][i], int(asked["norm"][i]), int(asked["id"][i]), int(asked["label"][i]), same, int(asked["low"][i]), int(asked["high"][i]), k) for i in range(len(asked["id"]))]
                n = [len(ids) for ids, _ in out]
                columns = [np.repeat(asked["id"], n), np.repeat(asked["p"], n), np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "p", "vec_id", "score"])

        return blocks.mapInArrow(tidy(walk), "a long, p long, vec_id long, score long")

    near = stored(top(visit(routed(queries, 0, first))), "negatives-near")
    floor = near.groupBy("a", "p").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    rest = queries.join(floor, ["a", "p"], "left").withColumn("low", F.coalesce(F.greatest("low", "floor"), "low")).drop("floor")
    return stored(top(near.unionByName(visit(routed(rest, first, None)))), "negatives-found")


def matrix_of(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Lists of whole numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def mined(rows: DataFrame, width: int, positives: int, negatives: int, least: int, sample: int, most_leaves: int, first: int, chunk: int, query_chunk: int) -> DataFrame:
    """Negatives among ``rows(vec_id, label, v, norm, anchor)`` of one length."""
    spark = rows.sparkSession
    n, largest = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    kind = "f8" if largest < 1 << 53 else "i8"  # sums of products are exact in either
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v", "norm").toArrow().combine_chunks()
    fitted = fitted_router(matrix_of(taken["v"].chunk(0), width, kind), taken["norm"].to_numpy(), float(largest), int(min(most_leaves, max(1, n // chunk))))
    router = broadcast(spark, fitted)  # at most most_leaves vectors

    def place(batches):
        for batch in batches:
            leaf = router.value.leaves(matrix_of(batch.column("v"), width, kind), batch.column("norm").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v", "norm", "anchor")), pa.array(leaf.astype("i4"))], names=["vec_id", "label", "v", "norm", "anchor", "leaf"])

    index = stored(rows.select("vec_id", "label", "v", "norm", "anchor").mapInArrow(tidy(place), "vec_id long, label long, v array<long>, norm long, anchor boolean, leaf int"), "negative-index")
    ask = functools.partial(search, index, router, width=width, kind=kind, first=first, chunk=chunk, query_chunk=query_chunk)
    asks = index.where("anchor").select(F.col("vec_id").alias("a"), "label", "v", "norm")
    found = ask(asks.withColumns({"p": F.col("a"), "low": F.lit(-MOST), "high": F.lit(MOST)}), same=True, k=positives).select("a", F.col("vec_id").alias("p"), "score")
    # The least whole number that is no less than the share ``least`` of the score, without overflow.
    low = F.expr(f"score - ((score div 100) * {100 - least} + ((score % 100) * {100 - least}) div 100)")
    windows = asks.join(found, "a").withColumns({"low": low, "high": F.col("score")}).where("score >= 0").drop("score")
    chosen = ask(windows, same=False, k=negatives)
    rank = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.col("score").desc(), "vec_id"))
    return chosen.select(F.col("a").alias("anchor_id"), F.col("p").alias("positive_id"), rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(found.select(F.col("a").alias("anchor_id"), F.col("p").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256, sample: int = 16_384, most_leaves: int = 1024, first: int = 1, chunk: int = 4096, query_chunk: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id, label, embedding)``.

    Scores are inner products of the components times ``scale``, rounded down; ties go to the smaller vec_id.
    For each row where ``anchor`` holds and each of its ``positives`` best rows of the same label, the best
    ``negatives`` rows of other labels with scores from ``least`` hundredths of the positive's up to it.

    The top tree is fitted on at most ``sample`` vectors (least hashes) and has at most ``most_leaves`` leaves;
    every vector is indexed in it, and the search is exact. A leaf is cut into chunks of ``chunk`` vectors and
    its queries into chunks of ``query_chunk``; a task holds one block of two chunks at a time. Rows that take no part,
    and several rows of one vec_id, are those of ``whole_rows``; vectors of each length are searched by
    themselves. A positive with a negative score has no window. An empty table has no rows.
    """
    rows = stored(whole_rows(vectors.withColumn("anchor", F.coalesce(anchor, F.lit(False))), scale), "negative-rows")
    widths = sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect())  # the lengths that occur
    found = [mined(rows.where(F.size("v") == d), d, positives, negatives, least, sample, most_leaves, first, chunk, query_chunk) for d in widths if d]
    if not found:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return functools.reduce(DataFrame.unionByName, found)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with the labels of every seventh moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
