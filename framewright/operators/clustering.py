"""Discretisation of feature rows: grids, k-means and nearest-centre assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from framewright.functions.scalars import bin_index


def squared_distance(x: Column, centre: list[float]) -> Column:
    """Squared distance of an array column to a constant point."""
    other = F.array(*[F.lit(float(v)) for v in centre])
    return F.aggregate(F.zip_with(x, other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


#: Numbers that one projection may hold as constants; generated code has a limit of its own.
MOST_CONSTANTS = 2048


def nearest_by_batches(df: DataFrame, x: str, centres: np.ndarray, rows: int = 1024) -> DataFrame:
    """``nearest_centre`` by the differences of ``rows`` rows at a time from every centre."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        own = shared.value
        for batch in batches:
            column = batch.column(x)
            known = np.flatnonzero(~np.asarray(column.is_null()))
            m = column.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(known), own.shape[1])
            state, gap = np.zeros(len(column), "i4"), np.zeros(len(column))
            for a in range(0, len(m), rows):
                part = m[a : a + rows]
                best, at = np.full(len(part), np.inf), np.zeros(len(part), "i4")
                for i, c in enumerate(own):
                    d = ((part - c) ** 2).sum(1)
                    at[d < best] = i
                    best = np.minimum(best, d)
                state[known[a : a + rows]], gap[known[a : a + rows]] = at, best
            none = np.ones(len(column), bool)
            none[known] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state, mask=none), pa.array(gap, mask=none)], names=[*batch.schema.names, "state", "distance"])

    bare = df.drop("state", "distance")
    return bare.mapInArrow(run, StructType([*bare.schema.fields, StructField("state", IntegerType()), StructField("distance", DoubleType())]))


def nearest_centre(df: DataFrame, x: str, centres: list[list[float]]) -> DataFrame:
    """Rows with ``state``, the index of the nearest centre (ties to the least), and its squared ``distance``.

    Few centres are constants of one projection, more are a broadcast matrix that each batch of rows is
    compared with: no join, no shuffle. A null vector has no state.
    """
    if len(centres) * len(centres[0]) > MOST_CONSTANTS:
        return nearest_by_batches(df, x, np.array(centres, "f8"))
    made = F.array_min(F.array(*[F.struct(squared_distance(F.col(x), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return df.withColumn("_m", made).withColumn("state", F.col("_m.i")).withColumn("distance", F.col("_m.d")).drop("_m")


def lloyd_step(df: DataFrame, x: str, centres: list[list[float]]) -> DataFrame:
    """(state, k, value, n): new centres in long form after one assignment."""
    own = nearest_centre(df, x, centres).select("state", F.posexplode(x).alias("k", "v"))
    return own.groupBy("state", "k").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("n"))


def lloyd(df: DataFrame, x: str, centres: list[list[float]], rounds: int) -> list[list[float]]:
    """Lloyd's algorithm from given centres for a fixed number of rounds; empty clusters stay."""
    for _ in range(rounds):
        new = [list(c) for c in centres]
        for r in lloyd_step(df, x, centres).collect():  # clusters times dimensions
            new[r.state][r.k] = r.value
        centres = new
    return centres


def k_means_model(df: DataFrame, x: str, k: int, seed: int = 42, rounds: int = 50) -> KMeansModel:
    """MLlib k-means (k-means|| start) of an array column."""
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="state").fit(df.withColumn("_v", array_to_vector(x)))


def labelled(model: KMeansModel, df: DataFrame, x: str) -> DataFrame:
    """Rows with ``state``, the model's cluster of an array column."""
    return model.transform(df.withColumn("_v", array_to_vector(x))).drop("_v")


def k_means(df: DataFrame, x: str, k: int, seed: int = 42, rounds: int = 50) -> tuple[DataFrame, list[list[float]], float]:
    """MLlib k-means (k-means|| start): rows with ``state``, centres and inertia; empty clusters are left out."""
    model = k_means_model(df, x, k, seed, rounds)
    return labelled(model, df, x), [c.tolist() for c in model.clusterCenters()], float(model.summary.trainingCost)


def select_k(df: DataFrame, x: str, ks: range = range(4, 21), seed: int = 42) -> int:
    """The k of the best silhouette (squared Euclidean), the least of several."""
    data = df.withColumn("_v", array_to_vector(x))
    judge, best = ClusteringEvaluator(featuresCol="_v", predictionCol="state"), (-2.0, ks[0])
    for k in ks:
        made = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="state").fit(data).transform(data)
        if made.select("state").distinct().count() > 1 and (score := judge.evaluate(made)) > best[0] + 1e-12:
            best = (score, k)
    return best[1]


def drawn_below(batch: int, rows: int) -> int:
    """The bound on a 63-bit hash under which about ``batch`` of ``rows`` rows fall; at any number of rows at least 1."""
    return min((1 << 63) - 1, max(1, ((1 << 63) * batch) // max(rows, 1)))


def mini_batch_k_means(df: DataFrame, x: str, k: int, key: str, batch: int = 10_000, rounds: int = 30, seed: int = 42) -> list[list[float]]:
    """Centres by mini-batches: each round about ``batch`` rows, drawn by a hash of ``key``, move their nearest centres.

    A centre moves by its rows' share of all that it has seen, so later rounds move it less. A round is
    one aggregation to k centres; the start are the rows of the least hashes. A round that draws no row at all
    draws again with another hash; a table of which ten rounds in a row draw nothing has no usable key and is an error.
    """
    rows = df.count()
    spread = lambda r: F.xxhash64(F.lit(seed), F.lit(r), key)
    centres = [list(r[0]) for r in df.select(x).distinct().orderBy(F.xxhash64(F.lit(seed), x)).limit(k).collect()]
    seen = [0] * len(centres)
    below = drawn_below(batch, rows)
    salt = 0
    for r in range(rounds if centres else 0):
        moved: dict[int, tuple[int, dict[int, float]]] = {}
        for _ in range(10):
            part = df if rows <= batch else df.where(F.shiftrightunsigned(spread(r + salt), 1) < F.lit(below))
            for row in lloyd_step(part, x, centres).collect():  # clusters times dimensions
                moved.setdefault(row.state, (row.n, {}))[1][row.k] = row.value
            if moved:
                break
            salt += rounds
        else:
            raise ValueError("no batch holds a row: the key does not tell rows apart, or the count is wrong")
        for i, (n, mean) in moved.items():
            seen[i] += n
            centres[i] = [c + n / seen[i] * (mean[j] - c) for j, c in enumerate(centres[i])]
    return centres


def microstates(df: DataFrame, x: str, key: str, n_states: int | str = "auto", method: str = "auto", seed: int = 42, restarts: int = 3, minibatch_rows: int = 5_000_000, ks: range = range(4, 21)) -> tuple[DataFrame, list[list[float]]]:
    """Rows with dense ``state`` and the means of the states.

    ``auto`` takes k by silhouette and mini-batches from ``minibatch_rows`` rows on. k is no more than the
    different rows; the best of ``restarts`` starts by inertia is kept, empty states are left out.
    """
    if method not in ("auto", "kmeans", "minibatchkmeans"):
        raise ValueError(f"unknown method {method!r}")
    if method == "auto":
        method = "minibatchkmeans" if df.count() >= minibatch_rows else "kmeans"
    k = select_k(df, x, ks, seed) if n_states == "auto" else int(n_states)
    if k < 1:
        raise ValueError("at least one state is needed")
    k = min(k, df.select(x).distinct().limit(k).count())
    if k == 0:
        return df.withColumn("state", F.lit(None).cast("int")), []
    best: tuple[float, list[list[float]]] | None = None
    for r in range(max(1, restarts)):
        if k == 1:
            centres = [centroids(df.withColumn("_s", F.lit(0)), x, "_s").first().centre]
        else:
            centres = k_means(df, x, k, seed + r)[1] if method == "kmeans" else mini_batch_k_means(df, x, k, key, seed=seed + r)
        cost = inertia(df, x, centres)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, centres)
    own = nearest_centre(df, x, best[1]).drop("distance")
    means = {r.state: r.centre for r in centroids(own, x, "state").collect()}  # a row a state
    names = sorted(means)
    dense = F.element_at(F.create_map(*[v for i, s in enumerate(names) for v in (F.lit(s), F.lit(i))]), F.col("state"))
    return own.withColumn("state", dense.cast("int")), [list(means[s]) for s in names]


def grid_cells(df: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """Rows with ``cell``, the bins of all columns as one number; a constant column has one bin of width 1."""
    cell = F.lit(0).cast("long")
    for c in columns:
        low, high = ranges[c]
        if low == high:
            low, high = low - 0.5, high + 0.5
        cell = cell * bins + bin_index(F.col(c), low, high, bins)
    return df.withColumn("cell", cell)


def grid_states(fit: DataFrame, columns: list[str], n_states: int, order: str, other: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """States by grid cell, numbered by the first ``order`` value of a cell among the fitted rows.

    round(n_states^(1/d)) bins a dimension. Cells that only ``other`` rows have are numbered after the
    fitted ones, by their own first value; assigning never changes the fitted numbers.
    """
    bins = max(1, round(n_states ** (1 / len(columns))))
    row = fit.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    ranges = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}
    own = grid_cells(fit, columns, ranges, bins)
    seen = own.groupBy("cell").agg(F.min(order).alias("first")).withColumn("late", F.lit(0))
    rows = own
    if other is not None:
        rows = grid_cells(other, columns, ranges, bins)
        new = rows.groupBy("cell").agg(F.min(order).alias("first")).join(seen.select("cell"), "cell", "left_anti").withColumn("late", F.lit(1))
        seen = seen.unionByName(new)
    named = seen.withColumn("state", (F.dense_rank().over(Window.orderBy("late", "first", "cell")) - 1).cast("int")).select("cell", "state")  # a row a cell
    return rows.join(named, "cell").drop("cell"), ranges


def centroids(df: DataFrame, x: str, state: str) -> DataFrame:
    """(state, centre, n): mean array of each state."""
    long = df.select(state, F.posexplode(x).alias("k", "v")).groupBy(state, "k").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return long.groupBy(state).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def inertia(df: DataFrame, x: str, centres: list[list[float]]) -> float:
    return float(nearest_centre(df, x, centres).agg(F.sum("distance")).first()[0] or 0.0)


def as_matrix(df: DataFrame, x: str) -> np.ndarray:
    """Rows of a small array column."""
    return np.array([r[0] for r in df.select(x).collect()], "f8")
