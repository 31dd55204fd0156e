"""Representative frames of states: nearest to the centroid, medoids, spread-out ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.clustering import centroids
from framewright.sources.shared import stored


def closest_to_centroid(df: DataFrame, x: str, state: str, key: str, k: int = 1, weight: str | None = None) -> DataFrame:
    """(state, rank, key, distance): the k rows nearest each state's (weighted) mean, ties by key."""
    if weight is None:
        mean = centroids(df, x, state).select(state, "centre")
    else:
        long = df.select(state, F.col(weight).alias("w"), F.posexplode(x).alias("k", "v")).groupBy(state, "k").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
        mean = long.groupBy(state).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))
    gap = F.sqrt(F.aggregate(F.zip_with(x, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    own = df.join(mean, state).select(state, key, F.round(gap, 9).alias("distance"))
    w = Window.partitionBy(state).orderBy("distance", key)
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(state, "rank", key, "distance")


def as_rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), d)


def batch_groups(batch: pa.RecordBatch, by: str) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of a whole-number column with the rows that have it."""
    values = batch.column(by).to_numpy(zero_copy_only=False)
    order = np.argsort(values, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(values) else []:
        yield int(values[part[0]]), part


def added(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sums of ``partials(s, v array<double>)`` by s: one partial row a task and state."""
    total: dict[int, np.ndarray] = {}
    for r in partials.toLocalIterator():
        total[r.s] = total[r.s] + r.v if r.s in total else np.array(r.v)
    return total


def state_sums(rows: DataFrame, d: int, value) -> dict[int, np.ndarray]:
    """Sum over each state's rows of what ``value(state, matrix, weights)`` gives for a part of them; a task sends one vector a state."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            m, w = as_rows(batch.column("x"), d), batch.column("w").to_numpy()
            for s, part in batch_groups(batch, "s"):
                v = value(s, m[part], w[part])
                total[s] = total[s] + v if s in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["s", "v"])

    return added(rows.select("s", "x", "w").mapInArrow(run, "s int, v array<double>"))


def sum_bounds(m: np.ndarray, total: float, mean: np.ndarray, moments: np.ndarray, pivots: np.ndarray, pivot_sums: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest weighted sum of distances to a state's rows that each row of ``m`` may have.

    Let y be a row's mean squared distance, known from the state's moments. The mean distance is at most the root
    of y (a root is concave), and at least that root times 1 - var / (2 y^2), var being the variance of the squared
    distances; that is tight where distances vary little, as in many dimensions. By the triangle inequality the sum
    differs from a pivot's by no more than ``total`` times the distance to it. The mean distance to a part of the rows
    is no less than the distance to their mean: ``cells`` has a weight and a weighted sum of rows for each part, those
    nearest a pivot, which is tight in few dimensions.
    """
    d = m.shape[1]
    second, fourth, third, spread = moments[0], moments[1], moments[2 : 2 + d], moments[2 + d :].reshape(d, d)
    u = m - mean
    size = (u**2).sum(1)
    y = size + second
    fourth_of = size**2 + fourth + 4 * ((u @ spread) * u).sum(1) + 2 * size * second - 4 * u @ third
    part = np.where(y > 0, np.maximum(fourth_of - y * y, 0) / np.maximum(2 * y * y, 1e-300), 0)
    high = total * np.sqrt(y)
    low = np.maximum(high * (1 - part), total * np.sqrt(size))
    if len(pivots):
        far = np.stack([np.sqrt(((m - p) ** 2).sum(1)) for p in pivots], 1)
        low = np.maximum(low, np.abs(total * far - pivot_sums).max(1))
        high = np.minimum(high, (total * far + pivot_sums).min(1))
    if len(cells):
        some = cells[cells[:, 0] > 0]
        parts = [w * np.sqrt(((m - v / w) ** 2).sum(1)) for w, v in zip(some[:, 0], some[:, 1:], strict=True)]
        low = np.maximum(low, np.sum(parts, 0)) if parts else low
    slack = 1e-9 * (1 + total * np.sqrt(y))
    return low - slack, high + slack


def distance_sums(candidates: np.ndarray, m: np.ndarray, w: np.ndarray, step: int = 32) -> np.ndarray:
    """Weighted sum of distances from each candidate to the rows ``m``."""
    gap, out = np.empty_like(m), []
    for i in range(0, len(candidates), step):
        some = candidates[i : i + step]
        far = np.empty((len(some), len(m)))
        for j, x in enumerate(some):  # one candidate's differences stay in the processor's cache
            np.subtract(x, m, out=gap)
            np.multiply(gap, gap, out=gap)
            gap.sum(1, out=far[j])
        out.append(np.sqrt(far, out=far) @ w)
    return np.concatenate(out)


def medoids(df: DataFrame, x: str, state: str, key: str, k: int = 1, weight: str | None = None, pivots: int = 64, chunk: int = 2048) -> DataFrame:
    """(state, rank, key, score): the k rows of the least (weighted) sum of distances to their state's rows, ties by key.

    Exact for states of any size: two passes bound every row's sum by the state's moments, by ``pivots`` rows
    with known sums (half of them those nearest the mean) and by the parts of the state around them, a row whose least sum is above the k-th largest-possible one is given up, and the sums of
    the others are added up over blocks of at most about ``chunk`` candidates and ``chunk`` rows, each block by
    itself. The driver and broadcasts hold moments and pivots: d squared numbers a state. Null vectors, states and keys are left out, and
    a null weight is none; all vectors have one length. An empty table has no rows.
    """
    kinds = dict(df.dtypes)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    own = df.where(F.col(x).isNotNull() & F.col(state).isNotNull() & F.col(key).isNotNull()).select(F.col(state).alias("state"), F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x"), w.alias("w"))
    names = [r.state for r in own.select("state").distinct().orderBy("state").collect()]
    schema = f"{state} {kinds[state]}, rank int, {key} {kinds[key]}, score double"
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], schema)
    place = spark.createDataFrame(list(enumerate(names)), f"s int, state {kinds[state]}")
    rows = stored(own.join(F.broadcast(place), "state").select("s", "key", "x", "w"), "medoid-rows")  # as many rows as states
    d = rows.agg(F.max(F.size("x"))).first()[0]
    first = state_sums(rows, d, lambda s, m, w: np.concatenate([[w.sum(), len(m)], w @ m]))
    total, mean = {s: v[0] for s, v in first.items()}, {s: v[2:] / v[0] if v[0] else v[2:] * 0 for s, v in first.items()}
    middle = F.broadcast(spark.createDataFrame([(s, v.tolist()) for s, v in mean.items()], "s int, centre array<double>"))
    gap = F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    ranked = rows.join(middle, "s").select("s", "x", *[F.row_number().over(Window.partitionBy("s").orderBy(*by)).alias(c) for c, by in (("n", [F.xxhash64("key"), "key"]), ("m", [gap, "key"]))])
    picked: dict[int, list] = {s: [] for s in first}
    for r in ranked.where((F.col("n") <= pivots // 2) | (F.col("m") <= -(-pivots // 2))).select("s", "x").collect():  # at most pivots rows a state
        picked[r.s].append(r.x)
    pivot = {s: np.array(v) for s, v in picked.items()}

    def moments(s, m, w):
        u = m - mean[s]
        size = (u**2).sum(1)
        far = np.stack([np.sqrt(((m - p) ** 2).sum(1)) for p in pivot[s]], 1)
        nearest = np.zeros((len(m), far.shape[1]))
        nearest[np.arange(len(m)), far.argmin(1)] = w
        cells = np.concatenate([nearest.sum(0)[:, None], nearest.T @ m], 1)
        return np.concatenate([[w @ size, w @ size**2], (w * size) @ u, ((u * w[:, None]).T @ u).ravel(), w @ far, cells.ravel()])

    second = state_sums(rows, d, moments)
    n_moments = 2 + d + d * d
    known = {s: (v[:n_moments] / max(total[s], 1e-300), v[n_moments : n_moments + len(pivot[s])], v[n_moments + len(pivot[s]) :].reshape(-1, d + 1)) for s, v in second.items()}
    shared = spark.sparkContext.broadcast((total, mean, known, pivot))

    def bound(batches):
        total, mean, known, pivot = shared.value
        for batch in batches:
            m = as_rows(batch.column("x"), d)
            low, high = np.zeros(len(m)), np.zeros(len(m))
            for s, part in batch_groups(batch, "s"):
                low[part], high[part] = sum_bounds(m[part], total[s], mean[s], known[s][0], pivot[s], *known[s][1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], names=["s", "key", "x", "w", "low", "high"])

    bounded = stored(rows.mapInArrow(bound, f"s int, key {kinds[key]}, x array<double>, w double, low double, high double"), "medoid-bounds")
    least = bounded.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("high"))).where(F.col("n") <= k).groupBy("s").agg(F.max("high").alias("most"))
    chosen = bounded.join(F.broadcast(least), "s").where("low <= most").select("s", "key", "x")
    chosen = stored(chosen, "medoid-candidates")
    pieces = lambda t, c: t.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(c))
    plan = F.broadcast(pieces(chosen, "cs").join(pieces(rows, "rs"), "s"))  # a row a state
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    asked = chosen.join(plan, "s").select("s", part("cs").alias("a"), every("rs").alias("b"), "key", "x")
    base = rows.join(plan, "s").select("s", every("cs").alias("a"), part("rs").alias("b"), "x", "w")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"s": pa.array([], pa.int32()), "key": left["key"].slice(0, 0), "v": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        v = distance_sums(as_rows(left["x"].chunk(0), d), as_rows(right["x"].chunk(0), d), right["w"].to_numpy())
        return pa.table({"s": left["s"], "key": left["key"], "v": v})

    sums = asked.groupBy("s", "a", "b").cogroup(base.groupBy("s", "a", "b")).applyInArrow(block, f"s int, key {kinds[key]}, v double")
    scored = sums.groupBy("s", "key").agg(F.round(F.sum("v"), 9).alias("score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("score", "key"))).where(F.col("rank") <= k)
    return best.join(F.broadcast(place), "s").select(F.col("state").alias(state), "rank", F.col("key").alias(key), "score")


def farthest_points(df: DataFrame, x: str, state: str, key: str, k: int = 3, cut_every: int = 4) -> DataFrame:
    """(state, rank, key, score): greedy max-min, the row nearest the centroid, then each time the row farthest from those taken.

    Each pick is one aggregation over the rows, which carry their distance to the nearest taken row; a state's rows
    lie in any number of tasks. The running distances are stored every ``cut_every`` picks. Rows with a
    null vector, state or key are left out; a state of fewer different vectors than k gives fewer rows. Ties go to the least key.
    """
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    own = df.where(F.col(x).isNotNull() & F.col(state).isNotNull() & F.col(key).isNotNull()).select(F.col(state).alias("s"), F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x"))
    mean = centroids(own, "x", "s").select("s", "centre")
    far = own.join(mean, "s").select("s", "key", "x", F.round(apart("x", "centre"), 9).alias("gap"))
    best = F.min(F.struct("gap", "key", "x")).alias("p")
    pick = stored(far.groupBy("s").agg(best).select("s", F.col("p.key").alias("key"), F.col("p.x").alias("taken"), F.lit(0.0).alias("score")), "spread-picks")
    out = [pick.select("s", F.lit(1).alias("rank"), "key", "score")]
    rows = own.withColumn("gap", F.lit(float("inf")))
    for rank in range(2, k + 1):
        rows = rows.join(pick.select("s", "taken"), "s").select("s", "key", "x", F.least("gap", F.sqrt(apart("x", "taken"))).alias("gap"))
        if rank % cut_every == 0:
            rows = stored(rows, "spread-rows")
        best = F.min(F.struct((-F.round("gap", 9)).alias("g"), "key", "x", "gap")).alias("p")
        pick = stored(rows.groupBy("s").agg(best).select("s", F.col("p.key").alias("key"), F.col("p.x").alias("taken"), F.col("p.gap").alias("score")), "spread-picks")
        out.append(pick.where("score > 0").select("s", F.lit(rank).alias("rank"), "key", "score"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select(F.col("s").alias(state), "rank", F.col("key").alias(key), "score")


def representatives(df: DataFrame, x: str, state: str, key: str, k: int = 1, method: str = "closest_to_centroid") -> DataFrame:
    """Dispatch; ``centroid`` is the first method with one row a state."""
    if method in ("closest_to_centroid", "centroid"):
        return closest_to_centroid(df, x, state, key, 1 if method == "centroid" else k)
    if method == "true_medoid":
        return medoids(df, x, state, key, k)
    if method == "diverse":
        return farthest_points(df, x, state, key, k)
    raise ValueError(f"unknown method {method!r}")


def from_band(df: DataFrame, committor: DataFrame, x: str, state: str, key: str, band: tuple[float, float] = (0.4, 0.6), k: int = 5) -> DataFrame:
    """Spread-out rows of the states whose committor lies in the band."""
    return farthest_points(df.join(committor.where(F.col("q").between(*band)).select(state), state, "left_semi"), x, state, key, k)


def from_flux(df: DataFrame, flux: DataFrame, x: str, state: str, key: str, n: int = 5, k: int = 1) -> DataFrame:
    """Rows nearest the centroids of the n states of the largest flux."""
    top = flux.orderBy(F.desc("flux"), state).limit(n).select(state)
    return closest_to_centroid(df.join(top, state, "left_semi"), x, state, key, k)
