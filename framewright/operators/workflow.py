"""Whole analyses composed of the operators: discretisation, diagnostics, ensembles, complete models."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import linalg
from framewright.functions.scalars import is_finite
from framewright.operators import clustering as K
from framewright.operators import counts as C
from framewright.operators import msm as M
from framewright.operators import pairs as P
from framewright.operators import reduction as R
from framewright.operators import tpt as T
from framewright.sources.shared import stored


def recognised_splits(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of proper splits: a named split that does not start with ``__``, all columns finite; no split is ``all``."""
    out = df if "split" in df.columns else df.withColumn("split", F.lit("all"))
    keep = ~F.col("split").startswith("__")
    for c in columns:
        keep = keep & is_finite(F.col(c))
    return out.where(keep)


@dataclass
class Discretisation:
    """States of all splits, counts of the fitted one and how they came about."""

    states: DataFrame
    counts: DataFrame
    matrix: DataFrame
    summary: dict


def discretise(df: DataFrame, columns: list[str], *, n_states: int = 150, lag: int = 1, mode: str = "kmeans", weight: str | None = None, least_out: float = 0.0, seed: int = 0, segment: tuple[str, ...] = (), starts: int = 10) -> Discretisation:
    """Fit on split ``train`` (or the first), assign every split, count, prune and normalise.

    ``df(split, traj_id, frame, columns...)``; pairs stay within a trajectory and ``segment``. k-means works on
    z-scores of the fitted split (sample deviation), and the best of ``starts`` starts by inertia is kept.
    """
    rows = recognised_splits(df, columns)
    names = sorted(r.split for r in rows.select("split").distinct().collect())
    if not names:
        raise ValueError("no split has finite rows")
    fit = "train" if "train" in names else names[0]
    own = rows.where(F.col("split") == fit)
    if mode == "grid":
        every, _ = K.grid_states(own.withColumn("_o", F.struct("traj_id", "frame")), columns, n_states, "_o", rows.withColumn("_o", F.struct("traj_id", "frame")))
        centres: list = []
    elif mode == "kmeans":
        stats = own.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        z = F.array(*[(F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] if (stats[f"s{i}"] or 0) > 1e-10 else 1.0) for i, c in enumerate(columns)])
        scored = own.select(z.alias("_z"))
        _, centres, _ = min((K.k_means(scored, "_z", n_states, seed + i) for i in range(max(1, starts))), key=lambda made: made[2])
        every = K.nearest_centre(rows.withColumn("_z", z), "_z", centres).drop("_z", "distance")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    keys = ("traj_id", *segment)
    train = every.where(F.col("split") == fit)
    kept = C.pruned(train, lag, least_out).withColumn("state", F.col("label")).drop("label")
    counts = C.transition_counts(kept, [lag], weight=weight, keys=keys)
    matrix = C.normalised(counts)
    lengths = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    expected = lengths.agg(F.sum(P.expected_pairs(F.col("n_frames"), lag)).alias("n")).first().n or 0
    made = {"mode": mode, "fit": fit, "splits": names, "columns": columns, "n_states": n_states, "lag": lag, "seed": seed, "expected_pairs": int(expected)}
    made["fingerprint"] = hashlib.sha256(json.dumps(made, sort_keys=True).encode()).hexdigest()
    return Discretisation(every, counts, matrix, made)


def diagnostics(spark: SparkSession, frames: DataFrame, lag: int, mode: str = "sliding") -> DataFrame:
    """One row: pairs, zero rows, components, coverage, diagonal mass and warnings before a model is built."""
    counts = C.transition_counts(frames, [lag], mode=mode)
    visits = {r.state: r.n for r in C.visits(frames).collect()}
    c, states = C.collect_matrix(counts, sorted(visits))
    parts = linalg.strong_components(c > 0) if states else []
    share = sum(visits[states[i]] for i in parts[0]) / sum(visits.values()) if parts else 0.0
    pairs, zero = int(c.sum()), int((c.sum(1) == 0).sum())
    diagonal = float(np.diag(linalg.row_stochastic(c)).mean()) if states else 0.0
    warnings = [w for w, bad in (("TOTAL_PAIRS_LT_5000", pairs < 5000), ("ZERO_ROW_STATES_PRESENT", zero > 0), ("SCC_COVERAGE_LT_0.90", share < 0.9), ("DIAG_MASS_GT_0.95", diagonal > 0.95)) if bad]
    isolated = sorted(str(states[i]) for part in parts[1:] for i in part)
    return spark.createDataFrame([(lag, len(states), pairs, zero, len(parts), float(share), diagonal, isolated, warnings)], "lag int, n_states int, pairs long, zero_rows int, components int, coverage double, diag_mass double, isolated array<string>, warnings array<string>")


def split_diagnostics(frames: DataFrame, column: str, taus: list[int]) -> tuple[DataFrame, float]:
    """Autocorrelation curve and its integrated time."""
    curve = R.autocorrelation(frames, column, taus)
    rows = curve.collect()  # a row a lag
    return curve, R.integrated_autocorrelation([r.tau for r in rows], [r.rho for r in rows])


def recommended_lags(tau: float, limit: int, n: int = 5) -> list[int]:
    """Lags between two and five times the integrated time, up to the limit, log-spaced."""
    low, high = max(1.0, 2 * tau), max(1.0, min(5 * tau, limit))
    return sorted({int(round(x)) for x in np.geomspace(low, max(low, high), n) if round(x) <= limit})


def ensemble(spark: SparkSession, frames: DataFrame, lags: list[int], n_clusters: list[int], x: str = "x", seed: int = 42) -> DataFrame:
    """(lag, n_clusters, t1, top): slowest timescale and most important state over a grid of settings.

    Each clustering keeps the trajectories' bounds, and its lags are counted in one scan.
    """
    rows = []
    for k in n_clusters:
        own, _, _ = K.k_means(frames, x, k, seed)
        states, made = M.matrices(own.select("traj_id", "frame", "state"), lags)
        for lag in lags:
            m = M.fitted(states, made[lag], lag)
            t = linalg.timescales(linalg.sorted_eigenvalues(m.p)[1:2], lag)
            rows.append((lag, k, float(t[0]) if len(t) and np.isfinite(t[0]) else None, int(np.argmax(T.kinetic_importance(m.p)))))
    return spark.createDataFrame(rows, "lag int, n_clusters int, t1 double, top int")


def complete_analysis(spark: SparkSession, frames: DataFrame, columns: list[str], *, n_states: int = 20, lags: tuple[int, ...] = (1, 2, 5, 10), components: int = 2, seed: int = 42) -> dict[str, DataFrame]:
    """Reduce, cluster, choose a lag, fit, validate: result tables by name.

    ``frames(traj_id, frame, columns...)``; the projection keeps every frame, so states and frames stay aligned.
    """
    projected = R.tica(frames, columns, lags[0], min(components, len(columns))).apply(frames)
    ics = [c for c in projected.columns if c.startswith("ic")]
    # MLlib evaluates what it fits twice at once in each task, and every count below reads it again: kept, each frame is projected once
    kept = projected.select("traj_id", "frame", *ics).persist()
    x = F.array(*ics)
    try:
        model = K.k_means_model(kept.withColumn("_x", x), "_x", n_states, seed)
        own, whole = (K.labelled(model, rows.withColumn("_x", x), "_x").drop("_x") for rows in (kept, projected))
        its = M.implied_timescales(spark, own, list(lags), 3)
        slow = {r.lag: r.timescale for r in its.where("k = 1").collect()}
        lag = M.lag_from_timescales(list(lags), [slow.get(t) or float("nan") for t in lags], start=1)
        m = M.markov_model(own, lag)
        states = spark.createDataFrame([(int(s), float(p)) for s, p in zip(m.states, m.pi, strict=True)], "state int, pi double")
        return {"assignments": whole, "its": its, "matrix": C.matrix_table(spark, m.p, m.states), "states": C.state_free_energies(states), "ck": M.ck_test(spark, own, lag, (2, 3), 5), "diagnostics": diagnostics(spark, own, lag)}
    finally:
        kept.unpersist()


def superposed(frames: DataFrame, selection: list[int] | None = None, reference: int = 0) -> DataFrame:
    """Positions of each trajectory rotated and shifted onto its reference frame (Kabsch).

    The reference frame's positions travel with the rows, so that a batch of any frames is turned at once: one
    decomposition of a stack of 3 x 3 matrices. Frames without positions, or with other atoms than the reference, are left out.
    """
    first = frames.where(F.col("frame") == reference).select("traj_id", F.col("pos").alias("_ref"))

    s = slice(None) if selection is None else selection

    def run(batches):
        for batch in batches:
            flat, ref = batch.column("pos"), batch.column("_ref")
            n = flat.value_lengths().to_numpy(zero_copy_only=False)
            out = np.empty((int(n.sum()), 3))
            at = np.concatenate([[0], np.cumsum(n)])
            cells = [np.stack([c.flatten().field(x).to_numpy(zero_copy_only=False) for x in "xyz"], 1) for c in (flat, ref)]
            for size in np.unique(n):  # frames of equal atom numbers together
                rows = np.flatnonzero(n == size)
                atoms = at[rows][:, None] + np.arange(size)
                a, b = (c[atoms] for c in cells)
                ca, cb = a[:, s].mean(1, keepdims=True), b[:, s].mean(1, keepdims=True)
                u, _, vt = np.linalg.svd((a[:, s] - ca).transpose(0, 2, 1) @ (b[:, s] - cb))
                d = np.ones((len(rows), 3))
                d[:, 2] = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
                out[atoms] = (a - ca) @ ((u * d[:, None, :]) @ vt) + cb
            made = pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], names=["x", "y", "z"])
            yield pa.RecordBatch.from_arrays([batch.column("traj_id"), batch.column("frame"), pa.ListArray.from_arrays(pa.array(at.astype("i4")), made)], names=["traj_id", "frame", "pos"])

    joined = frames.select("traj_id", "frame", "pos").join(first, "traj_id")
    return joined.where("pos is not null and _ref is not null and size(pos) = size(_ref)").mapInArrow(run, frames.select("traj_id", "frame", "pos").schema)


#: Feature specifications of the named profiles.
PROFILES = {"pair": ["distance([0,1])"], "backbone": ["dihedral([0,1,2,3])"], "universal": ["Rg", "distance([0,1])", "distance([0,2])", "angle([0,1,2])", "dihedral([0,1,2,3])"]}


def universal_embedding(frames: DataFrame, profile: str = "universal", method: str = "vamp", lag: int = 1, k: int = 1, align: bool = True) -> DataFrame:
    """Align, compute a profile's features, expand periodic ones to cos and sin, and reduce to k components."""
    from framewright.functions.geometry import compute_features, trig_columns

    own = superposed(frames) if align else frames
    made, periodic = compute_features(own, PROFILES[profile])
    flat = made.select("traj_id", "frame", *trig_columns(periodic))
    columns = [c for c in flat.columns if c not in ("traj_id", "frame")]
    return R.reduce_features(flat, columns, method, k, lag).apply(flat, "u").select("traj_id", "frame", *[f"u{i}" for i in range(k)])


def phi_psi_pairs(names: list[str]) -> list[tuple[str, str]]:
    """Columns ``phi:resN`` and ``psi:resN`` of the same residue, lowest residue first."""
    of = {}
    for n in names:
        kind, _, res = n.partition(":")
        if kind in ("phi", "psi") and res.startswith("res") and res[3:].isdigit():
            of.setdefault(int(res[3:]), {})[kind] = n
    return [(v["phi"], v["psi"]) for _, v in sorted(of.items()) if len(v) == 2]


def balanced_sample(pairs: DataFrame, group: str, per_group: int, seed: int, key: list[str]) -> DataFrame:
    """``per_group`` rows of each group, all of a smaller one, without replacement: those of the least hashes of (seed, key).

    Tasks send no more than ``per_group`` rows a group, so a group of any share of the rows costs no more than others.
    Rows of a null group are one group; equal keys are told apart by all their columns.
    """
    h = F.xxhash64(F.lit(seed), *key)
    place = F.row_number().over(Window.partitionBy(group).orderBy(h, *key, *[c for c in pairs.columns if c not in key]))
    return pairs.withColumn("_place", place).where(F.col("_place") <= per_group).drop("_place")


def uniform(seed: int, name: str) -> Column:
    """A number in (0, 1) from a hash of the seed and a column: the same however rows are dealt."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), name), 11).cast("double") + 0.5) / float(1 << 53)


def exact_batches(pairs: DataFrame, size: int, seed: int, key: list[str], part_rows: int = 65_536) -> DataFrame:
    """``pairs`` with ``batch``: a seeded shuffle cut into batches of exactly ``size`` rows, the last one of what is left.

    The shuffled place of a row is its rank by a hash: the rows of lesser hash ranges, a number a range, and its rank
    within its own range of about ``part_rows`` rows. Rows with equal keys are ranked by all their columns.
    """
    ranges = max(1, -(-pairs.count() // part_rows))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 1)
    own = pairs.withColumn("_h", h).withColumn("_part", F.least(F.floor(F.col("_h") / (float(1 << 63) / ranges)), F.lit(ranges - 1)))
    before = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", *key, *[c for c in pairs.columns if c not in key]))
    return own.withColumn("_rank", rank).join(before, "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_rank") - 1) / size)).drop("_h", "_part", "_rank", "_before")


def weighted_sample(pairs: DataFrame, weight: str, n: int, seed: int, key: list[str], part_rows: int = 100_000, part_draws: int = 1_000_000) -> DataFrame:
    """n draws with replacement in proportion to the weights: (draw, key...), each draw exactly one row.

    Rows are dealt by hash to parts of about ``part_rows``. A draw first takes a part: that with the least running end
    above its uniform number among the parts' weights; then a row of the part, by what is left of the number. Both
    are as-of matches, rows and draws of a part together (``part_draws`` draws at most about), so a heavy row stays one row, and neither rounding nor
    the order of sums can lose a draw. Uniform numbers are hashes of (seed, draw): partitions do not change the sample. Rows
    with a null, non-finite or non-positive weight are never drawn; without others there are no draws. A repeated key is drawn as often as
    all its rows weigh.
    """
    w = F.col(weight).cast("double")
    own = pairs.where(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))).groupBy(*key).agg(F.sum(w).alias("w"))
    own = stored(own, "sample-rows")
    parts = max(1, -(-own.count() // part_rows))
    own = own.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    sums = sorted(own.groupBy("part").agg(F.sum("w").alias("s")).collect())  # a row a part
    names, ends = [r.part for r in sums], np.cumsum([r.s for r in sums])
    if not len(ends):
        return own.select(F.lit(0).cast("long").alias("draw"), *key).limit(0)
    edges = np.concatenate([[0.0], ends])
    runs = np.maximum(1, np.ceil(np.diff(edges) / edges[-1] * n / part_draws)).astype("i4")
    shared = pairs.sparkSession.sparkContext.broadcast((np.array(names), edges, runs))
    copies = pairs.sparkSession.createDataFrame([(p, int(r)) for p, r in zip(names, runs, strict=True)], "part int, runs int")

    def placed(batches):
        names, edge, runs = shared.value
        for batch in batches:
            u = batch.column("u").to_numpy() * edge[-1]
            at = np.minimum(np.searchsorted(edge, u, side="right") - 1, len(names) - 1)
            run = batch.column("draw").to_numpy() % runs[at]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array(names[at].astype("i4")), pa.array(run.astype("i4")), pa.array((u - edge[at]) / (edge[at + 1] - edge[at]))], names=["draw", "part", "run", "u"])

    draws = pairs.sparkSession.range(n).select(F.col("id").alias("draw")).select("draw", uniform(seed, "draw").alias("u")).mapInArrow(placed, "draw long, part int, run int, u double")

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"draw": right["draw"].slice(0, 0), **{c: left[c].slice(0, 0) for c in key}})
        left = left.take(pc.sort_indices(left, [(c, "ascending") for c in key]))
        end = np.cumsum(left["w"].to_numpy())
        at = np.minimum(np.searchsorted(end, right["u"].to_numpy() * end[-1], side="right"), len(end) - 1)
        return pa.table({"draw": right["draw"], **{c: left[c].take(pa.array(at)) for c in key}})

    kinds = dict(own.dtypes)
    own = own.join(F.broadcast(copies), "part").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    return own.groupBy("part", "run").cogroup(draws.groupBy("part", "run")).applyInArrow(matched, ", ".join(["draw long", *(f"{c} {kinds[c]}" for c in key)]))
