"""Transition paths, kinetic importance, state detection and bootstrap on small matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import linalg
from framewright.functions.constants import DIRICHLET_ALPHA
from framewright.sources.shared import stored


@dataclass
class TransitionPaths:
    forward: np.ndarray
    backward: np.ndarray
    gross: np.ndarray
    net: np.ndarray
    total: float
    rate: float
    mfpt: float
    paths: list[tuple[list[int], float]]


def analyse(p: np.ndarray, source: list[int], sink: list[int], n_paths: int = 5, fraction: float = 0.99, lag: float = 1.0) -> TransitionPaths:
    """Committors, reactive flux, rate and first passage between disjoint sets of states.

    States without stationary weight carry no flux. The rate is the flux over the weight that last came
    from the source, per time; its inverse is the mean first passage time.
    """
    pi = linalg.stationary(p)
    forward, backward = linalg.committors(p, pi, source, sink)
    gross = (pi * backward)[:, None] * p * forward[None, :]
    np.fill_diagonal(gross, 0)
    net = np.maximum(0, gross - gross.T)
    total = float(gross[source].sum() - gross[:, source].sum()) if len(source) else 0.0
    weight = float((pi * backward).sum())
    rate = total / weight / lag if weight > 0 else 0.0
    paths = linalg.pathways(net, source, sink, fraction)[:n_paths]
    return TransitionPaths(forward, backward, gross, net, total, rate, 1 / rate if rate > 0 else float("inf"), paths)


def barrier(path: list[int], pi: np.ndarray) -> float:
    """Largest -ln pi along a path above its start, in kT."""
    f = -np.log(np.maximum(pi[path], 1e-12))
    return float(f.max() - f[0])


def net_flux(gross: DataFrame) -> DataFrame:
    """(src, dst, net): positive part of the flux less its reverse."""
    back = gross.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flux").alias("back"))
    return gross.join(back, ["src", "dst"], "left").select("src", "dst", F.greatest(F.lit(0.0), F.col("flux") - F.coalesce("back", F.lit(0.0))).alias("net")).where("net > 0")


def state_flux(flux: DataFrame, value: str = "flux") -> DataFrame:
    """(state, flux): what goes in and out of each state."""
    return flux.select(F.explode(F.array("src", "dst")).alias("state"), F.col(value).alias("v")).groupBy("state").agg(F.sum("v").alias("flux"))


def coarse_flux(net: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst, net) between sets; flux inside a set drops out, opposite ones cancel."""
    a, b = (sets.select(F.col("state").alias(c), F.col("set").alias(f"{c}_s")) for c in ("src", "dst"))
    gross = net.join(a, "src").join(b, "dst").where("src_s <> dst_s").groupBy(F.col("src_s").alias("src"), F.col("dst_s").alias("dst")).agg(F.sum("net").alias("flux"))
    return net_flux(gross)


def classified(q: DataFrame, low: float = 0.1, high: float = 0.9, tse: float = 0.05) -> DataFrame:
    """Committors (state, q) with their class and whether they lie in the transition-state ensemble."""
    kind = F.when(F.col("q") <= low, "source").when(F.col("q") >= high, "sink").otherwise("transition")
    return q.select("state", "q", kind.alias("kind"), F.round(F.abs(F.col("q") - 0.5), 12).between(0, tse).alias("tse"))


def kinetic_importance(p: np.ndarray, k_slow: int | None = None) -> np.ndarray:
    """pi_i sum_k phi_k(i)^2 over the slow left eigenvectors; k by the largest timescale ratio if not given."""
    pi = linalg.stationary(p)
    values, vectors = np.linalg.eig(p.T)
    order = np.lexsort((values.imag, -np.abs(values)))
    values, vectors = values[order], vectors[:, order].real
    if k_slow is None:
        t = linalg.timescales(values[1:], 1.0)
        t = t[np.isfinite(t)]
        k_slow = int(np.argmax(t[:-1] / t[1:])) + 1 if len(t) > 1 else 1
    slow = vectors[:, 1 : 1 + k_slow]
    return pi * ((slow / np.maximum(np.linalg.norm(slow, axis=0), 1e-300)) ** 2).sum(1)


def detect_from_gap(p: np.ndarray) -> tuple[list[int], list[int]]:
    """Source and sink: the two most populated of the macrostates before the largest eigenvalue gap."""
    from framewright.operators.msm import spectral_gap

    of = linalg.macrostates(p, max(2, spectral_gap(p, 2, 6)))
    if of is None:
        return detect_from_populations(linalg.stationary(p))
    return np.flatnonzero(of == 0).tolist(), np.flatnonzero(of == 1).tolist()


def detect_from_populations(pi: np.ndarray, top: int | None = None) -> tuple[list[int], list[int]]:
    """First and last of the ``top`` most populated states; at least two are needed."""
    order = np.lexsort((np.arange(len(pi)), -pi))[: top or len(pi)]
    if len(order) < 2:
        raise ValueError("at least two states are needed")
    return [int(order[0])], [int(order[-1])]


def detect_from_surface(frames: DataFrame, cells: DataFrame, bins: tuple[int, int]) -> tuple[list, list]:
    """Source and sink: the states of the frames in the two lowest minima of a surface.

    ``frames(state, bx, by)`` carry the cells of their values, so basins become states of the model and not
    grid indices. At least two minima that hold frames are needed.
    """
    from framewright.operators.histograms import local_minima

    low = local_minima(cells, bins).orderBy("free_energy", "bx", "by").limit(2)
    found = frames.where("state is not null").join(F.broadcast(low), ["bx", "by"]).groupBy("free_energy", "bx", "by").agg(F.sort_array(F.collect_set("state")).alias("s")).orderBy("free_energy", "bx", "by").collect()
    if len(found) < 2:
        raise ValueError("the surface has fewer than two minima with frames")
    a, b = (list(r.s) for r in found)
    return a, [s for s in b if s not in set(a)]


def states_in_range(frames: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Distinct states of frames whose column lies in [low, high]."""
    return frames.where(F.col(column).between(low, high) & F.col("state").isNotNull()).select("state").distinct()


def require_disjoint(a: DataFrame, b: DataFrame) -> None:
    """Raise if two sets of states meet."""
    if a.select("state").intersect(b.select("state")).limit(1).count():
        raise ValueError("the sets overlap")


def trajectory_counts(frames: DataFrame, lag: int) -> DataFrame:
    """(traj_id, src, dst, n): counts of each trajectory, from which any bootstrap draw is a weighted sum."""
    from framewright.operators.pairs import multi_lag_pairs

    pairs = multi_lag_pairs(frames, [lag], "state").where("src is not null and dst is not null")
    return pairs.groupBy("traj_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def resampled(trajectories: DataFrame, draws: int, seed: int = 0, leaf: int = 1024) -> DataFrame:
    """(traj_id, times array<int>): how often each of n trajectories is in each of ``draws`` samples of n with replacement.

    Every sample has exactly n members. Trajectories lie in a binary tree by the bits of their hash; a node's share
    of a sample is split between its halves by a binomial number with the halves' sizes, down to leaves of
    about ``leaf`` trajectories, whose members share theirs multinomially in one task. Random numbers depend on
    (seed, draw, node) alone, so neither partitions nor retries change a sample. The driver gets one number, n.
    """
    own = trajectories.select("traj_id").distinct().withColumn("h", F.xxhash64("traj_id"))
    n = own.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    own = own.withColumn("node", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = own.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    shares = trajectories.sparkSession.range(draws).select(F.col("id").alias("draw"), F.lit(0).cast("long").alias("node"), F.lit(n).alias("m"))

    def left_half(level: int):
        def draw_left(draw: pd.Series, node: pd.Series, m: pd.Series, p: pd.Series) -> pd.Series:
            return pd.Series([int(np.random.default_rng([seed, level, d, k]).binomial(x, q)) for d, k, x, q in zip(draw, node, m, p, strict=True)], dtype="int64")

        return F.pandas_udf(draw_left, "long")

    for level in range(bits):
        below = F.shiftright("node", bits - level - 1)
        halves = sizes.select(F.shiftright(below, 1).alias("node"), F.when(below % 2 == 0, F.col("size")).otherwise(0).alias("left"), "size").groupBy("node").agg((F.sum("left") / F.sum("size")).alias("p"))
        split = shares.join(halves, "node").withColumn("left", left_half(level)("draw", "node", "m", "p"))
        shares = split.select("draw", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("m")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("m") - F.col("left")).alias("m")))).alias("s")).select("draw", "s.*").where("m > 0")
        if level % 4 == 3:
            shares = stored(shares, "bootstrap-shares")

    def members(trajs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(trajs):
            return pd.DataFrame({"traj_id": [], "times": []})
        trajs = trajs.sort_values(["h", "traj_id"])
        times = np.zeros((draws, len(trajs)), "i4")
        for d, m, node in zip(own["draw"], own["m"], own["node"], strict=True):
            times[d] = np.random.default_rng([seed, bits, d, node]).multinomial(m, np.full(len(trajs), 1 / len(trajs)))
        return pd.DataFrame({"traj_id": trajs["traj_id"].to_numpy(), "times": list(times.T)})

    kind = dict(own.dtypes)["traj_id"]
    return own.groupBy("node").cogroup(shares.groupBy("node")).applyInPandas(members, f"traj_id {kind}, times array<int>")


def bootstrap_counts(frames: DataFrame, lag: int, draws: int, seed: int = 0) -> DataFrame:
    """(draw, src, dst, n): counts of ``draws`` resamplings of all n trajectories, n of n with replacement.

    The trajectories' own counts are made once; a draw is a weighted sum of them.
    """
    times = resampled(frames, draws, seed)
    drawn = trajectory_counts(frames, lag).join(times, "traj_id").select("src", "dst", "n", F.posexplode("times").alias("draw", "times")).where("times > 0")
    return drawn.groupBy((F.col("draw") + 1).alias("draw"), "src", "dst").agg(F.sum(F.col("n") * F.col("times")).alias("n"))


def bootstrap_paths(frames: DataFrame, lag: int, states: list, source: list[int], sink: list[int], draws: int = 200, seed: int = 0, ci: tuple[float, float] = (2.5, 97.5)) -> DataFrame:
    """(quantity, mean, std, lo, hi) of rate, first passage and flux over draws; draws that fail are left out.

    Each draw's small matrix is solved in a grouped map.
    """
    at = {s: i for i, s in enumerate(states)}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((len(states), len(states)))
        for a, b, n in zip(pdf["src"], pdf["dst"], pdf["n"], strict=True):
            c[at[a], at[b]] = n
        try:
            t = analyse(linalg.row_stochastic(c + DIRICHLET_ALPHA), source, sink, 1, 0.1, lag)
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame({"draw": [], "rate": [], "mfpt": [], "flux": []})
        return pd.DataFrame({"draw": [int(pdf["draw"].iloc[0])], "rate": [t.rate], "mfpt": [t.mfpt], "flux": [t.total]})

    made = bootstrap_counts(frames, lag, draws, seed).groupBy("draw").applyInPandas(solve, "draw int, rate double, mfpt double, flux double")
    long = made.selectExpr("stack(3, 'rate', rate, 'mfpt', mfpt, 'flux', flux) as (quantity, v)")
    return long.groupBy("quantity").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.percentile("v", ci[0] / 100).alias("lo"), F.percentile("v", ci[1] / 100).alias("hi"))


def importance_stability(frames: DataFrame, lag: int, states: list, draws: int = 200, top: int = 10, seed: int = 0) -> tuple[float, np.ndarray]:
    """Mean overlap of the top states over draws with those of all data, and the scores' deviation."""
    at = {s: i for i, s in enumerate(states)}
    whole = np.zeros((len(states), len(states)))
    for r in trajectory_counts(frames, lag).groupBy("src", "dst").agg(F.sum("n").alias("n")).collect():
        whole[at[r.src], at[r.dst]] = r.n
    score = lambda c: kinetic_importance(linalg.row_stochastic(c + DIRICHLET_ALPHA))
    best = set(np.argsort(-score(whole), kind="stable")[:top].tolist())
    per: dict[int, np.ndarray] = {}
    for r in bootstrap_counts(frames, lag, draws, seed).collect():  # draws times states squared
        per.setdefault(r.draw, np.zeros_like(whole))[at[r.src], at[r.dst]] = r.n
    all_scores = np.array([score(c) for c in per.values()])
    overlap = [len(best & set(np.argsort(-s, kind="stable")[:top].tolist())) / len(best) for s in all_scores]
    return float(np.mean(overlap)), all_scores.std(0)


def paths_table(spark: SparkSession, t: TransitionPaths, states: list) -> DataFrame:
    """(rank, path, flux, share)."""
    rows = [(i + 1, [str(states[s]) for s in path], float(f), float(f / t.total) if t.total else 0.0) for i, (path, f) in enumerate(t.paths)]
    return spark.createDataFrame(rows, "rank int, path array<string>, flux double, share double")


def conformations(spark: SparkSession, frames: DataFrame, lag: int = 5, n_macro: int = 2, tse: float = 0.05) -> DataFrame:
    """One row a state: population, macrostate, committor, class, flux and kinetic importance.

    The states are counted once; model, macrostates, transition paths and importance follow from the matrix.
    """
    from framewright.operators.msm import markov_model

    m = markov_model(frames, lag)
    of = linalg.macrostates(m.p, n_macro)
    source, sink = detect_from_gap(m.p) if of is None else (np.flatnonzero(of == 0).tolist(), np.flatnonzero(of == 1).tolist())
    t = analyse(m.p, source, sink, lag=lag)
    score = kinetic_importance(m.p)
    rows = [(str(s), float(m.pi[i]), int(of[i]) if of is not None else None, float(t.forward[i]), float(t.gross[i].sum() + t.gross[:, i].sum()), float(score[i]), "source" if i in source else "sink" if i in sink else "transition" if abs(t.forward[i] - 0.5) <= tse else "intermediate") for i, s in enumerate(m.states)]
    return spark.createDataFrame(rows, "state string, population double, macro int, committor double, flux double, importance double, kind string")
