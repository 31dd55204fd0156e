"""Posterior of reversible transition matrices: effective counts from frames, chains in tasks, intervals over draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import linalg
from framewright.functions.constants import LEAST_RATE
from framewright.operators.counts import transition_counts


def lag_ladder(most: int, dense: int = 16, ratio: float = 1.25) -> list[int]:
    """Every lag up to ``dense``, then growing by ``ratio`` up to ``most``."""
    lags = list(range(1, min(dense, most) + 1))
    while lags[-1] < most:
        lags.append(min(most, max(lags[-1] + 1, int(lags[-1] * ratio))))
    return lags


def summed_correlation(lags: list[int], rho: list[float]) -> float:
    """Sum of a correlation over all lags up to its first non-positive value, linear between the lags given."""
    total, last, before = 0.0, 1.0, 0
    for lag, r in zip(lags, rho, strict=True):
        if not r > 0:
            break
        total += (lag - before) * (last + r) / 2 + (r - last) / 2
        last, before = r, lag
    return total


def state_inefficiency(frames: DataFrame, most: int = 256) -> dict:
    """Statistical inefficiency 1 + 2 sum rho(k) of each state's indicator series, at least 1.

    rho is the correlation of being in the state at both ends of a pair of frames k apart; all lags of a ladder up
    to ``most`` are counted in one scan, and the driver gets one row a lag and state. Pairs with a null state at
    an end count for nothing. A state that is always or never visited has 1.
    """
    lags = lag_ladder(most)
    pairs = transition_counts(frames, lags)
    same = (F.col("src") == F.col("dst")).cast("long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("state"), F.col("n").alias("start"), F.lit(0).cast("long").alias("stop"), (F.col("n") * same).alias("both")), F.struct(F.col("dst").alias("state"), F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"), F.lit(0).cast("long").alias("both"))))
    rows = pairs.select("tau", ends.alias("e")).select("tau", "e.*").groupBy("tau", "state").agg(*(F.sum(c).alias(c) for c in ("start", "stop", "both"))).collect()
    total: dict[int, int] = {}
    for r in rows:
        total[r.tau] = total.get(r.tau, 0) + r.start
    at = {(r.state, r.tau): r for r in rows}
    out = {}
    for state in {r.state for r in rows}:
        rho = []
        for tau in lags:
            r = at.get((state, tau))
            a, b, c = (x / total[tau] for x in (r.start, r.stop, r.both)) if r else (0.0, 0.0, 0.0)
            spread = math.sqrt(a * (1 - a) * b * (1 - b)) if 0 < a < 1 and 0 < b < 1 else 0.0
            rho.append((c - a * b) / spread if spread > 0 else 0.0)
        out[state] = max(1.0, 1 + 2 * summed_correlation(lags, rho))
    return out


def effective_counts(counts: np.ndarray, states: list, inefficiency: dict) -> np.ndarray:
    """Counts over the inefficiency of the state that they leave: as many as independent ones would weigh."""
    return counts / np.array([inefficiency.get(s, 1.0) for s in states])[:, None]


def pairings(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds in which every two of n states meet once and no state is in two pairs of a round."""
    m = n + n % 2
    ring, out = list(range(m)), []
    for _ in range(m - 1):
        pairs = [(ring[i], ring[m - 1 - i]) for i in range(m // 2) if max(ring[i], ring[m - 1 - i]) < n]
        out.append((np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def reversible_draws(counts: np.ndarray, draws: int, rng: np.random.Generator, burn: int = 100, thin: int = 10) -> np.ndarray:
    """draws x n x n symmetric joint probabilities x_ij = pi_i p_ij from the posterior of reversible matrices.

    The density of x is the likelihood of the counts over the product of the x_ij of observed pairs; pairs seen in
    neither direction stay zero. A sweep draws each diagonal from its beta distribution, and moves the log of each
    other element by a random step that is taken by Metropolis' rule, pairs without a common state together. All
    states must be connected by ``counts``.
    """
    n = len(counts)
    both = counts + counts.T
    own, left = np.diag(counts).copy(), counts.sum(1)
    x = both / both.sum()
    rounds = pairings(n)
    out = np.empty((draws, n, n))
    for sweep in range(burn + thin * draws):
        rest = x.sum(1) - np.diag(x)
        stay = rng.beta(np.maximum(own, 1e-300), np.maximum(left - own, 1e-300))
        np.fill_diagonal(x, np.where(own > 0, rest * stay / np.maximum(1 - stay, 1e-15), 0.0))
        rows = x.sum(1)
        for k, m in rounds:
            seen = both[k, m] > 0
            k, m = k[seen], m[seen]
            old, c, ck, cm = x[k, m], both[k, m], left[k], left[m]
            rk, rm = np.maximum(rows[k] - old, 0), np.maximum(rows[m] - old, 0)
            free = (rk + rm > 1e-300) & (ck + cm > c)
            k, m, old, c, ck, cm, rk, rm = (v[free] for v in (k, m, old, c, ck, cm, rk, rm))
            if not len(k):
                continue
            # The step is as wide as the conditional is at its mode, which does not depend on the old value.
            a, b = ck + cm - c, c * (rk + rm) - ck * rm - cm * rk
            mode = (b + np.sqrt(np.maximum(b * b + 4 * a * c * rk * rm, 0))) / (2 * a)
            mode = np.maximum(mode, 1e-300)
            bend = ck * mode * rk / (mode + rk) ** 2 + cm * mode * rm / (mode + rm) ** 2
            step = np.exp(np.clip(2.4 / np.sqrt(np.maximum(bend, 1e-6)) * rng.standard_normal(len(k)), -30, 30))
            new = old * step
            gain = c * np.log(step) - ck * np.log((new + rk) / (old + rk)) - cm * np.log((new + rm) / (old + rm))
            take = np.log(rng.random(len(k))) < gain
            k, m, old, new = k[take], m[take], old[take], new[take]
            x[k, m] = x[m, k] = new
            rows[k] += new - old
            rows[m] += new - old
        x /= x.sum()
        if sweep >= burn and (sweep - burn) % thin == thin - 1:
            out[(sweep - burn) // thin] = x
    return out


def as_model(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrix and stationary distribution of joint probabilities."""
    pi = x.sum(1)
    return x / pi[:, None], pi / pi.sum()


def posterior_draws(spark: SparkSession, counts: dict[int, np.ndarray], k: int = 3, samples: int = 100, chains: int = 5, seed: int = 0, burn: int = 100, thin: int = 10) -> DataFrame:
    """(lag, draw, eigenvalues, timescales, pi, members, imbalance): ``samples`` reversible models of each lag's counts.

    Each of the ``chains`` of a lag is a task with its own random numbers. Only the largest set of mutually
    reachable states takes part (``members``); ``imbalance`` is the largest |pi_i p_ij - pi_j p_ji|. Where a lag has no
    two such states there is no row.
    """
    if chains < 1 or samples < 1:
        raise ValueError("at least one chain and one sample are needed")
    rows = []
    for lag, c in counts.items():
        part = linalg.strong_components(c > 0)[0] if len(c) else []
        if len(part) > 1:
            rows += [(int(lag), a, b, float(c[i, j])) for a, i in enumerate(part) for b, j in enumerate(part) if c[i, j] > 0]
    members = {int(lag): [int(i) for i in linalg.strong_components(c > 0)[0]] for lag, c in counts.items() if len(c)}
    share = [samples // chains + (i < samples % chains) for i in range(chains)]
    first = np.concatenate([[0], np.cumsum(share)]).tolist()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lag, chain = int(pdf["lag"].iloc[0]), int(pdf["chain"].iloc[0])
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        c = np.zeros((n, n))
        c[pdf["i"], pdf["j"]] = pdf["n"]
        out = []
        for d, x in enumerate(reversible_draws(c, share[chain], np.random.default_rng([seed, lag, chain]), burn, thin)):
            p, pi = as_model(x)
            root = np.sqrt(pi)
            values = np.sort(np.linalg.eigvalsh(root[:, None] * p / root[None, :]))[::-1][1 : k + 1]
            flow = pi[:, None] * p
            out.append((lag, first[chain] + d, values.tolist(), [None if t != t else float(t) for t in linalg.timescales(values, lag)], pi.tolist(), members[lag], float(np.abs(flow - flow.T).max())))
        return pd.DataFrame(out, columns=["lag", "draw", "eigenvalues", "timescales", "pi", "members", "imbalance"])

    schema = "lag int, draw int, eigenvalues array<double>, timescales array<double>, pi array<double>, members array<int>, imbalance double"
    if not rows:
        return spark.createDataFrame([], schema)
    cells = spark.createDataFrame(rows, "lag int, i int, j int, n double")
    dealt = cells.withColumn("chain", F.explode(F.array(*[F.lit(i) for i in range(chains) if share[i]])))
    return dealt.groupBy("lag", "chain").applyInPandas(run, schema)


def timescale_intervals(draws: DataFrame, ci: float = 0.95) -> DataFrame:
    """(lag, k, lo, median, hi, eigen_lo, eigen_median, eigen_hi, rate_lo, rate_median, rate_hi, samples) over posterior draws.

    An eigenvalue that is not positive has no timescale; ``samples`` are the draws with one.
    """
    tail = (1 - ci) / 2
    long = draws.select("lag", F.posexplode(F.arrays_zip("eigenvalues", "timescales")).alias("k", "v")).select("lag", (F.col("k") + 1).alias("k"), F.col("v.eigenvalues").alias("e"), F.col("v.timescales").alias("t"))
    long = long.withColumn("r", F.when(F.col("t").isNotNull(), F.greatest(1 / F.col("t"), F.lit(LEAST_RATE))))
    three = lambda c, name: [F.percentile(c, q).alias(f"{name}{s}") for q, s in ((tail, "lo"), (0.5, "median"), (1 - tail, "hi"))]
    return long.groupBy("lag", "k").agg(*three("t", ""), *three("e", "eigen_"), *three("r", "rate_"), F.count("t").cast("int").alias("samples"))


def population_intervals(draws: DataFrame, states: list, ci: float = 0.95) -> DataFrame:
    """(lag, state, lo, median, hi) of the stationary distribution over posterior draws."""
    tail = (1 - ci) / 2
    names = F.array(*[F.lit(str(s)) for s in states])
    long = draws.select("lag", F.explode(F.arrays_zip("pi", "members")).alias("v")).select("lag", names[F.col("v.members")].alias("state"), F.col("v.pi").alias("pi"))
    return long.groupBy("lag", "state").agg(*[F.percentile("pi", q).alias(c) for q, c in ((tail, "lo"), (0.5, "median"), (1 - tail, "hi"))])
