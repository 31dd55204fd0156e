"""Markov models on aggregated counts: estimation, timescales, validation and choice of lag."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import linalg
from framewright.functions.constants import DIRICHLET_ALPHA, LEAST_RATE
from framewright.operators.counts import transition_counts


@dataclass
class MarkovModel:
    """Dense results over a sorted list of states."""

    states: list
    lag: int
    counts: np.ndarray
    p: np.ndarray
    pi: np.ndarray
    active: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def matrices(frames: DataFrame, lags: list[int], states: list | None = None, **how) -> tuple[list, dict[int, np.ndarray]]:
    """Count matrices of all lags from one scan; the driver gets states squared cells a lag."""
    rows = transition_counts(frames, lags, **how).collect()
    if states is None:
        states = sorted({r.src for r in rows} | {r.dst for r in rows})
    at = {s: i for i, s in enumerate(states)}
    out = {t: np.zeros((len(states), len(states))) for t in lags}
    for r in rows:
        out[r.tau][at[r.src], at[r.dst]] += r.n
    return states, out


def fitted(states: list, counts: np.ndarray, lag: int, alpha: float = DIRICHLET_ALPHA) -> MarkovModel:
    """Non-reversible estimate with a prior on the active block; inactive states stay put and have no weight."""
    active = counts.sum(0) + counts.sum(1) > 1e-12
    p, pi = np.eye(len(states)), np.zeros(len(states))
    if active.any():
        block = linalg.row_stochastic(counts[np.ix_(active, active)] + alpha)
        p[np.ix_(active, active)] = block
        pi[active] = linalg.stationary(block)
    return MarkovModel(states, lag, counts, p, pi, active)


def markov_model(frames: DataFrame, lag: int, states: list | None = None, alpha: float = DIRICHLET_ALPHA, **how) -> MarkovModel:
    states, made = matrices(frames, [lag], states, **how)
    return fitted(states, made[lag], lag, alpha)


def timescale_rows(counts: dict[int, np.ndarray], k: int) -> list[tuple]:
    """(lag, k, eigenvalue, timescale, rate) from symmetrised counts; None where there is none."""
    out = []
    for lag, c in sorted(counts.items()):
        own = c[np.ix_(c.sum(1) + c.sum(0) > 0, c.sum(1) + c.sum(0) > 0)]
        own = own + own.T
        root = np.sqrt(own.sum(1))
        values = np.sort(np.linalg.eigvalsh(own / np.outer(root, root)))[::-1][1 : k + 1] if len(own) else np.zeros(0)
        t = linalg.timescales(values, lag)
        for i in range(k):
            v, s = (float(values[i]), float(t[i])) if i < len(values) else (None, float("nan"))
            ok = s == s and s > 0
            out.append((lag, i + 1, v, s if ok else None, max(1 / s, LEAST_RATE) if ok else None))
    return out


def implied_timescales(spark: SparkSession, frames: DataFrame, lags: list[int], k: int = 3, **how) -> DataFrame:
    """Implied timescales of all lags, counted in one scan."""
    _, made = matrices(frames, lags, **how)
    return spark.createDataFrame(timescale_rows(made, k), "lag int, k int, eigenvalue double, timescale double, rate double")


def dirichlet_sample(counts: np.ndarray, rng: np.random.Generator, alpha: float = DIRICHLET_ALPHA) -> np.ndarray:
    """A transition matrix with independent Dirichlet rows."""
    g = rng.standard_gamma(counts + alpha)
    return g / g.sum(1, keepdims=True)


def bayesian_timescales(spark: SparkSession, frames: DataFrame, lags: list[int], k: int = 3, samples: int = 100, ci: float = 0.95, seed: int = 0, effective: bool = True, chains: int = 5, **how) -> DataFrame:
    """Medians and intervals of timescales, eigenvalues and rates over ``samples`` reversible models a lag.

    Counts are effective ones unless ``effective`` is false; lags are counted in one scan, each chain of a lag is a task.
    """
    from framewright.operators import posterior

    states, made = matrices(frames, lags, **how)
    if effective:
        weight = posterior.state_inefficiency(frames)
        made = {t: posterior.effective_counts(c, states, weight) for t, c in made.items()}
    return posterior.timescale_intervals(posterior.posterior_draws(spark, made, k, samples, chains, seed), ci)


def plateau(lags: list[int], values: list[float], least: int, epsilon: float) -> tuple[int, int] | None:
    """Longest run of at least ``least`` lags whose range is within epsilon of its mean; a bad value breaks it."""
    best = None
    for i in range(len(lags)):
        for j in range(i + least - 1, len(lags)):
            own = np.array(values[i : j + 1], "f8")
            if np.isfinite(own).all() and own.max() - own.min() <= epsilon * own.mean() and (best is None or j - i > best[1] - best[0]):
                best = (i, j)
    return None if best is None else (lags[best[0]], lags[best[1]])


def lag_from_timescales(lags: list[int], values: list[float], start: int = 3, threshold: float = 0.15) -> int:
    """First lag whose relative change is under the threshold and whose next is under 1.5 times it.

    Else the lag of the largest timescale in the latter half, else the median lag, else 10.
    """
    if not lags:
        return 10
    change = [np.inf] + [abs(b - a) / a if a and np.isfinite(a) and np.isfinite(b) else np.inf for a, b in zip(values[:-1], values[1:], strict=True)]
    for i in range(max(1, start), len(lags)):
        if change[i] < threshold and (i + 1 == len(lags) or change[i + 1] < 1.5 * threshold):
            return lags[i]
    late = [(values[i], -i) for i in range(len(lags) // 2, len(lags)) if np.isfinite(values[i])]
    return lags[-max(late)[1]] if late else lags[len(lags) // 2]


def ck_errors(counts: dict[int, np.ndarray], lag: int, factors: tuple[int, ...] = (2, 3, 4, 5), least: int = 50) -> dict[int, float]:
    """Mean squared difference of P(lag)^f and P(f lag) over rows with ``least`` counts at both lags; NaN without any."""
    base = linalg.row_stochastic(counts[lag])
    out = {}
    for f in factors:
        c = counts[f * lag]
        rows = (c.sum(1) >= least) & (counts[lag].sum(1) >= least)
        gap = np.linalg.matrix_power(base, f)[rows] - linalg.row_stochastic(c)[rows]
        out[f] = float((gap**2).mean()) if rows.any() else float("nan")
    return out


def ck_decision(errors: dict[int, float], rows: dict[int, np.ndarray], cap: float = 0.15, share: float = 0.8) -> tuple[bool, dict[int, float]]:
    """Pass if a share of the factors has a root mean square error under min(cap, 3 times the sampling noise)."""
    limit = {f: min(cap, 3 / np.sqrt(max(float(np.median(n)) if len(n) else 0.0, 1.0))) for f, n in rows.items()}
    good = [np.sqrt(e) <= limit[f] for f, e in errors.items() if e == e]
    return bool(good) and sum(good) / len(good) >= share, limit


def ck_test(spark: SparkSession, frames: DataFrame, lag: int, factors: tuple[int, ...] = (2, 3, 4, 5), least: int = 50, macro: int | None = None) -> DataFrame:
    """(factor, mse) of the micro model, or of macrostates if there is a number of them; all lags in one scan."""
    states, made = matrices(frames, [lag, *(f * lag for f in factors)])
    if macro and (of := linalg.macrostates(fitted(states, made[lag], lag).p, macro)) is not None:
        u = np.eye(macro)[of]
        made = {t: u.T @ c @ u for t, c in made.items()}
    return spark.createDataFrame([(f, None if e != e else e) for f, e in ck_errors(made, lag, factors, least).items()], "factor int, mse double")


def ck_choice(spark: SparkSession, frames: DataFrame, lag: int, macro: int, factors: tuple[int, ...] = (2, 3, 4, 5), least: int = 50, gap: float = 0.01, top: int = 50) -> DataFrame:
    """(mode, factor, mse): the test on ``macro`` macrostates where that can be done, else on the ``top`` most visited states.

    Macrostates need more states than that, an eigenvalue gap of ``gap`` or more behind them, and ``least`` transitions
    out of each. Otherwise frames of rarer states are deleted and the rest renumbered, as in a smaller discretisation.
    """
    lags = [lag, *(f * lag for f in factors)]
    states, made = matrices(frames, lags)
    p = linalg.row_stochastic(made[lag])
    values = np.sort(np.linalg.eigvals(p).real)[::-1] if len(states) else np.zeros(0)
    of = linalg.macrostates(fitted(states, made[lag], lag).p, macro) if len(states) > macro and values[macro - 1] - values[macro] >= gap else None
    mode = "micro"
    if of is not None:
        u = np.eye(int(of.max()) + 1)[of]
        lumped = {t: u.T @ c @ u for t, c in made.items()}
        if (lumped[lag].sum(1) >= least).all():
            mode, made = "macro", lumped
    if mode == "micro" and len(states) > top:
        total = made[lag].sum(0) + made[lag].sum(1)
        kept = [states[i] for i in np.argsort(-total, kind="stable")[:top]]
        made = matrices(frames.where(F.col("state").isin(kept)), lags, sorted(kept), gap_policy="compact")[1]
    rows = [(mode, f, None if e != e else e) for f, e in ck_errors(made, lag, factors, least).items()]
    return spark.createDataFrame(rows, "mode string, factor int, mse double")


def spectral_gap(p: np.ndarray, least: int = 3, most: int = 6) -> int:
    """Number of macrostates before the largest gap of the eigenvalues' sizes, within bounds."""
    size = np.abs(linalg.sorted_eigenvalues(p))
    gaps = [(size[k - 1] - size[k], -k) for k in range(least, min(most, len(size) - 1) + 1)]
    return -max(gaps)[1] if gaps else min(least, len(size))


def variance_cut(values: np.ndarray, share: float = 0.9) -> int:
    """Least k whose squared eigenvalues make up ``share`` of all."""
    run = np.cumsum(np.abs(values) ** 2) / (np.abs(values) ** 2).sum()
    return int(np.argmax(run >= share - 1e-12)) + 1


def select_lag(spark: SparkSession, frames: DataFrame, lags: list[int], horizons: tuple[int, ...] = (2, 3), ck_threshold: float = 0.15, coverage: float = 0.98, least_median: int = 100, most_diagonal: float = 0.6) -> tuple[int, DataFrame]:
    """Least lag that passes the sanity checks and the Chapman-Kolmogorov bound, else that of the least error.

    One row a lag: coverage of the largest weak component, median count, diagonal mass, error, passes.
    If no lag can be judged, the least candidate that the trajectories support is taken.
    """
    states, made = matrices(frames, sorted({t * h for t in lags for h in (1, *horizons)}))
    rows = []
    for t in sorted(lags):
        c = made[t]
        if c.sum() == 0:
            continue
        parts = linalg.weak_components(c > 0)
        total = c.sum(0) + c.sum(1)
        p = linalg.row_stochastic(c)
        e = [v for v in ck_errors(made, t, horizons, 1).values() if v == v]
        error = float(np.sqrt(np.mean(e))) if e else float("inf")
        share, median, diagonal = len(parts[0]) / len(states), float(np.median(total[total > 0])), float(np.diag(p).mean())
        good = share >= coverage and median >= least_median and diagonal <= most_diagonal
        rows.append((t, share, median, diagonal, error, good, bool(good and error <= ck_threshold)))
    table = spark.createDataFrame(rows, "lag int, coverage double, median_count double, diag_mass double, ck_error double, sane boolean, passes boolean")
    passing = [r[0] for r in rows if r[-1]]
    if passing:
        return passing[0], table
    return (min(rows, key=lambda r: (r[4], r[0]))[0] if rows else min(lags)), table


def power_iteration(matrix: DataFrame, rounds: int) -> DataFrame:
    """(state, pi) after fixed rounds of pi P from the uniform distribution; joins only, for oracle parity."""
    states = matrix.select(F.explode(F.array("src", "dst")).alias("state")).distinct()
    n = states.count()
    pi = states.withColumn("pi", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        pi = matrix.join(pi.withColumnRenamed("state", "src"), "src").groupBy(F.col("dst").alias("state")).agg(F.sum(F.col("pi") * F.col("p")).alias("pi"))
    return pi


def matrix_power(matrix: DataFrame, k: int) -> DataFrame:
    """(src, dst, p) of the k-th power, by joins of the small cell tables."""
    out = matrix.select("src", "dst", "p")
    for _ in range(k - 1):
        out = out.select("src", F.col("dst").alias("mid"), F.col("p").alias("a")).join(matrix.select(F.col("src").alias("mid"), "dst", "p"), "mid").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("p")).alias("p"))
    return out
