"""Reversible posterior, effective counts and the exact bootstrap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import msm as M
from framewright.operators import posterior as P
from framewright.plans.catalogue import QUERIES


def test_pairings_meet_once():
    for n in (2, 3, 4, 7, 8):
        met = [(min(a, b), max(a, b)) for k, m in P.pairings(n) for a, b in zip(k.tolist(), m.tolist(), strict=True)]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert all(len({*k.tolist(), *m.tolist()}) == 2 * len(k) for k, m in P.pairings(n))


@pytest.mark.parametrize("counts", [[[30.0, 6.0], [4.0, 12.0]], [[0.0, 5.0], [2.5, 9.0]], [[3.0, 0.8], [0.7, 1.5]]])
def test_two_states_have_the_analytic_posterior(counts):
    """Every two-state chain is reversible: p_12 is Beta(c_12, c_11) and p_21 is Beta(c_21, c_22)."""
    c = np.array(counts)
    x = P.reversible_draws(c, 6000, np.random.default_rng(3), 200, 4)
    p = x / x.sum(2, keepdims=True)
    rng = np.random.default_rng(4)
    for got, (a, b) in ((p[:, 0, 1], (c[0, 1], c[0, 0])), (p[:, 1, 0], (c[1, 0], c[1, 1]))):
        want = rng.beta(a, b, 200_000) if b else np.ones(10)
        for q in (0.025, 0.25, 0.5, 0.75, 0.975):
            assert abs((got <= np.quantile(want, q)).mean() - q) < 0.03 or not b
    if c[0, 0]:
        lag = -1 / np.log(np.clip(1 - p[:, 0, 1] - p[:, 1, 0], 1e-9, None))
        both = 1 - rng.beta(c[0, 1], c[0, 0], 200_000) - rng.beta(c[1, 0], c[1, 1], 200_000)
        want = -1 / np.log(np.clip(both, 1e-9, None))
        assert abs((lag <= np.median(want)).mean() - 0.5) < 0.03


def test_draws_are_in_detailed_balance_and_centred():
    rng = np.random.default_rng(1)
    pi = rng.dirichlet(np.ones(9) * 3)
    a = rng.random((9, 9)) ** 2
    x = np.minimum.outer(pi, pi) * (a + a.T) * 0.05
    np.fill_diagonal(x, pi - (x.sum(1) - np.diag(x)))
    p = x / x.sum(1, keepdims=True)
    c = np.array([rng.multinomial(40_000, row) for row in p], float) * pi[:, None]
    c[0, 8] = c[8, 0] = 0.0
    draws = P.reversible_draws(c, 200, rng)
    assert np.abs(draws - draws.transpose(0, 2, 1)).max() < 1e-10 and np.allclose(draws.sum((1, 2)), 1) and (draws[:, 0, 8] == 0).all()
    q = draws / draws.sum(2, keepdims=True)
    assert np.allclose(q.sum(2), 1) and np.abs(q.mean(0) - p)[:8, :8].max() < 0.05 and q.std(0).max() > 1e-4
    wide = P.reversible_draws(c / 50, 200, rng)
    assert (wide / wide.sum(2, keepdims=True)).std(0).mean() > 3 * q.std(0).mean()


def test_detached_states_stay_apart(spark):
    c = {2: np.array([[9.0, 3.0, 0.0], [2.0, 5.0, 1.0], [0.0, 0.0, 4.0]]), 3: np.eye(3), 4: np.zeros((0, 0))}
    rows = P.posterior_draws(spark, c, samples=7, chains=3).collect()
    assert sorted((r.lag, r.draw) for r in rows) == [(2, i) for i in range(7)] and all(r.members == [0, 1] and r.imbalance < 1e-10 and len(r.eigenvalues) == 1 for r in rows)
    names = {r.state for r in P.population_intervals(P.posterior_draws(spark, c, samples=5, chains=1), ["a", "b", "c"]).collect()}
    assert names == {"a", "b"} and P.posterior_draws(spark, {}, samples=2).count() == 0


def chain(rng, p, n):
    out = [0]
    for u in rng.random(n - 1):
        out.append(int(np.searchsorted(np.cumsum(p[out[-1]]), u)))
    return out


def test_inefficiency_of_a_two_state_chain(spark):
    """rho(k) = lambda^k, so the inefficiency is (1 + lambda) / (1 - lambda)."""
    rng, p = np.random.default_rng(2), np.array([[0.9, 0.1], [0.2, 0.8]])
    rows = [(t, i, s) for t in range(6) for i, s in enumerate(chain(rng, p, 4000))]
    frames = spark.createDataFrame(rows, "traj_id long, frame long, state int")
    got = P.state_inefficiency(frames, 64)
    assert set(got) == {0, 1} and all(g == pytest.approx(1.7 / 0.3, rel=0.12) for g in got.values())
    free = spark.createDataFrame([(0, i, int(s)) for i, s in enumerate(rng.integers(0, 2, 5000))], "traj_id long, frame long, state int")
    assert all(1 <= g < 1.2 for g in P.state_inefficiency(free, 64).values())
    c = np.array([[10.0, 2.0], [4.0, 8.0]])
    assert np.allclose(P.effective_counts(c, [0, 1], {0: 2.0}), [[5, 1], [4, 8]])


def test_sums_between_ladder_lags():
    lags = P.lag_ladder(100)
    assert lags[:16] == list(range(1, 17)) and lags[-1] == 100 and lags == sorted(set(lags))
    line = [1 - t / 200 for t in lags]
    assert P.summed_correlation(lags, line) == pytest.approx(sum(1 - t / 200 for t in range(1, 101)))
    assert P.summed_correlation([1, 2, 3], [0.5, -0.1, 0.9]) == 0.5 and P.summed_correlation([1], [float("nan")]) == 0


def test_interval_covers_the_timescale(spark):
    rng, p = np.random.default_rng(7), np.array([[0.9, 0.1], [0.2, 0.8]])
    rows = [(t, i, s) for t in range(4) for i, s in enumerate(chain(rng, p, 2500))]
    frames = spark.createDataFrame(rows, "traj_id long, frame long, state int")
    true = -1 / math.log(0.7)
    wide, narrow = (M.bayesian_timescales(spark, frames, [1, 2], 1, effective=e).where("lag = 1").first() for e in (True, False))
    assert wide.samples == narrow.samples == 100 and wide.lo < true < wide.hi and wide.hi - wide.lo > narrow.hi - narrow.lo
    assert wide.eigen_lo < 0.7 < wide.eigen_hi and wide.rate_lo == pytest.approx(1 / wide.hi, rel=0.05)


def test_queries_take_a_hundred_samples(spark, sf_dir):
    rows = QUERIES["its_bayesian"](spark, sf_dir).collect()
    assert {(r.lag, r.k) for r in rows} == {(t, k) for t in (1, 2, 5) for k in (1, 2, 3)}
    assert all(r.samples <= 100 and r.eigen_lo <= r.eigen_median <= r.eigen_hi for r in rows) and max(r.samples for r in rows) > 50
    assert [(r.lag, r.k, r.eigen_median) for r in QUERIES["its_bayesian"](spark, sf_dir).orderBy("lag", "k").collect()] == [(r.lag, r.k, r.eigen_median) for r in sorted(rows, key=lambda r: (r.lag, r.k))]
    pops = QUERIES["posterior_populations"](spark, sf_dir).collect()
    assert len(pops) == 5 and all(0 < r.lo <= r.median <= r.hi < 1 for r in pops)
    assert all(r.inefficiency >= 1 for r in QUERIES["state_inefficiency"](spark, sf_dir).collect())


# Bootstrap


@pytest.mark.parametrize("n, leaf", [(1, 1024), (7, 1024), (40, 1), (300, 8)])
def test_every_sample_has_n_members(spark, n, leaf):
    from framewright.operators import tpt as T

    frames = spark.range(2 * n).select((F.col("id") % n).alias("traj_id"))
    one = {r.traj_id: r.times for r in T.resampled(frames, 150, 5, leaf).collect()}
    times = np.array([one[i] for i in range(n)])
    assert times.shape == (n, 150) and (times.sum(0) == n).all() and times.min() >= 0
    again = {r.traj_id: r.times for r in T.resampled(frames.repartition(7), 150, 5, leaf).collect()}
    assert again == one
    if n >= 40:
        assert times.mean() == 1 and abs(times.var() - (1 - 1 / n)) < 0.1 and abs((times == 0).mean() - (1 - 1 / n) ** n) < 0.02
        assert {r.traj_id: r.times for r in T.resampled(frames, 150, 6, leaf).collect()} != one


def test_bootstrap_counts_are_weighted_sums(spark):
    from framewright.operators import tpt as T

    rng = np.random.default_rng(5)
    rows = [(t, i, int(s)) for t in range(9) for i, s in enumerate(rng.integers(0, 3, 20 + t))]
    frames = spark.createDataFrame(rows, "traj_id long, frame long, state int")
    times = {r.traj_id: r.times for r in T.resampled(frames, 6, 2).collect()}
    own = {}
    for t in range(9):
        s = [x for u, _, x in rows if u == t]
        for a, b in zip(s[:-2], s[2:], strict=True):
            for d in range(6):
                own[d + 1, a, b] = own.get((d + 1, a, b), 0) + times[t][d]
    assert {(r.draw, r.src, r.dst): r.n for r in T.bootstrap_counts(frames, 2, 6, 2).collect()} == {k: v for k, v in own.items() if v}


def test_bootstrap_interval_against_numpy(spark, sf_dir):
    from framewright.functions import linalg
    from framewright.operators import tpt as T
    from framewright.sources import frames as S

    f = S.event_frames(spark, sf_dir)
    per, states = {}, sorted(r.state for r in f.select("state").distinct().collect())
    for r in T.trajectory_counts(f, 5).collect():
        per.setdefault(r.traj_id, np.zeros((len(states),) * 2))[states.index(r.src), states.index(r.dst)] = r.n
    times = {r.traj_id: r.times for r in T.resampled(f, 200).collect()}
    rates = []
    for d in range(200):
        c = sum(times[t][d] * m for t, m in per.items())
        rates.append(T.analyse(linalg.row_stochastic(c + 1e-3), [0], [len(states) - 1], 1, 0.1, 5).rate)
    row = next(r for r in QUERIES["bootstrap_ci"](spark, sf_dir).collect() if r.quantity == "rate")
    assert row.mean == pytest.approx(np.mean(rates), rel=1e-6) and (row.lo, row.hi) == pytest.approx(tuple(np.percentile(rates, [2.5, 97.5])), rel=1e-6)
