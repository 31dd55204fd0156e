"""Medoids and spread-out rows in many tasks against plain numpy."""

import math

import numpy as np
import pytest

from framewright.operators import representatives as P


def sample(kind, seed, n, d):
    rng = np.random.default_rng(seed)
    if kind == "ball":
        return rng.normal(size=(n, d))
    if kind == "line":
        return np.outer(rng.normal(size=n) ** 3, rng.normal(size=d))
    if kind == "clusters":
        return rng.normal(size=(3, d))[rng.choice(3, n, p=[0.8, 0.1, 0.1])] * 4 + rng.normal(size=(n, d)) / 5
    x = np.round(rng.normal(size=(n, d)) * 1.5)
    x[rng.random(n) < 0.4] = x[0]
    return x


def table(spark, x, state, weight=None):
    rows = [(i, int(s), v.tolist(), float(w)) for i, (v, s, w) in enumerate(zip(x, state, np.ones(len(x)) if weight is None else weight, strict=True))]
    return spark.createDataFrame(rows, "id long, state int, x array<double>, w double").repartition(3)


def plain_medoids(x, state, w, k):
    out = []
    for s in sorted(set(state.tolist())):
        own = np.flatnonzero(state == s)
        total = (np.sqrt(((x[own][:, None] - x[own][None]) ** 2).sum(2)) @ w[own]).round(9)
        out += [(s, r + 1, int(own[i]), total[i]) for r, i in enumerate(np.lexsort((own, total))[:k])]
    return out


@pytest.mark.parametrize("kind, d", [("ball", 1), ("ball", 5), ("ball", 40), ("line", 3), ("clusters", 4), ("copies", 2)])
def test_medoids_equal_all_sums(spark, kind, d):
    x = sample(kind, d, 500, d)
    state = np.random.default_rng(1).choice(3, 500, p=[0.7, 0.29, 0.01])
    w = np.random.default_rng(2).integers(0, 4, 500).astype(float) + (state == 2)
    for weight, k in ((None, 3), ("w", 1)):
        got = P.medoids(table(spark, x, state, w), "x", "state", "id", k, weight, pivots=4, chunk=64).collect()
        want = plain_medoids(x, state, w if weight else np.ones(500), k)
        assert sorted((r.state, r.rank, r.id) for r in got) == [r[:3] for r in want]
        assert np.allclose([r.score for r in sorted(got, key=lambda r: (r.state, r.rank))], [r[3] for r in want], atol=1e-8)


@pytest.mark.parametrize("kind, d, most", [("ball", 2, 0.1), ("ball", 8, 0.05), ("ball", 64, 0.01), ("line", 3, 0.3), ("clusters", 4, 0.5)])
def test_bounds_hold_and_give_rows_up(kind, d, most):
    x = sample(kind, 5, 900, d)
    total, mean = 900.0, x.mean(0)
    u = x - mean
    size = (u**2).sum(1)
    moments = np.concatenate([[size.mean(), (size**2).mean()], (size[:, None] * u).mean(0), (u.T @ u / 900).ravel()])
    sums = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).sum(1)
    pivots = np.concatenate([np.arange(32), np.argsort(size)[:32]])
    near = np.sqrt(((x[:, None] - x[pivots][None]) ** 2).sum(2)).argmin(1)
    cells = np.array([[(near == k).sum(), *x[near == k].sum(0)] for k in range(64)], float)
    low, high = P.sum_bounds(x, total, mean, moments, x[pivots], sums[pivots], cells)
    assert (low <= sums).all() and (sums <= high).all()
    assert (low <= high.min()).mean() <= most


def test_medoids_of_awkward_rows(spark):
    rows = [(1, 0, [1.0]), (2, 0, None), (3, None, [4.0]), (None, 0, [5.0]), (4, 7, [2.0]), (5, 0, [1.0])]
    df = spark.createDataFrame(rows, "id long, state int, x array<double>")
    assert sorted(map(tuple, P.medoids(df, "x", "state", "id", 2).collect())) == [(0, 1, 1, 0.0), (0, 2, 5, 0.0), (7, 1, 4, 0.0)]
    assert sorted(map(tuple, P.farthest_points(df, "x", "state", "id", 3).collect())) == [(0, 1, 1, 0.0), (7, 1, 4, 0.0)]
    none = df.limit(0)
    assert P.medoids(none, "x", "state", "id").collect() == [] and P.farthest_points(none, "x", "state", "id").collect() == []
    named = spark.createDataFrame([("b", "s", [0.0]), ("a", "s", [1.0]), ("c", "s", [5.0])], "key string, s string, x array<double>")
    assert [tuple(r) for r in P.medoids(named, "x", "s", "key").collect()] == [("s", 1, "a", 5.0)]
    assert [tuple(r) for r in P.farthest_points(named, "x", "s", "key", 3).orderBy("rank").collect()] == [("s", 1, "a", 0.0), ("s", 2, "c", 4.0), ("s", 3, "b", 1.0)]


@pytest.mark.parametrize("kind, d", [("ball", 3), ("copies", 2), ("line", 2)])
def test_farthest_points_equal_greedy(spark, kind, d):
    x = sample(kind, 9, 300, d)
    state = np.random.default_rng(3).choice(2, 300, p=[0.9, 0.1])
    got = sorted((r.state, r.rank, r.id, r.score) for r in P.farthest_points(table(spark, x, state), "x", "state", "id", 7, cut_every=3).collect())
    want = []
    for s in (0, 1):
        own = np.flatnonzero(state == s)
        m = x[own]
        taken = [int(((m - m.mean(0)) ** 2).sum(1).round(9).argmin())]
        want.append((s, 1, int(own[taken[0]]), 0.0))
        for rank in range(2, 8):
            gap = np.sqrt(((m[:, None] - m[taken][None]) ** 2).sum(2)).min(1)
            i = int(gap.round(9).argmax())
            if gap[i] <= 0:
                break
            taken.append(i)
            want.append((s, rank, int(own[i]), float(gap[i])))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(math.isclose(g[3], w[3], abs_tol=1e-12) for g, w in zip(got, want, strict=True))
    assert "ApplyInPandas" not in P.farthest_points(table(spark, x, state), "x", "state", "id", 2)._jdf.queryExecution().toString()


def test_distance_sums_hold_no_cube():
    """A block's sums equal the plain ones bit for bit, in memory of a few rows' distances and one candidate's differences."""
    import tracemalloc

    import numpy as np

    from framewright.operators.representatives import distance_sums

    rng = np.random.default_rng(2)
    c, m, w = rng.normal(size=(70, 64)), rng.normal(size=(1500, 64)), rng.random(1500)
    want = np.concatenate([np.sqrt(((c[i : i + 32, None] - m[None]) ** 2).sum(2)) @ w for i in range(0, 70, 32)])
    tracemalloc.start()
    got = distance_sums(c, m, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and peak < 3 * m.nbytes
