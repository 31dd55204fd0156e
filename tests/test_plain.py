"""Queries that SQL does not express, against plain numpy on the same tables; helpers that no query runs."""

import math
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import linalg as L
from framewright.functions import scalars as X
from framewright.operators import clustering as K
from framewright.operators import histograms as H
from framewright.operators import msm as M
from framewright.operators import reduction as R
from framewright.operators import representatives as P
from framewright.operators import tpt as T
from framewright.operators import workflow as W
from framewright.plans.catalogue import QUERIES
from framewright.sources import frames as S
from framewright.streaming import detectors as D

ALPHA = 1e-3


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.fixture(scope="module")
def events(con):
    """traj_id -> (states, values) in frame order."""
    out = defaultdict(lambda: ([], []))
    for t, s, v in con.execute("SELECT user_id, event_type, value FROM events ORDER BY user_id, ts, event_id").fetchall():
        out[t][0].append(s)
        out[t][1].append(v)
    return dict(out)


@pytest.fixture(scope="module")
def vectors(con):
    rows = con.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], "f8")


def counted(events, lag, of=lambda s, v: s):
    states = sorted({s for x in events.values() for s in of(*x)})
    c = np.zeros((len(states), len(states)))
    for x in events.values():
        s = of(*x)
        for a, b in zip(s[:-lag], s[lag:], strict=True):
            c[states.index(a), states.index(b)] += 1
    return states, c


def stochastic(c):
    return c / c.sum(1, keepdims=True)


def invariant(p):
    values, vectors = np.linalg.eig(p.T)
    v = vectors[:, np.argmax(values.real)].real
    return v / v.sum()


def run(spark, name, sf_dir):
    return QUERIES[name](spark, sf_dir).collect()


def same_line(a, b):
    """Equal up to sign and scale."""
    return abs(a @ b) / math.sqrt((a @ a) * (b @ b)) > 1 - 1e-8


# Reductions


def projected(rows, key, names):
    rows = sorted(rows, key=lambda r: r[key])
    return np.array([[r[n] for n in names] for r in rows])


def test_pca(spark, sf_dir, vectors):
    got = projected(run(spark, "pca", sf_dir), "vec_id", ["ic0", "ic1"])
    z = (vectors[2] - vectors[2].mean(0)) / vectors[2].std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert all(same_line(got[:, k], u[:, k]) and math.isclose(np.linalg.norm(got[:, k]), s[k], rel_tol=1e-8) for k in (0, 1))


def lagged(vectors):
    _, label, x = vectors
    pairs = [(x[label == t][:-1], x[label == t][1:]) for t in np.unique(label)]
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def test_tica(spark, sf_dir, vectors):
    a, b = lagged(vectors)
    mean = (a.mean(0) + b.mean(0)) / 2
    a, b = a - mean, b - mean
    c0, ct = (a.T @ a + b.T @ b) / (2 * len(a)), (a.T @ b + b.T @ a) / (2 * len(a))
    values, w = np.linalg.eig(np.linalg.solve(c0, ct))
    top = np.argsort(-values.real)[:2]
    got = projected(run(spark, "tica", sf_dir), "frame", ["ic0", "ic1"])
    want = (vectors[2] - mean) @ w[:, top].real
    assert all(same_line(got[:, k], want[:, k]) for k in (0, 1)) and np.allclose((got**2).mean(0), (((vectors[2] - mean) @ (w[:, top].real / np.sqrt(np.diag(w[:, top].real.T @ c0 @ w[:, top].real)))) ** 2).mean(0))


def test_vamp_and_its_score(spark, sf_dir, vectors):
    a, b = lagged(vectors)
    mean = a.mean(0)
    a, b = a - mean, b - b.mean(0)
    caa, cab, cbb = a.T @ a / len(a), a.T @ b / len(a), b.T @ b / len(a)
    values, w = np.linalg.eig(np.linalg.solve(caa, cab) @ np.linalg.solve(cbb, cab.T))
    top = np.argsort(-values.real)[:2]
    got = projected(run(spark, "vamp", sf_dir), "frame", ["ic0", "ic1"])
    want = (vectors[2] - mean) @ w[:, top].real
    assert all(same_line(got[:, k], want[:, k]) for k in (0, 1))
    ridge = 1e-6 * np.eye(64)
    score = np.trace(np.linalg.inv(caa + ridge) @ cab @ np.linalg.inv(cbb + ridge) @ cab.T)
    assert math.isclose(run(spark, "vamp2_score", sf_dir)[0].score, score, rel_tol=1e-6)


def test_whitening(spark, sf_dir, vectors):
    got = projected(run(spark, "whiten", sf_dir), "vec_id", [f"w{i}" for i in range(64)])
    assert np.allclose(got.mean(0), 0, atol=1e-9) and np.allclose(got.T @ got / len(got), np.eye(64), atol=1e-6)
    x = vectors[2] - vectors[2].mean(0)
    assert np.allclose(np.tril(np.linalg.lstsq(got, x, rcond=None)[0].T), np.linalg.lstsq(got, x, rcond=None)[0].T, atol=1e-8)


def test_canonical_correlations(spark, sf_dir, vectors):
    x = vectors[2] - vectors[2].mean(0)
    qa, qb = (np.linalg.qr(x[:, s])[0] for s in (slice(0, 32), slice(32, 64)))
    want = np.linalg.svd(qa.T @ qb, compute_uv=False)
    assert np.allclose([r.rho for r in sorted(run(spark, "canonical_correlations", sf_dir), key=lambda r: r.k)], want, atol=1e-5)


# Markov models


def test_timescales(spark, sf_dir, events):
    for lag in (1, 2, 5, 10):
        _, c = counted(events, lag)
        values = np.sort(np.linalg.eigvals(stochastic(c + c.T)).real)[::-1][1:4]
        got = sorted((r for r in run(spark, "its", sf_dir) if r.lag == lag), key=lambda r: r.k)
        assert np.allclose([r.eigenvalue for r in got], values, atol=1e-10)
        for r, v in zip(got, values, strict=True):
            assert r.timescale is None if v <= 0 else math.isclose(r.timescale, -lag / math.log(v), rel_tol=1e-9)


def test_sampled_timescales(spark, sf_dir):
    rows = run(spark, "its_bayesian", sf_dir)
    assert {(r.lag, r.k) for r in rows} == {(t, k) for t in (1, 2, 5) for k in (1, 2, 3)}
    assert all(r.lo <= r.median <= r.hi for r in rows if r.median == r.median)
    rng, c = np.random.default_rng(0), np.array([[3.0, 7.0], [1.0, 0.0]])
    draws = np.array([M.dirichlet_sample(c, rng) for _ in range(20_000)])
    want = (c + ALPHA) / (c + ALPHA).sum(1, keepdims=True)
    assert np.allclose(draws.sum(2), 1) and np.allclose(draws.mean(0), want, atol=0.01)


def test_kinetic_importance(spark, sf_dir, events):
    states, c = counted(events, 5)
    p = stochastic(c + ALPHA)
    values, left = np.linalg.eig(p.T)
    order = np.lexsort((values.imag, -np.abs(values)))
    values, left = values[order], left[:, order].real
    t = [-1 / math.log(abs(v)) for v in values[1:] if not (abs(v.imag) < 1e-12 and v.real <= 0)]
    k = int(np.argmax(np.array(t[:-1]) / np.array(t[1:]))) + 1 if len(t) > 1 else 1
    want = invariant(p) * ((left[:, 1 : 1 + k] / np.linalg.norm(left[:, 1 : 1 + k], axis=0)) ** 2).sum(1)
    got = {r.state: r.importance for r in run(spark, "kis", sf_dir)}
    assert np.allclose([got[s] for s in states], want, rtol=1e-6)


def every_path(net, at, sink, seen):
    if at in sink:
        yield [at]
        return
    for j in range(len(net)):
        if net[at, j] > 1e-300 and j not in seen:
            for rest in every_path(net, j, sink, seen | {j}):
                yield [at, *rest]


def test_paths_are_the_widest_left(spark, sf_dir, events):
    states, c = counted(events, 5)
    p = stochastic(c + ALPHA)
    pi, n = invariant(p), len(p)
    back = (pi[:, None] * p).T / pi[:, None]

    def committor(m, zero, one):
        a, b = np.eye(n) - m, np.zeros(n)
        for i in (zero, one):
            a[i], b[i] = np.eye(n)[i], float(i == one)
        return np.linalg.solve(a, b)

    gross = (pi * committor(back, n - 1, 0))[:, None] * p * committor(p, 0, n - 1)
    np.fill_diagonal(gross, 0)
    net = np.maximum(gross - gross.T, 0)
    total, rest = gross[0].sum() - gross[:, 0].sum(), net.copy()
    rows = sorted(run(spark, "tpt_pathways", sf_dir), key=lambda r: r.rank)
    assert rows and math.isclose(T.analyse(p, [0], [n - 1]).total, total, rel_tol=1e-9)
    for r in rows:
        width = max(min(rest[a, b] for a, b in zip(q[:-1], q[1:], strict=True)) for q in every_path(rest, 0, {n - 1}, {0}))
        path = [states.index(s) for s in r.path]
        assert path[0] == 0 and path[-1] == n - 1 and math.isclose(r.flux, width, rel_tol=1e-9)
        assert math.isclose(min(rest[a, b] for a, b in zip(path[:-1], path[1:], strict=True)), r.flux, rel_tol=1e-9) and math.isclose(r.share, r.flux / total, rel_tol=1e-9)
        for a, b in zip(path[:-1], path[1:], strict=True):
            rest[a, b] -= r.flux


def test_macrostates_and_conformations(spark, sf_dir, events):
    states, c = counted(events, 5)
    p = stochastic(c + ALPHA)
    pi = invariant(p)
    of = {r.state: r.macro for r in run(spark, "pcca", sf_dir)}
    weight = [sum(pi[states.index(s)] for s in states if of[s] == m) for m in (0, 1)]
    assert set(of) == set(states) and set(of.values()) == {0, 1} and weight[0] >= weight[1]
    flow = pi[:, None] * p
    s, u = np.linalg.eigh((flow + flow.T) / 2 / np.sqrt(np.outer(pi, pi)))
    slow = u[:, -2] / u[:, -1]  # two macrostates split the slowest function at the middle of its range
    side = slow > (slow.max() + slow.min()) / 2
    assert len({(bool(x), of[n]) for x, n in zip(side, states, strict=True)}) == 2
    rows = {r.state: r for r in run(spark, "conformations", sf_dir)}
    t = T.analyse(p, [i for i, n in enumerate(states) if of[n] == 0], [i for i, n in enumerate(states) if of[n] == 1])
    for i, n in enumerate(states):
        r = rows[n]
        assert r.macro == of[n] and r.kind == ("source", "sink")[of[n]] and r.committor == of[n]
        assert math.isclose(r.population, pi[i], rel_tol=1e-8) and math.isclose(r.flux, t.gross[i].sum() + t.gross[:, i].sum(), rel_tol=1e-8)


def test_lag_selection(spark, sf_dir, events):
    rows = {r.lag: r for r in run(spark, "lag_selection", sf_dir)}
    for lag in (1, 2, 5):
        states, c = counted(events, lag)
        total = c.sum(0) + c.sum(1)
        p = stochastic(c)
        gaps = [((np.linalg.matrix_power(p, h) - stochastic(counted(events, lag * h)[1])) ** 2).mean() for h in (2, 3)]
        r = rows[lag]
        assert r.coverage == 1.0 and math.isclose(r.median_count, np.median(total[total > 0])) and math.isclose(r.diag_mass, np.diag(p).mean())
        assert math.isclose(r.ck_error, math.sqrt(np.mean(gaps)), rel_tol=1e-9)
        assert r.sane == (r.median_count >= 100 and r.diag_mass <= 0.6) and r.passes == (r.sane and r.ck_error <= 0.15)


def test_diagnostics(spark, sf_dir, events):
    states, c = counted(events, 5)
    r = run(spark, "analysis_debug", sf_dir)[0]
    assert (r.lag, r.n_states, r.pairs, r.zero_rows, r.components, r.coverage, r.isolated) == (5, len(states), int(c.sum()), 0, 1, 1.0, [])
    assert math.isclose(r.diag_mass, np.diag(stochastic(c)).mean()) and ("TOTAL_PAIRS_LT_5000" in r.warnings) == (c.sum() < 5000)


def test_discretized_dataset(spark, sf_dir, events):
    train = {t: np.column_stack([x[1], np.mod(x[1], 50.0)]) for t, x in events.items() if t % 4}
    every = np.concatenate(list(train.values()))
    low, high = every.min(0), every.max(0)
    cell = {t: [tuple(c) for c in np.minimum(np.floor((x - low) / (high - low) * 4), 3).astype(int)] for t, x in train.items()}
    c = Counter((a, b) for s in cell.values() for a, b in zip(s[:-2], s[2:], strict=True))
    out = Counter()
    for (a, _), n in c.items():
        out[a] += n
    want = sorted(round(n / out[a], 9) for (a, _), n in c.items())
    assert sorted(round(r.p, 9) for r in run(spark, "discretized_dataset", sf_dir)) == want


def test_bootstrap(spark, sf_dir, events):
    states, c = counted(events, 5)
    t = T.analyse(stochastic(c + ALPHA), [0], [len(states) - 1], lag=5)
    rows = {r.quantity: r for r in run(spark, "bootstrap_ci", sf_dir)}
    for name, value in (("rate", t.rate), ("mfpt", t.mfpt), ("flux", t.total)):
        r = rows[name]
        assert r.lo <= r.mean <= r.hi and abs(r.mean - value) < 6 * r.std
    f = S.event_frames(spark, sf_dir)
    per = T.bootstrap_counts(f, 5, 400).groupBy("draw").agg(F.sum("n").alias("n")).collect()
    assert abs(np.mean([r.n for r in per]) / c.sum() - 1) < 0.1


def test_k_means_queries(spark, sf_dir, vectors):
    sizes = {r.state: r.n for r in run(spark, "k_means_states", sf_dir)}
    assert sum(sizes.values()) == len(vectors[0]) and set(sizes) == set(range(5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[2])], "id long, x array<double>")
    out, centres, cost = K.k_means(df, "x", 5)
    gap = ((vectors[2][:, None] - np.array(centres)[None]) ** 2).sum(2)
    assert [r.state for r in out.orderBy("id").collect()] == gap.argmin(1).tolist() and math.isclose(cost, gap.min(1).sum(), rel_tol=1e-9)
    assert math.isclose(K.inertia(df, "x", centres), cost, rel_tol=1e-9)
    rows = run(spark, "hyperparameter_ensemble", sf_dir)
    assert sorted((r.lag, r.n_clusters) for r in rows) == [(a, b) for a in (1, 2) for b in (3, 4)] and all(r.top < r.n_clusters for r in rows)
    table = run(spark, "complete_msm_analysis", sf_dir)
    assert math.isclose(sum(r.pi for r in table), 1.0) and min(r.free_energy for r in table) == 0 and len(table) == 5


def test_lloyd_and_choices(spark):
    pts = [[10.0 * k + 0.1 * i, 0.0] for k in range(4) for i in range(8)]
    df = spark.createDataFrame([(x,) for x in pts], "x array<double>")
    centres = K.lloyd(df, "x", [[1.0, 0.0], [12.0, 0.0], [19.0, 0.0], [31.0, 0.0], [500.0, 0.0]], 4)
    assert np.allclose(centres, [[0.35, 0], [10.35, 0], [20.35, 0], [30.35, 0], [500, 0]])
    assert K.select_k(df, "x", range(2, 6)) == 4 and sorted(K.as_matrix(df, "x").tolist()) == sorted(pts)


# Surfaces


def test_adaptive_surface(spark, sf_dir, con):
    price, quantity = (np.array(v) for v in zip(*con.execute("SELECT l_extendedprice, l_quantity FROM lineitem").fetchall(), strict=True))
    ranges, bins, cells = H.adaptive_bins(S.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", (16, 16))
    for c, v in (("l_extendedprice", price), ("l_quantity", quantity)):
        assert np.allclose(ranges[c], np.quantile(v, [0.01, 0.99]))
    want, _, _ = np.histogram2d(price, quantity, bins, [ranges["l_extendedprice"], ranges["l_quantity"]])
    assert np.abs(H.grid_of(cells, bins) - want).sum() <= 0.002 * want.sum()  # edges are decided by a rounding
    assert {(r.bx, r.by, r.n) for r in run(spark, "adaptive_fes", sf_dir)} == {(r.bx, r.by, r.n) for r in cells.collect()}


def test_blurs(spark):
    grid = np.zeros((9, 9))
    grid[4, 4] = 1.0
    assert np.allclose(H.adaptive_bandwidth(np.array([50.0, 200.0, 1e9, 0.0])), [1.2, 0.6, 0.4, 3.0])
    for level in (0.5, 1.0, 2.0, 3.0):
        assert np.allclose(H.adaptive_blur(grid, np.full(grid.shape, level)), L.blur(grid, level))
    half = H.adaptive_blur(grid, np.full(grid.shape, 1.5))
    assert np.allclose(half, (L.blur(grid, 1.0) + L.blur(grid, 2.0)) / 2)
    assert math.isclose(H.scott_bandwidth(64.0, 2.0, 2), 1.0) and math.isclose(H.scott_bandwidth(64.0, 2.0, 2, True), 1.0)
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert H.value_range(df, ["x"]) == {"x": (0.0, 100.0)} and H.value_range(df, ["x"], (0.1, 0.9)) == {"x": (10.0, 90.0)}


def test_periodic_density(spark):
    cells = spark.createDataFrame([(3.1, 0.0, 2.0), (0.0, -3.0, 1.0)], "x double, y double, w double")
    points = spark.createDataFrame([(-3.1, 0.1), (0.0, 3.0)], "gx double, gy double")
    got = {r.gx: r.density for r in H.kernel_density(spark, cells, points, 0.5, True).collect()}
    wrap = lambda d: (d + math.pi) % (2 * math.pi) - math.pi
    for gx, gy in ((-3.1, 0.1), (0.0, 3.0)):
        want = sum(w * math.exp(-(wrap(gx - x) ** 2 + wrap(gy - y) ** 2) / 0.5) / (2 * math.pi * 0.25) for x, y, w in ((3.1, 0.0, 2.0), (0.0, -3.0, 1.0))) / 3
        assert math.isclose(got[gx], want, rel_tol=1e-9)


def test_frames_of_empty_minima(spark):
    frames = spark.createDataFrame([(0, i, i % 3, 0) for i in range(9)], "traj_id long, frame long, bx int, by int")
    minima = spark.createDataFrame([(1, 0), (5, 5)], "bx int, by int")
    surface = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (2, 0, 1.4), (5, 5, 0.5)], "bx int, by int, free_energy double")
    assert sorted(r.frame for r in H.frames_near(frames, minima).collect()) == [1, 4, 7]
    got = sorted((r.min_bx, r.frame) for r in H.frames_near(frames, minima, surface, 1.0).collect())
    assert got == [(1, 1), (1, 4), (1, 7), *((5, f) for f in (0, 2, 3, 5, 6, 8))]
    assert sorted(r.frame for r in H.frames_near(frames, minima, most=2).collect()) == [1, 4]


# Scalars, sampling, geometry


def test_isoelectric_points(spark, sf_dir, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())

    def charge(q, ph):
        plus = 1 / (1 + 10 ** (ph - 9.69)) + sum(q.count(a) / (1 + 10 ** (ph - pk)) for a, pk in X.PK_POSITIVE.items())
        return plus - 1 / (1 + 10 ** (2.34 - ph)) - sum(q.count(a) / (1 + 10 ** (pk - ph)) for a, pk in X.PK_NEGATIVE.items())

    for r in run(spark, "isoelectric_points", sf_dir):
        if texts[r.doc_id] is None:
            assert r.pi is None or r.pi == 14.0 or 0 <= r.pi <= 14
            continue
        q = "".join(c for c in texts[r.doc_id] if c.isascii() and c.isalpha()).upper()
        assert charge(q, r.pi - 2e-4) >= 0 >= charge(q, r.pi + 2e-4)


def test_batches_and_samples(spark, sf_dir, events, con):
    rows = run(spark, "pair_batches", sf_dir)
    n = sum(max(0, len(s) - 1) for s, _ in events.values())
    assert sum(r.size for r in rows) == n and {r.batch for r in rows} == set(range(-(-n // 256))) and all(r.size == min(256, n - 256 * r.batch) for r in rows)
    value = dict(con.execute("SELECT event_id, value FROM events").fetchall())
    drawn = run(spark, "weighted_pair_sample", sf_dir)
    assert sorted(r.draw for r in drawn) == list(range(1000))
    mean = sum(v * v for v in value.values()) / sum(value.values())
    spread = math.sqrt(sum(v**3 for v in value.values()) / sum(value.values()) - mean**2)
    assert abs(np.mean([value[r.event_id] for r in drawn]) - mean) < 5 * spread / math.sqrt(1000)


def test_superposition_and_embedding(spark, sf_dir, vectors):
    ids, label, x = vectors
    pos = {(t, i): x[k, :63].reshape(21, 3) for k, (i, t) in enumerate(zip(ids.tolist(), label.tolist(), strict=True))}
    first = {t: min(i for u, i in pos if u == t) for t in set(label.tolist())}
    for r in run(spark, "superposed_frames", sf_dir):
        a, b = pos[r.traj_id, r.frame + first[r.traj_id]], pos[r.traj_id, first[r.traj_id]]
        got = np.array([list(p) for p in r.pos])
        ca, cb = a - a.mean(0), b - b.mean(0)
        assert np.allclose(got.mean(0), b.mean(0)) and np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), np.linalg.norm(a[:, None] - a[None], axis=2))
        s = np.linalg.svd(ca.T @ cb, compute_uv=False) * [1, 1, np.sign(np.linalg.det(ca.T @ cb))]
        assert math.isclose(((got - b) ** 2).sum(), (ca**2).sum() + (cb**2).sum() - 2 * s.sum(), rel_tol=1e-6, abs_tol=1e-9)
    feats = {}
    for key, p in pos.items():
        u, v, w = p[1] - p[0], p[2] - p[1], p[3] - p[2]
        m, n = np.cross(u, v), np.cross(v, w)
        dihedral = math.atan2(np.cross(m, n) @ v / np.linalg.norm(v), m @ n)
        angle = math.acos(np.clip(-(u @ v) / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))
        feats[key] = [math.sqrt(((p - p.mean(0)) ** 2).sum() / 21), np.linalg.norm(p[1] - p[0]), np.linalg.norm(p[2] - p[0]), *((math.cos(angle), math.sin(angle)) if W_PERIODIC_ANGLE else (angle,)), math.cos(dihedral), math.sin(dihedral)]
    keys = sorted(feats)
    f = np.array([feats[k] for k in keys])
    pairs = [(feats[k], feats[n]) for k, n in zip(keys[:-1], keys[1:], strict=True) if k[0] == n[0]]
    a, b = (np.array(v) for v in zip(*pairs, strict=True))
    a0, b0 = a - a.mean(0), b - b.mean(0)
    values, w = np.linalg.eig(np.linalg.solve(a0.T @ a0, a0.T @ b0) @ np.linalg.solve(b0.T @ b0, b0.T @ a0))
    want = (f - a.mean(0)) @ w[:, np.argmax(values.real)].real
    got = {(r.traj_id, r.frame): r.u0 for r in run(spark, "universal_embedding", sf_dir)}
    assert same_line(np.array([got[k] for k in keys]), want)


W_PERIODIC_ANGLE = False


# Streams


def test_drift_and_ledger(spark, sf_dir, events):
    got = {(r.traj_id, r.frame): (r.drift, r.width) for r in run(spark, "adwin_drift", sf_dir)}
    bias = {(r.traj_id, r.frame): r.bias for r in run(spark, "bias_ledger", sf_dir)}
    for t, (_, values) in events.items():
        window, hills = [], []
        for f, v in enumerate(values):
            window = [*window, v][-256:]
            cut = next((a for a in range(5, len(window) - 4) if abs(np.mean(window[:a]) - np.mean(window[a:])) > math.sqrt(0.5 * math.log(4 / 0.002) * (1 / a + 1 / (len(window) - a)))), 0)
            window = window[cut:]
            assert got[t, f] == (cut > 0, len(window))
            assert math.isclose(bias[t, f], sum(math.exp(-((v - h) ** 2) / 200) for h in hills), rel_tol=1e-9, abs_tol=1e-12)
            if f % 10 == 0:
                hills.append(v)
    assert len(got) == len(bias) == sum(len(v) for _, v in events.values())


# Helpers


def test_validation_helpers(spark):
    n = {2: np.array([100.0, 400.0]), 3: np.array([])}
    ok, limit = M.ck_decision({2: 0.01, 3: float("nan")}, n)
    assert ok and math.isclose(limit[2], min(0.15, 3 / math.sqrt(250))) and not M.ck_decision({2: 0.04, 3: 0.5}, n)[0] and not M.ck_decision({}, {})[0]
    assert M.variance_cut(np.array([3.0, 1.0, 0.0]), 0.9) == 1 and M.variance_cut(np.array([3.0, 1.0, 0.1]), 0.9) == 2 and M.variance_cut(np.ones(4), 1.0) == 4
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    R.schema_drift(["a", "b"], df, "val")
    with pytest.raises(ValueError):
        R.schema_drift(["b", "a"], df, "val")
    a, b = (spark.createDataFrame([(s,) for s in v], "state int") for v in ([1, 2], [2, 3]))
    with pytest.raises(ValueError):
        T.require_disjoint(a, b)
    T.require_disjoint(a, b.where("state = 3"))
    assert math.isclose(T.barrier([0, 1, 2], np.array([0.5, 0.1, 0.4])), math.log(5)) and T.barrier([1, 0], np.array([0.5, 0.1])) == 0
    assert X.geometric_taus(300, 3) == [1, 10, 100] and X.geometric_taus(2) == [] and X.geometric_taus(30, 1, 4) == [4]
    taus = X.geometric_taus(3000)
    assert taus == sorted(set(taus)) and taus[0] == 1 and taus[-1] == 1000 and len(taus) <= 10


def test_importance_over_draws(spark):
    rng = np.random.default_rng(5)
    rows = [(t, i, int(s)) for t in range(8) for i, s in enumerate(rng.choice(3, 200, p=[0.7, 0.2, 0.1]))]
    df = spark.createDataFrame(rows, "traj_id long, frame long, state int")
    overlap, spread = T.importance_stability(df, 1, [0, 1, 2], 20, top=3)
    assert overlap == 1.0 and spread.shape == (3,) and (spread >= 0).all()
    assert 0 <= T.importance_stability(df, 1, [0, 1, 2], 20, top=1)[0] <= 1


def test_split_diagnostics(spark):
    x = np.sin(np.arange(60) / 3)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "traj_id long, frame long, x double")
    curve, tau = W.split_diagnostics(df, "x", [1, 2, 3])
    got = {r.tau: r.rho for r in curve.collect()}
    z = x - x.mean()
    for t in (1, 2, 3):
        assert abs(got[t] - (z[:-t] @ z[t:]) / (z @ z)) < 0.1
    assert tau > 0


def test_representatives_of_flux(spark):
    df = spark.createDataFrame([(i, i % 3, [float(i)]) for i in range(12)], "id long, state int, x array<double>")
    flux = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.1)], "state int, flux double")
    assert sorted({r.state for r in P.from_flux(df, flux, "x", "state", "id", 2).collect()}) == [0, 1]
    q = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.41)], "state int, q double")
    assert {r.state for r in P.from_band(df, q, "x", "state", "id", k=1).collect()} == {1, 2}


def test_tables_and_atoms(spark, tmp_path):
    atoms = spark.createDataFrame([(0, 0, i, n, 0.0, 0.0, 0.0) for i, n in enumerate(["CA", "CB", "CA"])], "traj_id long, frame long, atom_id int, name string, x double, y double, z double")
    pick = lambda **k: sorted(r.atom_id for r in S.select_atoms(atoms, **k).collect())
    assert pick() == [0, 1, 2] and pick(names=["CA"]) == [0, 2] and pick(ids=[0, 1], names=["CA"]) == [0] and pick(ids=[]) == []
    S.write_tables({"a": atoms, "b": atoms.limit(1)}, str(tmp_path), "json")
    S.write_tables({"a": atoms.limit(2)}, str(tmp_path), "json")
    assert spark.read.json(str(tmp_path / "a")).count() == 2 and spark.read.json(str(tmp_path / "b")).count() == 1


def test_progress_events(spark, tmp_path):
    df = spark.createDataFrame([(0, i, 1.0) for i in range(5)], "traj_id long, frame long, x double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    log = D.ProgressLog(4)
    for i in range(9):
        log._add({"kind": "x", "i": i})
    assert [e["i"] for e in log.events] == [5, 6, 7, 8]
