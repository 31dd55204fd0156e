"""Solvent area against closed forms, hydrogen bonds against all triplets and on a built helix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import surface as A


def atoms_of(spark, frames):
    rows = [(0, f, i, e, *map(float, p)) for f, atoms in enumerate(frames) for i, (e, p) in enumerate(atoms)]
    return spark.createDataFrame(rows, "traj_id long, frame long, atom_id int, element string, x double, y double, z double")


def test_two_spheres_have_the_closed_form(spark):
    """A sphere of radius r loses the cap 2 pi r h, h = r - (d^2 + r^2 - s^2) / 2d, to one of radius s at distance d."""
    r, s, gaps = 0.17 + A.PROBE, 0.12 + A.PROBE, (0.1, 0.3, 0.45, 0.7, 3.0)
    df = atoms_of(spark, [[("C", (0, 0, 0)), ("H", (0.6 * g, 0, 0.8 * g))] for g in gaps]).withColumn("radius", A.radius_of(F.col("element")))
    for edge in (0.3, 2.0):
        got = {x.frame: x.area for x in A.solvent_area(df, n_points=5000, edge=edge).collect()}
        for f, d in enumerate(gaps):
            cap = lambda a, b: 2 * math.pi * a * min(2 * a, max(0.0, a - (d * d + a * a - b * b) / (2 * d))) if d < a + b else 0.0  # noqa: B023, E731
            want = 4 * math.pi * (r * r + s * s) - cap(r, s) - cap(s, r)
            assert got[f] == pytest.approx(want, rel=4e-3)


def test_cells_do_not_change_areas(spark):
    rng = np.random.default_rng(1)
    df = atoms_of(spark, [[("NCOH"[i % 4], p) for i, p in enumerate(rng.uniform(-1, 1, (60, 3)))] for _ in range(2)]).withColumn("radius", A.radius_of(F.col("element")))
    odd = df.union(spark.createDataFrame([(0, 0, 900, "C", None, 0.0, 0.0, 0.1), (0, 1, 901, "C", float("nan"), 0.0, 0.0, 0.1)], df.schema))
    one, two = ({(r.frame, r.atom_id): r.area for r in A.atom_areas(t, n_points=100, edge=e).collect()} for t, e in ((df, 100.0), (odd, 0.5)))
    assert one.keys() == two.keys() and len(one) == 120 and all(math.isclose(one[k], two[k], abs_tol=1e-12) for k in one)
    assert np.allclose(np.linalg.norm(A.sphere_points(77), axis=1), 1) and np.abs(A.sphere_points(1000).mean(0)).max() < 2e-3


def plain_bonds(frame, bonds):
    out = []
    for d, h in bonds:
        for a, (e, p) in enumerate(frame):
            if e in "NO" and a not in (d, h):
                u, v = np.subtract(p, frame[h][1]), np.subtract(frame[d][1], frame[h][1])
                gap = np.linalg.norm(u)
                if gap < 0.25 and math.degrees(math.acos(np.clip(u @ v / gap / np.linalg.norm(v), -1, 1))) > 120:
                    out.append((d, h, a))
    return sorted(out)


def test_bonds_equal_all_triplets(spark):
    rng = np.random.default_rng(2)
    frames, bonds = [], [(i, i + 1) for i in range(0, 40, 4)]
    for _ in range(3):
        p = rng.uniform(-0.4, 0.4, (40, 3))
        for d, h in bonds:
            p[h] = p[d] + (v := rng.normal(size=3)) / np.linalg.norm(v) * 0.1
        frames.append([("NHOC"[i % 4], x) for i, x in enumerate(p)])
    df, b = atoms_of(spark, frames), spark.createDataFrame(bonds, "donor int, hydrogen int")
    found = A.hydrogen_bonds(df, b)
    got = sorted((r.frame, r.donor, r.hydrogen, r.acceptor) for r in found.collect())
    want = [(f, *t) for f, frame in enumerate(frames) for t in plain_bonds(frame, bonds)]
    assert got == want and len(want) > 10
    assert {r.frame: r.bonds for r in A.bond_counts(df, found).collect()} == {f: sum(t[0] == f for t in want) for f in range(3)}
    often = {}
    for _, *t in want:
        often[tuple(t)] = often.get(tuple(t), 0) + 1
    kept = {r.frame: r.bonds for r in A.bond_counts(df, found, frequency=0.5).collect()}
    assert kept == {f: sum(t[0] == f and often[t[1:]] > 1.5 for t in want) for f in range(3)}


def test_a_helix_binds_every_fourth_residue(spark):
    """N-H of residue i + 4 points at O of residue i along the axis: n - 4 bonds in each frame."""
    n, atoms, bonds = 12, [], []
    for i in range(n):
        turn = math.radians(100 * i)
        x, y, z = 0.2 * math.cos(turn), 0.2 * math.sin(turn), 0.15 * i
        atoms += [("N", (x, y, z)), ("H", (x, y, z - 0.1)), ("O", (0.2 * math.cos(turn + math.radians(400)), 0.2 * math.sin(turn + math.radians(400)), z + 0.6 - 0.1 - 0.19))]
        bonds.append((3 * i, 3 * i + 1))
    df = atoms_of(spark, [atoms, [(e, (p[0] + 5, p[1], p[2])) for e, p in atoms]])
    found = A.hydrogen_bonds(df, spark.createDataFrame(bonds, "donor int, hydrogen int"))
    assert sorted((r.donor // 3, r.acceptor // 3) for r in found.where("frame = 0").collect()) == [(i + 4, i) for i in range(n - 4)]
    assert {r.bonds for r in A.bond_counts(df, found).collect()} == {n - 4}


def test_small_groups_go_together(spark):
    """Batches that cut groups, equal keys and single atoms included: whole groups, many at once, areas as by a plain loop."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sizes = [1, 30, 2, 1, 75, 3, 4] * 3
    key = np.repeat(np.arange(len(sizes)), sizes)
    at, radius, home = rng.uniform(-0.6, 0.6, (len(key), 3)), rng.uniform(0.25, 0.35, len(key)), rng.random(len(key)) < 0.8
    table = pa.table({"k": key, "i": np.arange(len(key))})
    for size in (1, 7, 1000):
        parts = list(A.groups_in_order(table.to_batches(max_chunksize=size), ["k"]))
        assert pa.concat_tables(parts)["i"].to_pylist() == list(range(len(key)))
        assert sum(len(A.group_starts(p, ["k"])) for p in parts) == len(sizes) and (size < 1000 or len(parts) == 2)
    points = A.sphere_points(60)
    want = []
    for i in np.flatnonzero(home):
        others = [j for j in np.flatnonzero(key == key[i]) if j != i]
        spots = at[i] + radius[i] * points
        want.append(1 - np.mean([any(((p - at[j]) ** 2).sum() < radius[j] ** 2 for j in others) for p in spots]))
    for most in (1, 64, 1 << 18):
        assert np.array_equal(A.exposed_shares(at, radius, home, A.group_starts(table, ["k"]), points, most), want)
