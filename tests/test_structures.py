"""Residue features, settings, results, macrostates and microstates against plain versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import backbone as B
from framewright.functions import linalg as L
from framewright.operators import clustering as K
from framewright.sources import frames as S
from framewright.sources import settings as C

ATOMS = [(n, "A", r) for r, names in ((1, "N CA C O CB"), (2, "N CA CB OG C O"), (3, "N CA C O CB CG"), (7, "N CA C")) for n in names.split()]


def dihedral(p):
    u, v, w = p[1] - p[0], p[2] - p[1], p[3] - p[2]
    m, n = np.cross(u, v), np.cross(v, w)
    return math.atan2(np.cross(m, n) @ v / np.linalg.norm(v), m @ n)


def test_torsions_and_distances(spark):
    x = np.random.default_rng(0).normal(size=(3, len(ATOMS), 3))
    frames = spark.createDataFrame([(0, i, [tuple(map(float, p)) for p in v]) for i, v in enumerate(x)], "traj_id long, frame long, pos array<struct<x:double,y:double,z:double>>")
    at = {(r, n): i for i, (n, _, r) in enumerate(ATOMS)}
    want = {f"phi:res{r}": [at[r - 1, "C"], at[r, "N"], at[r, "CA"], at[r, "C"]] for r in (2, 3)}
    want |= {f"psi:res{r}": [at[r, "N"], at[r, "CA"], at[r, "C"], at[r + 1, "N"]] for r in (1, 2)}
    chi = {"chi1:res2": [at[2, n] for n in ("N", "CA", "CB", "OG")], "chi1:res3": [at[3, n] for n in ("N", "CA", "CB", "CG")]}
    for kind, labels in (("phi_psi", want), ("backbone_torsions", want | chi)):
        rows = B.featurised(frames, ATOMS, kind).orderBy("frame").collect()
        assert rows[0].asDict().keys() == {"traj_id", "frame", *labels}
        for r, v in zip(rows, x, strict=True):
            for label, four in labels.items():
                assert math.isclose(r[label], dihedral(v[four]), rel_tol=1e-9)
    rows = B.featurised(frames, ATOMS, "ca_distances").orderBy("frame").collect()
    alpha = [i for i, a in enumerate(ATOMS) if a[0] == "CA"]
    for r, v in zip(rows, x, strict=True):
        assert np.allclose([r[f"dist:atoms:{i}-{j}"] for n, i in enumerate(alpha) for j in alpha[n + 1 :]], [np.linalg.norm(v[i] - v[j]) for n, i in enumerate(alpha) for j in alpha[n + 1 :]])
    assert len(B.alpha_pairs(ATOMS, 2)) == 2 and len(B.alpha_pairs(ATOMS, None, 3)) == 1
    two = B.torsions(ATOMS[:9] + [(n, "B", r) for n, _, r in ATOMS[:9]])
    assert {label.split(":")[1] for label, _ in two} == {"A", "B"}
    with pytest.raises(ValueError):
        B.featurised(frames, ATOMS, "other")
    with pytest.raises(ValueError):
        B.alpha_pairs(ATOMS[:2])


GOOD = {"hydrophobic_residues": "A V", "aromatic_residues": ["F"], "basic_residues": "KR", "acidic_residues": "DE", "pka_side": {"K": 10.5, "r": "12.5", "D": 3.9, "E": 4.1}, "pka_n_terminus": 9.6, "pka_c_terminus": 2.3, "ph_lower": 0, "ph_upper": 14, "pi_tolerance": 1e-4, "pi_max_iterations": 60}


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"b": 2}, "features": ["Rg", "dist:atompair( 0, 5)"]}))
    (tmp_path / "a.toml").write_text('features = ["rg", "distance(0,5)"]\n[x]\nb = 2\n')
    assert C.load(tmp_path / "a.json", {"x": {"a": 1, "b": 1}})["x"] == {"a": 1, "b": 2}
    assert C.feature_spec(tmp_path / "a.json") == C.feature_spec(tmp_path / "a.toml") == (["rg", "distance(0,5)"], C.fingerprint(["rg", "distance(0,5)"]))
    assert C.canonical({"b": 1, "a": [1, 2]}) == '{"a":[1,2],"b":1}'
    for bad in (lambda: C.load(tmp_path / "no.json"), lambda: C.load(tmp_path / "a.json", required=("y",)), lambda: C.canonical_features(["angle(0,1)"])):
        with pytest.raises(C.SettingsError):
            bad()
    got = C.residue_settings(GOOD)
    assert got["hydrophobic_residues"] == {"A", "V"} and got["pka_side"]["R"] == 12.5
    for change in ({"basic_residues": "KD"}, {"pka_side": {"K": 1}}, {"ph_lower": 14}, {"pi_tolerance": 0}, {"pi_max_iterations": True}, {"aromatic_residues": ["FY"]}, {"pka_n_terminus": "x"}, {"pka_side": []}):
        with pytest.raises(C.SettingsError):
            C.residue_settings(GOOD | change)
    with pytest.raises(C.SettingsError):
        C.residue_settings({k: v for k, v in GOOD.items() if k != "pka_side"})


def test_results_come_back():
    own = {"p": np.array([[0.5, np.nan], [1.0, 0.0]]), "states": np.array([3, 1]), "names": ["a", "b"], "lag": 5, "deep": {"x": np.float32([1.5])}}
    back = S.result_from_json(S.result_json(own))
    assert np.array_equal(back["p"], own["p"], equal_nan=True) and back["states"].dtype == own["states"].dtype and back["deep"]["x"].dtype == np.float32
    assert (back["names"], back["lag"]) == (["a", "b"], 5)
    assert S.result_from_json(S.result_json(own, True))["p"] == {"shape": (2, 2), "dtype": "float64"}
    with pytest.raises(ValueError):
        S.result_from_json('{"schema_version": "9", "result": {}}')


def test_memberships_are_crisp_and_feasible():
    rng = np.random.default_rng(2)
    for k in (2, 3, 4):
        block = np.repeat(np.arange(k), 4)
        c = rng.random((4 * k, 4 * k)) * 0.02 + (block[:, None] == block) * rng.uniform(0.5, 1.5, (4 * k, 4 * k))
        c = c + c.T
        p, pi = c / c.sum(1, keepdims=True), c.sum(1) / c.sum()
        x = L.dominant_eigenvectors(p, pi, k)
        assert np.allclose(p @ x, x * np.sort(np.linalg.eigvals(p).real)[::-1][:k])
        start, chi = L.memberships(p, pi, k, False), L.memberships(p, pi, k)
        crisp = lambda m: float(((m.T * pi) @ m / (m.T @ pi)[:, None]).trace())
        assert np.allclose(chi.sum(1), 1) and (chi >= 0).all() and crisp(chi) >= crisp(start) - 1e-9
        assert [sorted(set(chi.argmax(1)[block == b].tolist())) for b in range(k)] and len({tuple(chi.argmax(1)[block == b]) for b in range(k)}) == k
        assert np.linalg.lstsq(x, chi, rcond=None)[1].max() < 1e-12  # spanned by the eigenvectors
    assert np.allclose(L.downhill(lambda v: float(((v - [1.0, -2.0]) ** 2).sum()), np.zeros(2)), [1, -2], atol=1e-4)


def test_microstates(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0], [8, 0], [0, 8], [8, 8], [4, 20]])
    pts = np.repeat(centres, 40, 0) + rng.normal(size=(200, 2)) * 0.3
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, x array<double>")
    for method in ("kmeans", "minibatchkmeans"):
        out, made = K.microstates(df, "x", "id", 5, method, restarts=4)
        of = np.array([r.state for r in out.orderBy("id").collect()])
        assert len(made) == 5 and sorted(set(of.tolist())) == list(range(5))
        assert np.allclose([pts[of == s].mean(0) for s in range(5)], made)
        if method == "kmeans":
            assert all(len(set(of[40 * b : 40 * b + 40])) == 1 for b in range(5))
    assert len(K.microstates(df, "x", "id", "auto", restarts=1, ks=range(4, 7))[1]) == 5
    few = df.where("id < 2").withColumn("x", F.array(F.lit(1.0)))
    assert K.microstates(few, "x", "id", 7)[1] == [[1.0]] and K.microstates(df.limit(0), "x", "id", 3)[1] == []
    big = K.mini_batch_k_means(df, "x", 2, "id", batch=50, rounds=5)
    assert len(big) == 2 and np.allclose(big, K.mini_batch_k_means(df.repartition(3), "x", 2, "id", batch=50, rounds=5))
    with pytest.raises(ValueError):
        K.microstates(df, "x", "id", 3, "other")
