"""Whole analyses, trajectories on disk and superposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import workflow as W
from framewright.sources import frames as S
from framewright.sources import trajectories as D


def test_dcd_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(23, 5, 3)).astype("f4")
    D.write_dcd(str(tmp_path / "a.dcd"), x)
    D.write_dcd(str(tmp_path / "b.dcd"), x[:4])
    rows = D.read_trajectories(spark, str(tmp_path / "a.dcd"), chunk=6).orderBy("frame").collect()
    assert np.allclose([[list(p) for p in r.pos] for r in rows], x)
    some = D.read_trajectories(spark, f"{tmp_path}/*.dcd", start=1, stop=20, stride=3, atoms="4,0", chunk=7).collect()
    assert sorted((r.path[-5], r.frame) for r in some) == sorted([("a", i) for i in range(1, 20, 3)] + [("b", 1)])
    assert all(len(r.pos) == 2 for r in some)
    assert D.read_trajectories(spark, str(tmp_path / "b.dcd"), start=50).count() == 0


def test_pdb_columns(spark, tmp_path):
    text = "HEADER\nATOM      1  CA  ALA A   7      11.104   6.134  -6.504  1.00  0.00           C\nHETATM    2  O   HOH B 999       1.000   2.000   3.000\nEND\n"
    (tmp_path / "x.pdb").write_text(text)
    rows = D.read_pdb(spark, str(tmp_path / "x.pdb")).orderBy("atom_id").collect()
    assert tuple(rows[0]) == (1, "CA", "ALA", "A", 7, 11.104, 6.134, -6.504) and rows[1].res_id == 999


def test_superposition_undoes_rotations(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.linalg.det(q)
    rows = [(0, i, [tuple(map(float, p)) for p in x]) for i, x in enumerate([base, base @ q + 3, base @ q.T - 1])]
    df = spark.createDataFrame(rows, "traj_id long, frame long, pos array<struct<x:double,y:double,z:double>>")
    for r in W.superposed(df).collect():
        assert np.allclose([list(p) for p in r.pos], base, atol=1e-9)
    assert W.universal_embedding(df.union(df.withColumn("frame", F.col("frame") + 3)), "pair", "pca").count() == 6


def test_discretise_splits(spark):
    rows = [("train", 0, i, float(i % 2), 0.0) for i in range(8)] + [("val", 1, i, 1.0, 0.0) for i in range(3)] + [("__meta", 2, 0, 9.0, 9.0), ("bad", 3, 0, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "split string, traj_id long, frame long, a double, b double")
    for mode in ("kmeans", "grid"):
        got = W.discretise(df, ["a", "b"], n_states=2 if mode == "kmeans" else 4, mode=mode)
        assert got.summary["splits"] == ["train", "val"] and got.summary["fit"] == "train" and got.summary["expected_pairs"] == 7
        assert got.counts.agg(F.sum("n")).first()[0] == 7 and got.states.where("split = 'val'").select("state").distinct().count() == 1
        assert {round(r.p, 9) for r in got.matrix.collect()} == {1.0}
    with pytest.raises(ValueError):
        W.discretise(df, ["a"], mode="other")
    with pytest.raises(ValueError):
        W.discretise(df.limit(0), ["a"])


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 1, 3, 6, 0])], "k long, w double")
    got = W.weighted_sample(df, "w", 4000, 3, ["k"])
    n = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert set(n) == {1, 2, 3} and sum(n.values()) == 4000 and abs(n[3] / 4000 - 0.6) < 0.05
    assert W.weighted_sample(df.limit(1), "w", 10, 3, ["k"]).count() == 0


def test_small_things(spark, tmp_path):
    assert W.phi_psi_pairs(["psi:res3", "phi:res3", "phi:res1", "x"]) == [("phi:res3", "psi:res3")]
    assert W.recommended_lags(3.0, 12) and max(W.recommended_lags(3.0, 12)) <= 12
    assert S.to_json({"a": float("nan"), "b": np.arange(2)}) == '{"a": null, "b": [0, 1]}'
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], "traj_id long, frame long, x double")
    S.write_frames(df, str(tmp_path / "f"))
    S.write_frames(df, str(tmp_path / "f"))
    assert S.read_frames(spark, [str(tmp_path / "f")]).count() == 4
    with pytest.raises(ValueError):
        S.read_frames(spark, ["x"], "tng")
    a = S.feature_cache(df, "k", str(tmp_path / "c")).count()
    assert a == S.feature_cache(df.limit(0), "k", str(tmp_path / "c")).count() == 2
    empty = S.union_aligned([], spark, "a int")
    assert empty.count() == 0 and S.last_frames(df, 0.1, 1, ("x",)).count() == 1
