"""The queries over vectors use all 64 components."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from framewright.operators import reduction as R


@pytest.fixture(scope="module")
def table(sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas().sort_values("vec_id")
    return t, np.stack(t["embedding"].to_numpy()).astype("f8")


def test_gram_moments_equal_the_aggregation(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 1e4
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in x]
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    want = R.moments(df, names[:3], names[2:])
    monkeypatch.setattr(R, "NARROW", 0)
    for a, b in zip(R.moments(df, names[:3], names[2:]), want, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    assert R.moments(df.limit(0), names, names)[0] == 0


def test_pca_and_whiten_of_all_components(spark, sf_dir, table):
    t, x = table
    z = (x - x.mean(0)) / x.std(0)
    u = np.linalg.eigh(np.cov(z.T, bias=True))[1][:, ::-1][:, :2]
    got = entry.queries()["pca"](spark, sf_dir).orderBy("vec_id").toPandas()[["ic0", "ic1"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(z @ u), atol=1e-6)
    w = entry.queries()["whiten"](spark, sf_dir).toPandas().drop(columns="vec_id").to_numpy()
    assert w.shape == x.shape and np.allclose(np.cov(w.T, bias=True), np.eye(64), atol=1e-6)


def test_lagged_queries_of_all_components(spark, sf_dir, table):
    t, x = table
    label = t["label"].to_numpy()
    order = np.lexsort((t["vec_id"], label))
    same = label[order][1:] == label[order][:-1]
    a, b = x[order][:-1][same], x[order][1:][same]
    a, b = a - a.mean(0), b - b.mean(0)
    n = len(a)
    la, lb = (np.linalg.cholesky(v.T @ v / n + 1e-6 * np.eye(64)) for v in (a, b))
    want = (np.linalg.solve(lb, np.linalg.solve(la, a.T @ b / n).T) ** 2).sum()
    assert np.isclose(entry.queries()["vamp2_score"](spark, sf_dir).first().score, want)
    assert entry.queries()["canonical_correlations"](spark, sf_dir).count() == 32
    for name in ("tica", "vamp"):
        got = entry.queries()[name](spark, sf_dir).toPandas()
        whole = np.column_stack([np.ones(len(x)), x, got.sort_values("frame")["ic0"]])
        assert len(got) == len(x) and np.linalg.matrix_rank(whole, tol=1e-6) == 65
        part = np.column_stack([np.ones(len(x)), x[:, :6], got.sort_values("frame")["ic0"]])
        assert np.linalg.matrix_rank(part, tol=1e-6) == 8  # not a function of the first six
    assert entry.queries()["complete_msm_analysis"](spark, sf_dir).count() > 1
