"""Python holds pieces of Arrow batches, and a complete analysis projects each frame once."""

import tracemalloc
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from framewright.operators import reduction as R
from framewright.operators import workflow as W


@pytest.fixture
def caught(spark, monkeypatch):
    """The functions that are given to ``mapInArrow``."""
    made = []
    kind = type(spark.range(1))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: made.append(f) or plain(self, f, *a, **k))
    return made


def peak(f, batch: pa.RecordBatch) -> tuple[int, list[pa.RecordBatch]]:
    tracemalloc.start()
    out = list(f(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, out


def test_large_batches_are_not_copied_whole(spark, caught):
    x = np.random.default_rng(5).normal(size=(20_000, 24))
    names = [f"x{i}" for i in range(24)]
    batch = pa.RecordBatch.from_arrays([pa.array(v, mask=np.arange(len(v)) % 997 == i) for i, v in enumerate(x.T)], names=names)
    few = spark.createDataFrame([tuple(map(float, r)) for r in x[:30]], ", ".join(f"{c} double" for c in names))
    R.gram_moments(few, names)
    most, (sums,) = peak(caught[0], batch)
    assert sums["n"].to_pylist() == [20_000] and most < batch.nbytes / 2
    basis = np.eye(24)[:, :2]
    R.Projection(names, np.ones(24), basis, np.ones(2)).apply(few)
    most, (made,) = peak(caught[-1], batch)
    assert most < batch.nbytes / 2 and made.num_rows == 20_000
    lost = (np.arange(20_000)[:, None] % 997 == np.arange(24)).any(1)
    for k in range(2):
        assert np.array_equal(~np.asarray(made[f"ic{k}"].is_valid()), lost)
        assert np.allclose(np.asarray(made[f"ic{k}"].to_numpy(zero_copy_only=False))[~lost], x[~lost, k] - 1)


def test_complete_analysis_projects_each_frame_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(t, f, *map(float, 4 * ((f // 20) % 2) + rng.normal(size=3))) for t in range(3) for f in range(200)]
    df = spark.createDataFrame(rows, "traj_id long, frame long, a double, b double, c double").repartition(2, "traj_id", "frame")
    folder = str(tmp_path)

    def marked(batches):
        Path(folder, uuid.uuid4().hex).touch()
        yield from batches

    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    made = W.complete_analysis(spark, df.mapInArrow(marked, df.schema), ["a", "b", "c"], n_states=2, lags=(1, 2))
    passes = len(list(tmp_path.iterdir()))
    assert passes == 2 * 2  # two partitions, once for the moments and once for the projection
    whole = made["assignments"].toPandas()
    assert list(whole.columns) == ["traj_id", "frame", "a", "b", "c", "ic0", "ic1", "state"] and len(whole) == 600
    assert set(whole["state"]) == {r.state for r in made["states"].collect()} == {0, 1}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
