"""Streams whose frames come out of order over many micro-batches give what a single batch gives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.streaming import detectors as D
from framewright.streaming import ordered as O

SERIES = {0: [float(v) for v in np.random.default_rng(1).normal(size=60)], 1: [0.0] * 30 + [4.0] * 30, 2: [1.5]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every few frames a file of its own, shuffled."""
    at = tmp_path_factory.mktemp("frames")
    rows = [(t, f, x) for t, s in SERIES.items() for f, x in enumerate(s)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame([(t, f, x, i % 12) for i, (t, f, x) in enumerate(rows)], "traj_id long, frame long, x double, p int")
    for p in range(12):
        df.where(F.col("p") == p).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_000_000)).drop("p").coalesce(1).write.mode("append").parquet(str(at))
    return str(at), df.withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_000_000)).drop("p").schema


def plain():
    out = {}
    for t, s in SERIES.items():
        hills, window = [], []
        for f, x in enumerate(s):
            window, hit = D.drift_step(window, x)
            out[t, f] = (hit, len(window), sum(math.exp(-((x - h) ** 2) / 2) for h in hills))
            if f % 10 == 0:
                hills.append(x)
    return out


@pytest.mark.parametrize("files", [2, 5, 1000])
def test_any_number_of_files_a_trigger(spark, folder, tmp_path, files):
    stream = lambda: D.read_stream(spark, folder[1], folder[0], files)
    want = plain()
    got = D.run_to_files(O.drift(stream()), str(tmp_path / "a")).collect()
    assert {(r.traj_id, r.frame): (r.drift, r.width) for r in got} == {k: v[:2] for k, v in want.items()} and len(got) == len(want)
    got = D.run_to_files(O.bias_ledger(stream()), str(tmp_path / "b")).collect()
    assert len(got) == len(want) and all(math.isclose(r.bias, want[r.traj_id, r.frame][2], rel_tol=1e-12, abs_tol=1e-15) for r in got)
    got = D.run_to_files(O.triggers(stream(), "fixed", 12), str(tmp_path / "c")).collect()
    assert sorted((r.traj_id, r.frame) for r in got) == [(t, f) for t in (0, 1) for f in range(11, 60, 12)]


def test_the_watermark_closes_a_gap(spark, tmp_path):
    """Frame 1 never comes: 2 and 3 wait until the watermark has passed them."""
    rows = [[(0, 0, 1.0, 0), (0, 2, 2.0, 2), (0, 3, 3.0, 3)], [(0, 9, 9.0, 5000)], [(7, 0, 1.0, 5001)], [(0, 1, 7.0, 6000), (7, 1, 1.0, 9000)]]
    for part in rows:
        spark.createDataFrame(part, "traj_id long, frame long, x double, s long").select("traj_id", "frame", "x", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = D.run_to_files(O.drift(D.read_stream(spark, schema, str(tmp_path / "in"), 1), delay="10 seconds"), str(tmp_path / "out")).collect()
    assert sorted((r.traj_id, r.frame, r.width) for r in got if r.frame < 9) == [(0, 0, 1), (0, 2, 2), (0, 3, 3), (7, 0, 1), (7, 1, 2)]
