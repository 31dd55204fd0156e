"""Appends to a DCD file: whole or not at all."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import dcd_sink as K
from framewright.sources import trajectories as T


def frames(spark, pos, first=0):
    rows = [(first + i, [tuple(map(float, p)) for p in x]) for i, x in enumerate(pos)]
    return spark.createDataFrame(rows, "frame long, pos array<struct<x:double,y:double,z:double>>").repartition(3)


def positions(spark, path):
    return np.array([[[p.x, p.y, p.z] for p in r.pos] for r in T.read_trajectories(spark, path).orderBy("frame").collect()])


def test_two_appends_and_a_failed_task_leave_one_file(spark, tmp_path):
    path = str(tmp_path / "a.dcd")
    a, b, c = (np.random.default_rng(i).normal(size=(n, 5, 3)).astype("f4") for i, n in ((1, 11), (2, 4), (3, 2)))
    K.append_dcd(frames(spark, a), path)
    K.append_dcd(frames(spark, b, 50), path, parts=2)
    assert np.array_equal(positions(spark, path), np.concatenate([a, b]))
    before = (tmp_path / "a.dcd").read_bytes()
    broken = frames(spark, c).withColumn("frame", F.when(F.col("frame") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("frame")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        K.append_dcd(broken, path)
    one = frames(spark, c[:1])
    for bad in (frames(spark, c[:, :4]), one.union(frames(spark, c[:1, :4], 7)), one.union(frames(spark, c[1:]))):
        with pytest.raises(Exception, match="another size|number of atoms|interleaved|repeated"):
            K.append_dcd(bad, path, parts=3)
        assert (tmp_path / "a.dcd").read_bytes() == before
    assert os.listdir(tmp_path) == ["a.dcd"]
    (tmp_path / "a.dcd").write_bytes(before[:-7])  # cut off while another program wrote it
    K.append_dcd(frames(spark, c), path)
    assert np.array_equal(positions(spark, path), np.concatenate([a, b[:-1], c]))
    K.append_dcd(frames(spark, b), path, overwrite=True)
    assert np.array_equal(positions(spark, path), b)
    K.append_dcd(frames(spark, b).limit(0), path)
    assert np.array_equal(positions(spark, path), b) and os.listdir(tmp_path) == ["a.dcd"]
