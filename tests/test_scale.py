"""Quantiles, hills and kernels: exact against plain versions, and their rows in proportion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import hills as B
from framewright.operators import histograms as H
from framewright.operators.quantiles import order_statistics, quantiles

PS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one", "odd"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(5)
    x = {"normal": rng.normal(size=2000), "ties": np.where(rng.random(900) < 0.4, 7.25, rng.integers(0, 9, 900) / 4), "wide": np.sign(rng.normal(size=700)) * 10.0 ** rng.uniform(-300, 308, 700), "one": np.array([3.5]), "odd": np.array([1.0, 2.0, 4.0])}[kind]
    y = np.concatenate([rng.integers(0, 5, len(x))]).astype(float)
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, float("nan")), (float("inf"), None), (float("-inf"), float("nan"))]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    for bins in (4, 1024) if kind != "wide" else (1024,):
        got = quantiles(df, {"x": PS, "y": PS}, bins)
        for c, v in (("x", x), ("y", y)):
            assert np.allclose(got[c], np.quantile(v, PS), rtol=1e-12, atol=0), (c, bins)
    top = order_statistics(df, {"x": list(range(min(3, len(x))))})
    assert [top["x", r] for r in range(min(3, len(x)))] == sorted(x)[:3]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert all(math.isnan(v) for v in quantiles(df, {"x": [0.5]})["x"]) and quantiles(df, {}) == {} and quantiles(df.limit(0), {"x": []}) == {"x": []}
    low, high = H.value_range(spark.range(101), ["id"], (0.1, 0.9))["id"]
    assert (low, high) == (10.0, 90.0)


def plain_bias(x, hill, width):
    return [sum(math.exp(-((x[f] - x[h]) ** 2) / (2 * width**2)) for h in range(f) if hill[h]) for f in range(len(x))]


@pytest.mark.parametrize("every, block, width", [(1, 1, 0.5), (3, 2, 0.05), (10, 16, 2.0), (10, 64, 0.3)])
def test_bias_of_merged_hills(spark, every, block, width):
    rng = np.random.default_rng(every)
    series = {0: np.cumsum(rng.normal(size=700)) / 6, 1: rng.normal(size=130) * 4, 2: np.array([0.25] * 40), 3: np.array([1.0])}
    frames = spark.createDataFrame([(t, f, float(v)) for t, x in series.items() for f, v in enumerate(x)], "traj_id long, frame long, x double").repartition(3)
    hills = frames.where(F.col("frame") % every == 0).withColumn("height", F.lit(1.0))
    got = {(r.traj_id, r.frame): r.bias for r in B.hill_bias(frames, hills, width, block).collect()}
    assert len(got) == sum(map(len, series.values()))
    for t, x in series.items():
        want = plain_bias(x, [f % every == 0 for f in range(len(x))], width)
        assert np.allclose([got[t, f] for f in range(len(x))], want, rtol=0, atol=1e-11)


def test_bias_of_awkward_frames(spark):
    rows = [(0, 0, 1.0), (0, 1, None), (0, 2, float("nan")), (0, 3, 1.0)]
    frames = spark.createDataFrame(rows, "traj_id long, frame long, x double")
    got = {r.frame: r.bias for r in B.hill_bias(frames, frames.withColumn("height", F.lit(2.0)), 1.0).collect()}
    assert got == {0: 0.0, 1: None, 2: None, 3: 2.0}
    assert {r.bias for r in B.hill_bias(frames.where("x = 1"), frames.limit(0).withColumn("height", F.lit(2.0)), 1.0).collect()} == {0.0}
    assert B.hill_bias(frames.limit(0), frames.limit(0).withColumn("height", F.lit(1.0)), 1.0).count() == 0


def test_rows_of_a_frame_grow_with_the_logarithm(spark):
    """A frame of block b meets one range for each binary one of b, whatever the number of hills."""
    frames = spark.range(4096).select(F.lit(0).cast("long").alias("traj_id"), F.col("id").alias("frame"), (F.col("id") % 7 * 1.0).alias("x"))
    table = B.merged_hills(frames.withColumn("height", F.lit(1.0)), 1.0, 6, 64, 4)
    per = table.groupBy("level").agg(F.count_distinct("range").alias("n")).collect()
    assert {r.level: r.n for r in per} == {level: max(1, 64 >> (level + 1)) for level in range(7)}


def test_hermite_polynomials():
    t = B.hermite_table(5)
    assert t[2].tolist() == [-1, 0, 1, 0, 0] and t[3].tolist() == [0, -3, 0, 1, 0] and t[4].tolist() == [3, 0, -6, 0, 1]


@pytest.mark.parametrize("width, periodic", [(0.05, False), (2.0, False), (0.05, True), (0.4, True), (3.0, True)])
def test_kernels_within_reach(spark, width, periodic):
    rng = np.random.default_rng(8)
    cells = rng.uniform(-math.pi, math.pi, (60, 2))
    w = rng.random(60)
    axis = np.linspace(-3.1, 3.1, 23)
    points = [(float(a), float(b)) for a in axis for b in axis[::2]]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(cells, w, strict=True)], "x double, y double, w double")
    got = {(r.gx, r.gy): r.density for r in H.kernel_density(spark, df, spark.createDataFrame(points, "gx double, gy double"), width, periodic).collect()}
    turn = (lambda d: (d + math.pi) % (2 * math.pi) - math.pi) if periodic else (lambda d: d)
    for gx, gy in points:
        want = (w * np.exp(-(turn(gx - cells[:, 0]) ** 2 + turn(gy - cells[:, 1]) ** 2) / (2 * width**2))).sum() / w.sum() / (2 * math.pi * width**2)
        assert abs(got[gx, gy] - want) < 1e-12
    assert H.kernel_density(spark, df.limit(0), spark.createDataFrame(points[:2], "gx double, gy double"), width).where("density is null").count() == 2


# What went wrong without an error at sizes that no test has


def test_bound_of_a_mini_batch_at_any_size():
    from framewright.operators import clustering as K

    for rows in (1, 10**4, 10**10, 10**13, 10**18, 10**22):
        assert 1 <= K.drawn_below(10_000, rows) < 1 << 63
    assert abs(K.drawn_below(10_000, 10**13) / (1 << 63) * 10**13 - 10_000) < 1


def test_mini_batches_of_a_table_that_says_it_is_huge(spark, monkeypatch):
    """With a faked count of 2e11 a batch has 1e4 / 2e11 of the rows: none. The start is not handed back as a result."""
    from pyspark.sql import DataFrame

    from framewright.operators import clustering as K

    df = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 1e4]) for i in range(400)], "id long, x array<double>")
    good = K.mini_batch_k_means(df, "x", 2, "id", batch=40)
    assert sorted(round(c[0]) for c in good) == [0, 10]
    real = DataFrame.count
    monkeypatch.setattr(type(df), "count", lambda self: 2 * 10**11)
    with pytest.raises(ValueError, match="no batch"):
        K.mini_batch_k_means(df, "x", 2, "id")
    monkeypatch.setattr(type(df), "count", lambda self: 4000)  # batches of four rows: some empty ones are drawn again
    assert len(K.mini_batch_k_means(df, "x", 2, "id", batch=4, rounds=12)) == 2 and real


def test_many_centres_by_batches(spark):
    from framewright.operators import clustering as K

    rng = np.random.default_rng(4)
    x, centres = rng.normal(size=(300, 5)).round(1), rng.normal(size=(40, 5)).round(1)
    centres[7] = centres[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, x array<double>")
    few = {r.id: (r.state, r.distance) for r in K.nearest_centre(df, "x", centres.tolist()).collect()}
    many = {r.id: (r.state, r.distance) for r in K.nearest_by_batches(df, "x", centres, 64).collect()}
    assert all(many[i][0] == few[i][0] and many[i][1] == pytest.approx(few[i][1], abs=1e-12) for i in range(300)) and many[999] == (None, None)
    wide = K.nearest_centre(df, "x", (list(centres.tolist()) * 20))
    assert {r.id: r.state for r in wide.collect()} == {i: s for i, (s, _) in many.items()}


def test_weighted_draws_are_whole_and_do_not_depend_on_partitions(spark):
    from framewright.operators import workflow as W

    rows = [(i, float(w)) for i, w in enumerate(np.random.default_rng(6).random(500) ** 4)] + [(1000, 300.0), (1001, 0.0), (1002, -1.0), (1003, None), (1004, float("nan")), (1005, float("inf"))]
    df = spark.createDataFrame(rows, "id long, w double")
    one = sorted(map(tuple, W.weighted_sample(df.repartition(1), "w", 3000, 9, ["id"], 64, 500).collect()))
    two = sorted(map(tuple, W.weighted_sample(df.repartition(7), "w", 3000, 9, ["id"], 64, 500).collect()))
    assert one == two and [d for d, _ in one] == list(range(3000))
    drawn = np.bincount([i for _, i in one], minlength=1006)
    total = sum(w for _, w in rows[:501])
    assert drawn[1001:].sum() == 0 and abs(drawn[1000] - 3000 * 300 / total) < 5 * math.sqrt(3000 * 300 / total * (1 - 300 / total))
    expected = 3000 * np.array([w for _, w in rows[:500]]) / total
    assert abs(((drawn[:500] - expected) ** 2 / np.maximum(expected, 1e-9))[expected > 1].mean() - 1) < 0.5
    assert W.weighted_sample(df.where("id > 1000"), "w", 5, 1, ["id"]).collect() == []


def test_batches_hold_every_row_once(spark):
    from framewright.operators import workflow as W

    df = spark.range(1003).select("id", (F.col("id") % 3).alias("v"))
    one, two = (sorted((r.batch, r.id) for r in W.exact_batches(df.repartition(p), 100, 4, ["id"], rows).collect()) for p, rows in ((1, 50), (5, 10_000)))
    assert one == two and sorted(i for _, i in one) == list(range(1003)) and [i for _, i in one] != list(range(1003))
    assert np.bincount([b for b, _ in one]).tolist() == [100] * 10 + [3]
    assert W.exact_batches(df.limit(0), 10, 1, ["id"]).count() == 0


def test_jitter_does_not_depend_on_partitions(spark):
    from framewright.sources import frames as S

    df = spark.range(4000).select(F.col("id").alias("traj_id"), F.lit(0).alias("frame"), F.lit(1.0).alias("x"))
    one, two = ({r.traj_id: r.x for r in S.last_frames(df.repartition(p), 0.5, 3, ("x",)).collect()} for p in (1, 5))
    noise = np.array(list(one.values())) - 1
    assert one == two and abs(noise.mean()) < 0.03 and abs(noise.std() - 0.5) < 0.03


def test_ck_on_macrostates_or_on_the_most_visited(spark):
    from framewright.operators import msm as M

    rng = np.random.default_rng(1)
    state, rows = 0, []
    for f in range(6000):
        state = (state // 2) * 2 + int(rng.random() < 0.5) if rng.random() < 0.97 else (2 - (state // 2) * 2) + int(rng.random() < 0.5)
        rows.append((0, f, state))
    two = M.ck_choice(spark, spark.createDataFrame(rows, "traj_id long, frame long, state int"), 1, 2, (2, 3)).collect()
    assert {r.mode for r in two} == {"macro"} and all(r.mse < 1e-3 for r in two)
    free = spark.createDataFrame([(0, f, int(s)) for f, s in enumerate(rng.integers(0, 9, 9000))], "traj_id long, frame long, state int")
    cut = M.ck_choice(spark, free, 1, 9, (2,), top=4).collect()
    assert [(r.mode, r.factor) for r in cut] == [("micro", 2)] and cut[0].mse < 1e-3


def test_balanced_samples(spark):
    from framewright.operators import workflow as W

    rows = [(i, "a" if i < 900 else "b" if i < 940 else None) for i in range(950)]
    df = spark.createDataFrame(rows, "id long, g string")
    one, two = (sorted(r.id for r in W.balanced_sample(df.repartition(p), "g", 30, 5, ["id"]).collect()) for p in (1, 6))
    assert one == two and [sum(a <= i < b for i in one) for a, b in ((0, 900), (900, 940), (940, 950))] == [30, 30, 10]
    assert sorted(r.id for r in W.balanced_sample(df, "g", 30, 6, ["id"]).collect()) != one
    plan = W.balanced_sample(df, "g", 30, 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
