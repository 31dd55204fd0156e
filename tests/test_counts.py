"""Counts, pairs and segments on small frames and by properties."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.operators import counts as C
from framewright.operators import pairs as P

SCHEMA = "traj_id long, frame long, state int, w double"


def frames(spark, states, traj=0):
    return spark.createDataFrame([(traj, i, s, float(i + 1)) for i, s in enumerate(states)], SCHEMA)


def cells(df):
    return {(r.tau, r.src, r.dst): r.n for r in df.collect()}


def plain_counts(states, tau, step=1):
    out = {}
    for i in range(0, len(states) - tau, step):
        a, b = states[i], states[i + tau]
        if a is not None and b is not None:
            out[tau, a, b] = out.get((tau, a, b), 0) + 1
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0, 1, 2, None]), max_size=25), st.integers(1, 6))
def test_counts_equal_a_plain_loop(spark, states, tau):
    df = frames(spark, states)
    assert cells(C.transition_counts(df, [tau])) == plain_counts(states, tau)
    assert cells(C.transition_counts(df, [tau], mode="strided")) == plain_counts(states, tau, tau)
    own = [s for s in states if s is not None]
    assert cells(C.transition_counts(df, [tau], gap_policy="compact")) == plain_counts(own, tau)


def test_weights_are_those_of_the_source(spark):
    got = cells(C.transition_counts(frames(spark, [0, 1, 0]), [1], weight="w"))
    assert got == {(1, 0, 1): 1.0, (1, 1, 0): 2.0}


def test_gaps_split_pairs(spark):
    df = frames(spark, [0, 0, None, 0, 0, 0])
    assert cells(C.transition_counts(df, [2])) == {(2, 0, 0): 2}
    assert cells(C.transition_counts(df, [2], gap_policy="split")) == {(2, 0, 0): 1}


@pytest.mark.parametrize("length", [0, 1, 3, 4])
def test_expected_pairs_at_the_edges(spark, length):
    df = frames(spark, [0] * length)
    want = max(0, length - 3)
    assert sum(cells(C.transition_counts(df, [3])).values()) == want
    assert spark.range(1).select(P.expected_pairs(F.lit(length), 3).alias("n")).first().n == want


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 10)), min_size=1, max_size=5), st.integers(1, 10))
def test_expected_pairs_by_simulation(spark, segments, tau):
    df = spark.createDataFrame(segments, "length long, stride int")
    got = [r.n for r in df.select(P.expected_pairs(F.col("length"), F.lit(tau), F.col("stride")).alias("n")).collect()]
    assert got == [len(range(0, max(0, n - tau), s)) for n, s in segments]


def test_dwell_and_zero_rows(spark):
    df = frames(spark, [0, 0, 1, 0, 2])
    rows = {r.state: (r.n_runs, r.min_len, r.max_len) for r in C.dwell_stats(df).collect()}
    assert rows == {0: (2, 1, 2), 1: (1, 1, 1), 2: (1, 1, 1)}
    states = spark.createDataFrame([(s,) for s in range(4)], "state int")
    assert {r.state for r in C.zero_rows(C.transition_counts(df, [1]), states).collect()} == {2, 3}


def test_pruning_drops_and_relabels(spark):
    df = frames(spark, [0, 5, 0, 5, 9])
    got = {r.state: r.label for r in C.pruned(df, 1).select("state", "label").distinct().collect()}
    assert got == {0: 0, 5: 1, 9: None}


def test_locate_and_expand(spark):
    seg = spark.createDataFrame([("a", 0, 10, 100, 5), ("b", 10, 10, 0, 1), ("c", 10, 9000, 0, 1)], "path string, start long, stop long, local_start long, local_stride int")
    q = spark.createDataFrame([(3,), (9,), (10,), (8999,), (9000,), (-1,)], "g long")
    assert {(r.g, r.path, r.local_frame) for r in P.locate(q, seg).collect()} == {(3, "a", 115), (9, "a", 145), (10, "c", 0), (8999, "c", 8989)}


def test_bad_arguments(spark):
    df = frames(spark, [0, 1])
    with pytest.raises(ValueError):
        P.lagged_pairs(df, 0, ["state"])
    with pytest.raises(ValueError):
        C.transition_counts(df, [1], mode="other")


def test_state_table_and_free_energy(spark):
    df = spark.createDataFrame([(0, i, s, x) for i, (s, x) in enumerate([(0, 0.0), (0, 1.0), (0, 0.4), (1, 5.0)])], "traj_id long, frame long, state int, x double")
    rows = {r.state: r for r in C.state_table(df).collect()}
    assert rows[0].free_energy == 0 and rows[0].rep_frame == 2
    assert np.isclose(rows[1].free_energy, 0.00831446261815324 * 300 * np.log(3))
