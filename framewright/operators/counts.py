"""Transition counts and what follows from them: one builder for all count kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.constants import DIRICHLET_ALPHA, TINY, kt
from framewright.operators.pairs import compacted, multi_lag_pairs, valid_runs


def transition_counts(frames: DataFrame, taus: list[int], *, weight: str | None = None, mode: str = "sliding", gap_policy: str = "drop_pairs", keys: tuple[str, ...] = ("traj_id",), state: str = "state") -> DataFrame:
    """(tau, src, dst, n) of all lags in one pass; null states are invalid.

    ``weight`` sums the source frame's weight (n DOUBLE), else pairs are counted (n BIGINT). ``mode``
    "strided" keeps every tau-th source frame. Pairs never leave ``keys`` (add seg_id to respect segments);
    ``gap_policy`` says what an invalid frame does: "drop_pairs" with an invalid end, "split" the
    trajectory there, or "compact" by deleting the frame.
    """
    if mode not in ("sliding", "strided") or gap_policy not in ("drop_pairs", "split", "compact"):
        raise ValueError("unknown mode or gap policy")
    valid = F.col(state).isNotNull()
    if gap_policy == "split":
        frames, keys = valid_runs(frames, valid), (*keys, "seg_id")
    elif gap_policy == "compact":
        frames = compacted(frames, valid)
    pairs = multi_lag_pairs(frames, taus, state, keys, (weight,) if weight else ()).where("src is not null and dst is not null")
    if mode == "strided":
        pairs = pairs.where("frame % tau = 0")
    return pairs.groupBy("tau", "src", "dst").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def normalised(counts: DataFrame, by: tuple[str, ...] = ("tau", "src")) -> DataFrame:
    """Counts with ``p``, the share of their row."""
    by = tuple(c for c in by if c in counts.columns)
    return counts.withColumn("p", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy(*by)), F.lit(0)))


def visits(frames: DataFrame, weight: str | None = None, states: DataFrame | None = None) -> DataFrame:
    """(state, n); with ``states(state)`` also those never visited, as 0."""
    n = frames.where("state is not null").groupBy("state").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    return n if states is None else states.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def occupancy_tail(state_visits: DataFrame, k: int = 10) -> DataFrame:
    """The k least visited states, ties by state."""
    return state_visits.orderBy("n", "state").limit(k)


def diagonal_mass(matrix: DataFrame, n_states: Column | int) -> DataFrame:
    """(tau, diag_mass): mean of the diagonal over all states."""
    n = F.lit(n_states) if isinstance(n_states, int) else n_states
    return matrix.groupBy("tau").agg((F.sum(F.when(F.col("src") == F.col("dst"), F.col("p")).otherwise(0.0)) / n).alias("diag_mass"))


def zero_rows(counts: DataFrame, states: DataFrame) -> DataFrame:
    """States without outgoing counts."""
    return states.join(counts.where("n > 0").select(F.col("src").alias("state")).distinct(), "state", "left_anti")


def run_lengths(frames: DataFrame, merge_gaps: bool = False) -> DataFrame:
    """(traj_id, state, length) of runs of equal states; an invalid frame ends a run unless gaps merge."""
    valid = F.col("state").isNotNull()
    own = compacted(frames, valid) if merge_gaps else frames.where(valid)
    w = Window.partitionBy("traj_id").orderBy("frame")
    by_state = Window.partitionBy("traj_id", "state").orderBy("frame")
    place = F.row_number().over(w) if merge_gaps else F.col("frame")
    island = own.select("traj_id", "state", (place - F.row_number().over(by_state)).alias("island"))
    return island.groupBy("traj_id", "state", "island").agg(F.count(F.lit(1)).alias("length")).drop("island")


def dwell_stats(frames: DataFrame, merge_gaps: bool = False) -> DataFrame:
    """Run lengths of each state: number, least, largest, mean and median."""
    runs = run_lengths(frames, merge_gaps)
    return runs.groupBy("state").agg(F.count(F.lit(1)).alias("n_runs"), F.min("length").alias("min_len"), F.max("length").alias("max_len"), F.avg("length").alias("mean_len"), F.percentile("length", 0.5).alias("median_len"))


def active_states(counts: DataFrame, least: float = TINY) -> DataFrame:
    """States whose row and column sums together exceed ``least``, as ``state, total``."""
    ends = counts.select(F.explode(F.array("src", "dst")).alias("state"), "n")
    return ends.groupBy("state").agg(F.sum("n").alias("total")).where(F.col("total") > least)


def trimmed_with_prior(counts: DataFrame, alpha: float = DIRICHLET_ALPHA) -> DataFrame:
    """Counts of the active states with ``alpha`` in every cell. The cell grid is states squared, a small result."""
    states = active_states(counts).select("state")
    cells = states.select(F.col("state").alias("src"), F.lit(1).alias("_k")).join(states.select(F.col("state").alias("dst"), F.lit(1).alias("_k")), "_k").drop("_k")
    return cells.join(counts.select("src", "dst", "n"), ["src", "dst"], "left").select("src", "dst", (F.coalesce("n", F.lit(0)) + alpha).alias("n"))


def top_states(counts: DataFrame, k: int = 50) -> DataFrame:
    """The k states of the largest row plus column sums, ties by state."""
    return active_states(counts).orderBy(F.desc("total"), "state").limit(k)


def pruned(frames: DataFrame, tau: int, least_out: float = 0.0) -> DataFrame:
    """Frames whose states have outgoing counts, with dense labels ``label``; pruned states are null.

    As documented, pruning starts only if some state has no outgoing count; rows under ``least_out``
    then go as well. Counts are taken anew once; states that lose their only target then raise no error here
    but show up as zero rows.
    """
    n = transition_counts(frames, [tau]).groupBy(F.col("src").alias("state")).agg(F.sum("n").alias("out"))
    states = frames.where("state is not null").select("state").distinct().join(n, "state", "left").select("state", F.coalesce("out", F.lit(0)).alias("out"))
    fires = states.agg(F.min("out").alias("least")).first()
    keep = states.where(F.col("out") >= max(least_out, TINY)) if fires.least is not None and fires.least <= 0 else states
    label = keep.select("state", (F.dense_rank().over(Window.orderBy("state")) - 1).alias("label"))  # one row a state
    return frames.join(label, "state", "left")


def macro_lumped(matrix: DataFrame, pi: DataFrame, macro: DataFrame) -> DataFrame:
    """(src, dst, p) between macrostates: flows pi_i P_ij summed and row-normalised."""
    a, b = (macro.select(F.col("state").alias(c), F.col("macro").alias(f"{c}_m")) for c in ("src", "dst"))
    flow = matrix.select("src", "dst", "p").join(pi.select(F.col("state").alias("src"), "pi"), "src").join(a, "src").join(b, "dst")
    out = flow.groupBy(F.col("src_m").alias("src"), F.col("dst_m").alias("dst")).agg(F.sum(F.col("pi") * F.col("p")).alias("n"))
    return normalised(out, ("src",)).select("src", "dst", "p")


def macro_populations(pi: DataFrame, macro: DataFrame) -> DataFrame:
    """(macro, population) normalised to one."""
    out = pi.join(macro, "state").groupBy("macro").agg(F.sum("pi").alias("w"))
    return out.select("macro", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("population"))


def state_free_energies(pi: DataFrame, temperature: float = 300.0) -> DataFrame:
    """pi with -kT ln max(pi, 1e-12), the least shifted to 0."""
    f = -kt(temperature) * F.ln(F.greatest("pi", F.lit(TINY)))
    return pi.withColumn("_f", f).withColumn("free_energy", F.col("_f") - F.min("_f").over(Window.partitionBy())).drop("_f")


def effective_sample_size(df: DataFrame, weight: str) -> DataFrame:
    """(sum w)^2 / sum w^2 as ``ess``."""
    return df.agg((F.sum(weight) * F.sum(weight) / F.nullif(F.sum(F.col(weight) * F.col(weight)), F.lit(0.0))).alias("ess"))


def n_states(frames: DataFrame) -> DataFrame:
    """Largest non-negative integer state plus one, 0 without any."""
    return frames.where("state >= 0").agg(F.coalesce(F.max("state") + 1, F.lit(0)).alias("n_states"))


def median_count(counts: DataFrame) -> DataFrame:
    """Median of in plus out counts of the states that have any, cut to an integer."""
    return active_states(counts).agg(F.floor(F.percentile("total", 0.5)).cast("long").alias("median_count"))


def state_table(frames: DataFrame, temperature: float = 300.0) -> DataFrame:
    """State, count, population, free energy and the frame nearest the state's mean x (ties by trajectory and frame)."""
    own = frames.where("state is not null")
    mean = own.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))
    pick = own.join(mean, "state").groupBy("state", "n").agg(F.min(F.struct(F.round(F.abs(F.col("x") - F.col("mean_x")), 9).alias("d"), "traj_id", "frame")).alias("r"))
    pi = pick.withColumn("pi", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return state_free_energies(pi, temperature).select("state", "n", F.col("pi").alias("population"), "free_energy", F.col("r.traj_id").alias("rep_traj"), F.col("r.frame").alias("rep_frame"))


def collect_matrix(counts: DataFrame, states: list | None = None, value: str = "n"):
    """A dense numpy matrix of a small (src, dst, value) table, and its sorted states."""
    import numpy as np

    rows = counts.select("src", "dst", value).collect()  # at most states squared
    states = sorted({r.src for r in rows} | {r.dst for r in rows}) if states is None else states
    at = {s: i for i, s in enumerate(states)}
    out = np.zeros((len(states), len(states)))
    for r in rows:
        out[at[r.src], at[r.dst]] += r[value]
    return out, states


def matrix_table(spark: SparkSession, matrix, states: list, value: str = "p") -> DataFrame:
    """The non-zero cells of a small matrix as a table."""
    kind = "string" if states and isinstance(states[0], str) else "long"
    rows = [(states[i], states[j], float(matrix[i, j])) for i in range(len(states)) for j in range(len(states)) if matrix[i, j] != 0]
    return spark.createDataFrame(rows, f"src {kind}, dst {kind}, {value} double")
