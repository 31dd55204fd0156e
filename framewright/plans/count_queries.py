"""Queries on scans, segments, pairs, counts, runs and occupancies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalars import rounded
from framewright.operators import counts as C
from framewright.operators import pairs as P
from framewright.plans.registry import EV, query
from framewright.sources import frames as S

TAUS = [1, 2, 5, 10]
#: Pairs of several lags in SQL.
MULTI = f"WITH {EV}, p AS (SELECT t.tau, e.* FROM (" + " UNION ALL ".join(f"SELECT traj_id, frame, x, state AS src, lead(state, {t}) OVER (PARTITION BY traj_id ORDER BY frame) AS dst, {t} AS tau_ FROM ev" for t in TAUS) + ") e, (SELECT unnest([1, 2, 5, 10]) AS tau) t WHERE t.tau = e.tau_ AND dst IS NOT NULL)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return S.event_frames(spark, d)


def with_holes(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose purchases are invalid states."""
    return events(spark, d).withColumn("state", F.when(F.col("state") != "purchase", F.col("state")))


HOLED = f"WITH {EV}, h AS (SELECT traj_id, frame, x, CASE WHEN state <> 'purchase' THEN state END AS state FROM ev)"


@query("frame_scan", f"WITH {EV} SELECT traj_id, CAST(frame AS BIGINT) AS frame, state FROM ev WHERE frame >= 5 AND frame < 40 AND (frame - 5) % 3 = 0")
def frame_scan(spark, d):
    return S.scan(events(spark, d), 5, 40, 3).select("traj_id", "frame", "state")


@query("trajectory_lengths", "SELECT user_id AS traj_id, CAST(count(*) AS BIGINT) AS n_frames FROM events GROUP BY user_id")
def trajectory_lengths(spark, d):
    return S.probe_length(S.table(spark, d, "events").select(F.col("user_id").alias("traj_id")))


@query("last_frames", f"WITH {EV} SELECT traj_id, CAST(max(frame) AS BIGINT) AS frame, arg_max(state, frame) AS state, arg_max(x, frame) AS x FROM ev GROUP BY traj_id")
def last_frames(spark, d):
    return S.last_frames(events(spark, d).drop("event_id"))


@query("transition_matrix_tau", f"WITH {EV}, p AS (SELECT state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev), c AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL) SELECT src, dst, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY src), 9) AS p FROM c")
def transition_matrix_tau(spark, d):
    return C.normalised(C.transition_counts(events(spark, d), [5])).select("src", "dst", "n", rounded(F.col("p")).alias("p"))


@query("transition_counts_tau", f"WITH {EV}, p AS (SELECT state AS src, lead(state, 3) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev) SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL")
def transition_counts_tau(spark, d):
    return C.transition_counts(events(spark, d), [3]).select("src", "dst", "n")


@query("transition_counts_multilag", f"{MULTI} SELECT CAST(tau AS INT) AS tau, src, dst, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL")
def transition_counts_multilag(spark, d):
    return C.transition_counts(events(spark, d), TAUS)


@query("transition_counts_strided", f"{MULTI} SELECT CAST(tau AS INT) AS tau, src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE frame % tau = 0 GROUP BY ALL")
def transition_counts_strided(spark, d):
    return C.transition_counts(events(spark, d), TAUS, mode="strided")


@query("transition_counts_weighted", f"{MULTI} SELECT CAST(tau AS INT) AS tau, src, dst, round(sum(x), 4) + 0.0 AS n FROM p GROUP BY ALL")
def transition_counts_weighted(spark, d):
    return C.transition_counts(events(spark, d), TAUS, weight="x").select("tau", "src", "dst", rounded(F.col("n"), 4).alias("n"))


@query("transition_counts_drop_pairs", f"{HOLED}, p AS (SELECT state AS src, lead(state, 2) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM h) SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL")
def transition_counts_drop_pairs(spark, d):
    return C.transition_counts(with_holes(spark, d), [2]).select("src", "dst", "n")


@query("transition_counts_split", f"{HOLED}, v AS (SELECT *, frame - row_number() OVER (PARTITION BY traj_id ORDER BY frame) AS seg FROM h WHERE state IS NOT NULL), p AS (SELECT state AS src, lead(state, 2) OVER (PARTITION BY traj_id, seg ORDER BY frame) AS dst FROM v) SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL")
def transition_counts_split(spark, d):
    return C.transition_counts(with_holes(spark, d), [2], gap_policy="split").select("src", "dst", "n")


@query("transition_counts_compact", f"{HOLED}, p AS (SELECT state AS src, lead(state, 2) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM h WHERE state IS NOT NULL) SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL")
def transition_counts_compact(spark, d):
    return C.transition_counts(with_holes(spark, d), [2], gap_policy="compact").select("src", "dst", "n")


@query("conversation_transitions", "WITH p AS (SELECT role AS src, lead(role, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) SELECT src, dst, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 9) AS p FROM p WHERE dst IS NOT NULL GROUP BY src, dst")
def conversation_transitions(spark, d):
    return C.normalised(C.transition_counts(S.conversation_frames(spark, d), [1])).select("src", "dst", "n", rounded(F.col("p")).alias("p"))


@query("segments_valid_runs", f"{HOLED}, v AS (SELECT *, frame - row_number() OVER (PARTITION BY traj_id ORDER BY frame) AS seg FROM h WHERE state IS NOT NULL) SELECT traj_id, CAST(min(frame) AS BIGINT) AS start, CAST(max(frame) + 1 AS BIGINT) AS stop, CAST(count(*) AS BIGINT) AS length FROM v GROUP BY traj_id, seg")
def segments_valid_runs(spark, d):
    runs = P.valid_runs(with_holes(spark, d), F.col("state").isNotNull())
    return runs.groupBy("traj_id", "seg_id").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.count(F.lit(1)).alias("length")).drop("seg_id")


@query("lagged_pairs", f"WITH {EV}, p AS (SELECT traj_id, frame, x AS x_0, lead(x, 4) OVER (PARTITION BY traj_id ORDER BY frame) AS x_t FROM ev) SELECT traj_id, CAST(frame AS BIGINT) AS frame, CAST(4 AS INT) AS tau, x_0, x_t FROM p WHERE x_t IS NOT NULL")
def lagged_pairs(spark, d):
    return P.lagged_pairs(events(spark, d), 4, ["x"])


@query("multi_lag_pair_counts", f"{MULTI} SELECT traj_id, CAST(tau AS INT) AS tau, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL")
def multi_lag_pair_counts(spark, d):
    return P.multi_lag_pairs(events(spark, d), TAUS, "state").groupBy("traj_id", "tau").agg(F.count(F.lit(1)).alias("n"))


@query("expected_vs_counted_pairs", f"{MULTI}, l AS (SELECT user_id AS traj_id, count(*) AS n FROM events GROUP BY 1), e AS (SELECT tau, sum(CASE WHEN n > tau THEN n - tau ELSE 0 END) AS expected FROM l, (SELECT unnest([1, 2, 5, 10]) AS tau) GROUP BY tau), c AS (SELECT tau, count(*) AS counted FROM p GROUP BY tau) SELECT CAST(e.tau AS INT) AS tau, CAST(expected AS BIGINT) AS expected, CAST(coalesce(counted, 0) AS BIGINT) AS counted FROM e LEFT JOIN c USING (tau)")
def expected_vs_counted_pairs(spark, d):
    lengths = S.probe_length(events(spark, d))
    rows = lengths.select("n_frames", F.explode(F.array(*map(F.lit, TAUS))).alias("tau"))
    expected = rows.groupBy("tau").agg(F.sum(P.expected_pairs(F.col("n_frames"), F.col("tau"))).alias("expected"))
    counted = C.transition_counts(events(spark, d), TAUS).groupBy("tau").agg(F.sum("n").alias("counted"))
    return expected.join(counted, "tau", "left").select("tau", "expected", F.coalesce("counted", F.lit(0)).alias("counted"))


@query("pair_diagnostics", "WITH l AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT * FROM l, (SELECT unnest([1, 2, 5, 10, 50]) AS tau)) SELECT CAST(tau AS INT) AS tau, CAST(sum(CASE WHEN n > tau THEN n - tau ELSE 0 END) AS BIGINT) AS usable, CAST(sum(n - 1) AS BIGINT) AS possible, CAST(sum(CASE WHEN n <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS short, round(sum(CASE WHEN n > tau THEN n - tau ELSE 0 END) / nullif(sum(n - 1), 0), 9) AS coverage FROM r GROUP BY tau")
def pair_diagnostics(spark, d):
    out = P.pair_diagnostics(S.probe_length(events(spark, d)), [*TAUS, 50])
    return out.withColumn("coverage", rounded(F.col("coverage")))


@query("global_local_index", f"WITH {EV}, l AS (SELECT traj_id, count(*) AS n FROM ev GROUP BY 1), o AS (SELECT traj_id, sum(n) OVER (ORDER BY traj_id) - n AS off FROM l) SELECT traj_id, CAST(frame AS BIGINT) AS frame, CAST(off + frame AS BIGINT) AS global_frame FROM ev JOIN o USING (traj_id)")
def global_local_index(spark, d):
    return P.global_frames(events(spark, d)).select("traj_id", "frame", "global_frame")


@query("segment_range_join", f"WITH {EV}, l AS (SELECT traj_id, count(*) AS n FROM ev GROUP BY 1), o AS (SELECT traj_id, n, sum(n) OVER (ORDER BY traj_id) - n AS start FROM l), g AS (SELECT event_id * 3 AS g FROM events) SELECT CAST(g AS BIGINT) AS g, 'traj-' || traj_id AS path, CAST(100 + (g - start) * 5 AS BIGINT) AS local_frame FROM g JOIN o ON g >= start AND g < start + n")
def segment_range_join(spark, d):
    lengths = P.running_offsets(S.probe_length(events(spark, d)))
    segments = lengths.select(F.concat(F.lit("traj-"), F.col("traj_id")).alias("path"), F.col("offset").alias("start"), (F.col("offset") + F.col("n_frames")).alias("stop"), F.lit(100).alias("local_start"), F.lit(5).alias("local_stride"))
    return P.locate(S.table(spark, d, "events").select((F.col("event_id") * 3).alias("g")), segments)


@query("segment_expansion", "WITH l AS (SELECT user_id AS seg_id, count(*) AS n FROM events GROUP BY 1) SELECT 'train' AS split, CAST(seg_id AS BIGINT) AS seg_id, CAST(unnest(range(2, n, 7)) AS BIGINT) AS frame FROM l")
def segment_expansion(spark, d):
    lengths = S.probe_length(events(spark, d))
    return P.expand_segments(lengths.select(F.lit("train").alias("split"), F.col("traj_id").alias("seg_id"), F.lit(2).cast("long").alias("start"), F.col("n_frames").alias("stop"), F.lit(7).cast("long").alias("stride")))


@query("gathered_pairs", f"WITH {EV}, l AS (SELECT traj_id, count(*) AS n FROM ev GROUP BY 1), o AS (SELECT traj_id, sum(n) OVER (ORDER BY traj_id) - n AS off FROM l), f AS (SELECT off + frame AS g, x FROM ev JOIN o USING (traj_id)), q AS (SELECT event_id AS i, event_id * 2 AS j FROM events WHERE event_id > 0) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, a.x AS x_i, b.x AS x_j FROM q JOIN f a ON a.g = i JOIN f b ON b.g = j")
def gathered_pairs(spark, d):
    pairs = S.table(spark, d, "events").where("event_id > 0").select(F.col("event_id").alias("i"), (F.col("event_id") * 2).alias("j"))
    return P.gathered_pairs(P.global_frames(events(spark, d)), pairs, "x").select("i", "j", "x_i", "x_j")


@query("state_visits", "SELECT event_type AS state, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) + 0.0 AS weight FROM events GROUP BY event_type")
def state_visits(spark, d):
    f = events(spark, d)
    return C.visits(f).join(C.visits(f, "x").withColumnRenamed("n", "weight"), "state").withColumn("weight", rounded(F.col("weight"), 4))


@query("state_visits_filled", "WITH s AS (SELECT unnest(range(0, 12)) AS state), v AS (SELECT label AS state, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(state AS INT) AS state, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN v USING (state)")
def state_visits_filled(spark, d):
    f = S.table(spark, d, "embeddings").select(F.col("label").alias("state"))
    return C.visits(f, states=spark.range(12).select(F.col("id").cast("int").alias("state")))


@query("occupancy_tail", "SELECT p_type AS state, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1 ORDER BY n, state LIMIT 10")
def occupancy_tail(spark, d):
    return C.occupancy_tail(C.visits(S.table(spark, d, "part").select(F.col("p_type").alias("state"))))


@query("diag_mass", f"{MULTI}, c AS (SELECT tau, src, dst, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY tau, src) AS p FROM c) SELECT CAST(tau AS INT) AS tau, round(sum(CASE WHEN src = dst THEN p ELSE 0 END) / 5, 9) AS diag_mass FROM q GROUP BY tau")
def diag_mass(spark, d):
    return C.diagonal_mass(C.normalised(C.transition_counts(events(spark, d), TAUS)), 5).withColumn("diag_mass", rounded(F.col("diag_mass")))


@query("zero_row_states", f"WITH {EV}, p AS (SELECT x, lead(x, 1) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev) SELECT CAST(floor(x) AS BIGINT) AS state FROM ev EXCEPT SELECT CAST(floor(x) AS BIGINT) FROM p WHERE dst IS NOT NULL")
def zero_row_states(spark, d):
    f = events(spark, d).withColumn("state", F.floor("x"))
    return C.zero_rows(C.transition_counts(f, [1]), f.select("state").distinct())


@query("trimmed_counts_alpha", f"WITH {EV}, p AS (SELECT state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev), c AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL), s AS (SELECT src AS s FROM c UNION SELECT dst FROM c) SELECT a.s AS src, b.s AS dst, round(CAST(coalesce(n, 0) + 0.001 AS DOUBLE), 6) AS n FROM s a CROSS JOIN s b LEFT JOIN c ON c.src = a.s AND c.dst = b.s")
def trimmed_counts_alpha(spark, d):
    return C.trimmed_with_prior(C.transition_counts(events(spark, d), [5])).select("src", "dst", rounded(F.col("n"), 6).alias("n"))


@query("top_states", f"WITH {EV}, p AS (SELECT state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev), e AS (SELECT src AS state FROM p WHERE dst IS NOT NULL UNION ALL SELECT dst FROM p WHERE dst IS NOT NULL) SELECT state, CAST(count(*) AS BIGINT) AS total FROM e GROUP BY 1 ORDER BY total DESC, state LIMIT 3")
def top_states(spark, d):
    return C.top_states(C.transition_counts(events(spark, d), [5]), 3)


@query("pruned_labels", f"WITH {EV}, f AS (SELECT traj_id, frame, CAST(floor(x / 5) AS BIGINT) AS state FROM ev), p AS (SELECT state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM f), o AS (SELECT src, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT state FROM f), a AS (SELECT state, coalesce(n, 0) AS n FROM s LEFT JOIN o ON src = state), k AS (SELECT state FROM a WHERE (SELECT min(n) FROM a) > 0 OR n >= 60), l AS (SELECT state, dense_rank() OVER (ORDER BY state) - 1 AS label FROM k) SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(label AS INT) AS label FROM f LEFT JOIN l USING (state)) GROUP BY 1")
def pruned_labels(spark, d):
    f = events(spark, d).withColumn("state", F.floor(F.col("x") / 5))
    return C.pruned(f, 5, 60).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("dwell_time_stats", f"WITH {EV}, r AS (SELECT traj_id, state, frame - row_number() OVER (PARTITION BY traj_id, state ORDER BY frame) AS g FROM ev), l AS (SELECT state, count(*) AS len FROM r GROUP BY traj_id, state, g) SELECT state, CAST(count(*) AS BIGINT) AS n_runs, CAST(min(len) AS BIGINT) AS min_len, CAST(max(len) AS BIGINT) AS max_len, round(avg(len), 9) AS mean_len, quantile_cont(len, 0.5) AS median_len FROM l GROUP BY state")
def dwell_time_stats(spark, d):
    return C.dwell_stats(events(spark, d)).withColumn("mean_len", rounded(F.col("mean_len")))


@query("dwell_time_merged", f"{HOLED}, v AS (SELECT traj_id, state, row_number() OVER (PARTITION BY traj_id ORDER BY frame) AS k FROM h WHERE state IS NOT NULL), r AS (SELECT traj_id, state, k - row_number() OVER (PARTITION BY traj_id, state ORDER BY k) AS g FROM v), l AS (SELECT state, count(*) AS len FROM r GROUP BY traj_id, state, g) SELECT state, CAST(count(*) AS BIGINT) AS n_runs, CAST(min(len) AS BIGINT) AS min_len, CAST(max(len) AS BIGINT) AS max_len, round(avg(len), 9) AS mean_len, quantile_cont(len, 0.5) AS median_len FROM l GROUP BY state")
def dwell_time_merged(spark, d):
    return C.dwell_stats(with_holes(spark, d), merge_gaps=True).withColumn("mean_len", rounded(F.col("mean_len")))


PI = "v AS (SELECT state, count(*) / (SELECT count(*) FROM ev) AS pi FROM ev GROUP BY state)"


def populations(frames: DataFrame) -> DataFrame:
    n = C.visits(frames)
    return n.select("state", (F.col("n") / F.sum("n").over(C.Window.partitionBy())).alias("pi"))


def macro_of(frames: DataFrame) -> DataFrame:
    return frames.select("state").distinct().select("state", (F.ascii("state") % 2).alias("macro"))


@query("macro_populations", f"WITH {EV}, {PI} SELECT CAST(ascii(state) % 2 AS INT) AS macro, round(sum(pi), 9) AS population FROM v GROUP BY 1")
def macro_populations(spark, d):
    f = events(spark, d)
    return C.macro_populations(populations(f), macro_of(f)).withColumn("population", rounded(F.col("population")))


@query("macro_lumped_matrix", f"WITH {EV}, {PI}, p AS (SELECT state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev), c AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL), t AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM c), g AS (SELECT ascii(src) % 2 AS src, ascii(dst) % 2 AS dst, sum(pi * p) AS w FROM t JOIN v ON v.state = t.src GROUP BY 1, 2) SELECT CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM g")
def macro_lumped_matrix(spark, d):
    f = events(spark, d)
    m = C.normalised(C.transition_counts(f, [5]))
    return C.macro_lumped(m, populations(f), macro_of(f)).withColumn("p", rounded(F.col("p")))


@query("state_free_energy", f"WITH {EV}, {PI}, f AS (SELECT state, pi, -0.00831446261815324 * 300 * ln(greatest(pi, 1e-12)) AS f FROM v) SELECT state, round(pi, 9) AS pi, round(f - min(f) OVER (), 6) + 0.0 AS free_energy FROM f")
def state_free_energy(spark, d):
    out = C.state_free_energies(populations(events(spark, d)))
    return out.select("state", rounded(F.col("pi")).alias("pi"), rounded(F.col("free_energy"), 6).alias("free_energy"))


@query("state_table", f"WITH {EV}, m AS (SELECT state, count(*) AS n, avg(x) AS mx FROM ev GROUP BY 1), r AS (SELECT e.state, n, traj_id, frame, row_number() OVER (PARTITION BY e.state ORDER BY round(abs(x - mx), 9), traj_id, frame) AS k FROM ev e JOIN m USING (state)), t AS (SELECT *, n / sum(n) OVER () AS pi FROM r WHERE k = 1), f AS (SELECT *, -0.00831446261815324 * 300 * ln(greatest(pi, 1e-12)) AS f FROM t) SELECT state, CAST(n AS BIGINT) AS n, round(pi, 9) AS population, round(f - min(f) OVER (), 6) + 0.0 AS free_energy, traj_id AS rep_traj, CAST(frame AS BIGINT) AS rep_frame FROM f")
def state_table(spark, d):
    out = C.state_table(events(spark, d))
    return out.withColumn("population", rounded(F.col("population"))).withColumn("free_energy", rounded(F.col("free_energy"), 6))


@query("ess", "SELECT round(sum(value) * sum(value) / sum(value * value), 4) AS ess FROM events")
def ess(spark, d):
    return C.effective_sample_size(S.table(spark, d, "events"), "value").select(rounded(F.col("ess"), 4).alias("ess"))


@query("infer_n_states", "SELECT CAST(max(label) + 1 AS INT) AS n_states FROM embeddings WHERE label >= 0")
def infer_n_states(spark, d):
    return C.n_states(S.table(spark, d, "embeddings").select(F.col("label").alias("state")))


@query("median_state_count", f"WITH {EV}, p AS (SELECT floor(x) AS src, lead(floor(x), 1) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev), e AS (SELECT src AS s FROM p WHERE dst IS NOT NULL UNION ALL SELECT dst FROM p WHERE dst IS NOT NULL), t AS (SELECT count(*) AS n FROM e GROUP BY s) SELECT CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_count FROM t")
def median_state_count(spark, d):
    f = events(spark, d).withColumn("state", F.floor("x"))
    return C.median_count(C.transition_counts(f, [1]))


@query("active_frames_compacted", f"{HOLED} SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY frame) - 1 AS BIGINT) AS frame, state FROM h WHERE state IS NOT NULL")
def active_frames_compacted(spark, d):
    return P.compacted(with_holes(spark, d), F.col("state").isNotNull()).select("traj_id", "frame", "state")


@query("split_union", "SELECT 'train' AS split, CAST(doc_id AS BIGINT) AS id, CAST(NULL AS INT) AS label FROM documents UNION ALL SELECT 'val', CAST(vec_id AS BIGINT), CAST(label AS INT) FROM embeddings")
def split_union(spark, d):
    a = S.table(spark, d, "documents").select(F.lit("train").alias("split"), F.col("doc_id").alias("id"))
    b = S.table(spark, d, "embeddings").select(F.lit("val").alias("split"), F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))
    return S.union_aligned([a, b])


@query("frame_weights", f"WITH {EV}, {PI} SELECT traj_id, CAST(frame AS BIGINT) AS frame, round(pi, 9) AS weight FROM ev JOIN v USING (state)")
def frame_weights(spark, d):
    f = events(spark, d)
    return f.join(populations(f), "state").select("traj_id", "frame", rounded(F.col("pi")).alias("weight"))


@query("label_contingency", "SELECT CAST(quality AS INT) AS quality, CAST(toxic AS INT) AS toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY ALL")
def label_contingency(spark, d):
    return S.table(spark, d, "labels").groupBy(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


@query("orders_as_trajectories", "WITH o AS (SELECT o_custkey, o_orderstatus AS src, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM o WHERE dst IS NOT NULL GROUP BY ALL")
def orders_as_trajectories(spark, d):
    o = S.numbered(S.table(spark, d, "orders").select(F.col("o_custkey").alias("traj_id"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("state")), "traj_id", ["o_orderdate", "o_orderkey"])
    return C.transition_counts(o, [1]).select("src", "dst", "n")


@query("transition_cube", f"WITH {EV}, p AS (SELECT state AS src, lead(state) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev) SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE dst IS NOT NULL GROUP BY CUBE (src, dst)")
def transition_cube(spark, d):
    """Extension: counts with all subtotals."""
    pairs = P.multi_lag_pairs(events(spark, d), [1], "state")
    return pairs.cube("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("train_val_split", f"WITH {EV} SELECT traj_id, CAST(sum(CASE WHEN pr < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS n_train, CAST(sum(CASE WHEN pr >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS n_val FROM (SELECT traj_id, percent_rank() OVER (PARTITION BY traj_id ORDER BY frame) AS pr FROM ev) GROUP BY traj_id")
def train_val_split(spark, d):
    w = C.Window.partitionBy("traj_id").orderBy("frame")
    f = events(spark, d).select("traj_id", F.percent_rank().over(w).alias("pr"))
    return f.groupBy("traj_id").agg(F.sum((F.col("pr") < 0.8).cast("long")).alias("n_train"), F.sum((F.col("pr") >= 0.8).cast("long")).alias("n_val"))


@query("pair_batches", f"WITH {EV}, n AS (SELECT sum(greatest(k - 1, 0)) AS n FROM (SELECT count(*) AS k FROM ev GROUP BY traj_id)) SELECT CAST(b AS BIGINT) AS batch, CAST(least(256, n - 256 * b) AS BIGINT) AS size FROM (SELECT n, unnest(range(0, CAST(ceil(n / 256) AS BIGINT))) AS b FROM n)")
def pair_batches(spark, d):
    """Seeded shuffle of pairs into batches of 256: batch and size."""
    from framewright.operators.workflow import exact_batches

    pairs = P.lagged_pairs(events(spark, d), 1, ["x"])
    return exact_batches(pairs, 256, 7, ["traj_id", "frame"]).groupBy("batch").agg(F.count(F.lit(1)).alias("size"))


@query("balanced_pairs", f"WITH {EV}, p AS (SELECT state, lead(frame) OVER (PARTITION BY traj_id ORDER BY frame) AS f FROM ev) SELECT state, CAST(least(150, count(*)) AS BIGINT) AS n FROM p WHERE f IS NOT NULL GROUP BY state")
def balanced_pairs(spark, d):
    """A hundred and fifty pairs of each source state: how many were drawn."""
    from framewright.operators.workflow import balanced_sample

    pairs = P.lagged_pairs(events(spark, d), 1, ["state"])
    return balanced_sample(pairs, "state_0", 150, 11, ["traj_id", "frame"]).groupBy(F.col("state_0").alias("state")).agg(F.count(F.lit(1)).alias("n"))
