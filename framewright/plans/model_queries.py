"""Queries on clustering, representatives, Markov models and transition paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import linalg
from framewright.functions.scalars import implied_timescale, rounded
from framewright.operators import clustering as K
from framewright.operators import counts as C
from framewright.operators import msm as M
from framewright.operators import reduction as R
from framewright.operators import representatives as P
from framewright.operators import tpt as T
from framewright.plans import matrix_sql as Q
from framewright.plans.registry import EV, query
from framewright.sources import frames as S

#: Three constant centres over all dimensions: corners of a small cube.
CENTRES = [[0.1 if (k >> j) % 2 == 0 else -0.1 for k in range(64)] for j in range(3)]


#: Columns of all components of a vector.
COMPONENTS = [f"x{i}" for i in range(64)]


def vectors(spark: SparkSession, d: str, width: int = 64) -> DataFrame:
    e = S.table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, width), lambda v: v.cast("double")).alias("x"))


def matrix(spark: SparkSession, d: str, tau: int = 5) -> DataFrame:
    return C.normalised(C.transition_counts(S.event_frames(spark, d), [tau])).select("src", "dst", "p")


def model(spark: SparkSession, d: str, tau: int = 5) -> M.MarkovModel:
    return M.markov_model(S.event_frames(spark, d), tau)


DIST = [f"list_sum(list_transform(range(0, 64), lambda i: (CAST(embedding[i + 1] AS DOUBLE) - CASE WHEN (i >> {j}) % 2 = 0 THEN 0.1 ELSE -0.1 END) ** 2))" for j in range(3)]
ASSIGN = f"a AS (SELECT vec_id, label, embedding, {DIST[0]} AS d0, {DIST[1]} AS d1, {DIST[2]} AS d2 FROM embeddings), s AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS state FROM a)"


@query("assign_nearest_center", f"WITH {ASSIGN} SELECT vec_id, CAST(state AS INT) AS state, round(least(d0, d1, d2), 9) AS distance FROM s")
def assign_nearest_center(spark, d):
    return K.nearest_centre(vectors(spark, d), "x", CENTRES).select("vec_id", "state", rounded(F.col("distance")).alias("distance"))


@query("lloyd_step", f"WITH {ASSIGN} SELECT CAST(state AS INT) AS state, CAST(k AS INT) AS k, round(avg(CAST(embedding[k + 1] AS DOUBLE)), 9) + 0.0 AS value, CAST(count(*) AS BIGINT) AS n FROM s, (SELECT unnest(range(0, 64)) AS k) GROUP BY ALL")
def lloyd_step(spark, d):
    return K.lloyd_step(vectors(spark, d), "x", CENTRES).withColumn("value", rounded(F.col("value")))


@query("k_means_states")
def k_means_states(spark, d):
    """MLlib k-means over all vectors: size of each state."""
    out, _, _ = K.k_means(vectors(spark, d), "x", 5)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("grid_discretize", "WITH b AS (SELECT vec_id, embedding[1] AS u, embedding[2] AS v, min(embedding[1]) OVER () AS a0, max(embedding[1]) OVER () AS a1, min(embedding[2]) OVER () AS b0, max(embedding[2]) OVER () AS b1 FROM embeddings), c AS (SELECT vec_id, least(floor((CAST(u AS DOUBLE) - a0) / (CAST(a1 AS DOUBLE) - a0) * 4), 3) * 4 + least(floor((CAST(v AS DOUBLE) - b0) / (CAST(b1 AS DOUBLE) - b0) * 4), 3) AS cell FROM b), f AS (SELECT *, min(vec_id) OVER (PARTITION BY cell) AS first FROM c) SELECT vec_id, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INT) AS state FROM f")
def grid_discretize(spark, d):
    flat = R.unpacked(vectors(spark, d, 2), "x", 2)
    return K.grid_states(flat, ["x0", "x1"], 16, "vec_id")[0].select("vec_id", "state")


@query("representatives_centroid", "WITH l AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), g AS (SELECT e.vec_id, e.label, round(sqrt(sum((CAST(e.embedding[l.i] AS DOUBLE) - m) ** 2)), 9) AS distance FROM embeddings e JOIN l ON l.label = e.label GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS k FROM g) SELECT label, CAST(k AS INT) AS rank, vec_id, distance FROM r WHERE k <= 3")
def representatives_centroid(spark, d):
    return P.closest_to_centroid(vectors(spark, d), "x", "label", "vec_id", 3).select("label", "rank", "vec_id", "distance")


@query("true_medoid", "WITH p AS (SELECT a.label, a.vec_id, round(sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS k FROM p) SELECT label, vec_id, score FROM r WHERE k = 1")
def true_medoid(spark, d):
    return P.medoids(vectors(spark, d), "x", "label", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("diverse_representatives", Q.spread_out(3))
def diverse_representatives(spark, d):
    return P.farthest_points(vectors(spark, d), "x", "label", "vec_id", 3).withColumn("score", rounded(F.col("score"), 6))


@query("frames_in_band", "SELECT DISTINCT event_type AS state FROM events WHERE value BETWEEN 100 AND 100.5")
def frames_in_band(spark, d):
    return T.states_in_range(S.event_frames(spark, d), "x", 100.0, 100.5)


@query("band_representatives", Q.spread_out(2, "label / 9.0 BETWEEN 0.4 AND 0.6"))
def band_representatives(spark, d):
    v = vectors(spark, d)
    q = v.select("label").distinct().select("label", (F.col("label") / 9.0).alias("q"))
    return P.from_band(v, q, "x", "label", "vec_id", k=2).withColumn("score", rounded(F.col("score"), 6))


@query("pca")
def pca(spark, d):
    f = R.unpacked(vectors(spark, d), "x", 64)
    return R.pca(f, COMPONENTS, 2).apply(f).select("vec_id", "ic0", "ic1")


def vector_frames(spark, d) -> DataFrame:
    return R.unpacked(vectors(spark, d), "x", 64).withColumnsRenamed({"label": "traj_id", "vec_id": "frame"})


@query("tica")
def tica(spark, d):
    f = vector_frames(spark, d)
    return R.tica(f, COMPONENTS, 1, 2).apply(f).select("traj_id", "frame", "ic0", "ic1")


@query("vamp")
def vamp(spark, d):
    f = vector_frames(spark, d)
    return R.vamp(f, COMPONENTS, 1, 2).apply(f).select("traj_id", "frame", "ic0", "ic1")


@query("vamp2_score")
def vamp2_score(spark, d):
    _, _, _, a, b, c = R.lagged_moments(vector_frames(spark, d), COMPONENTS, 1)
    return spark.createDataFrame([(linalg.vamp2_score(a, b, c),)], "score double")


@query("whiten")
def whiten(spark, d):
    f = R.unpacked(vectors(spark, d), "x", 64)
    return R.whitened(f, COMPONENTS).apply(f, "w").select("vec_id", *[f"w{i}" for i in range(64)])


@query("canonical_correlations")
def canonical_correlations(spark, d):
    f = R.unpacked(vectors(spark, d), "x", 64)
    rho = R.canonical_correlation(f, COMPONENTS[:32], COMPONENTS[32:])
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(rho)], "k int, rho double")


TM = f"{EV}, pr AS (SELECT state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev), ct AS (SELECT src, dst, count(*) AS n FROM pr WHERE dst IS NOT NULL GROUP BY ALL), t AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM ct)"


@query("power_iteration_pi", f"WITH {TM}, i0 AS (SELECT DISTINCT src AS state, 0.2 AS pi FROM t)" + "".join(f", i{k} AS (SELECT dst AS state, sum(pi * p) AS pi FROM t JOIN i{k - 1} ON src = state GROUP BY 1)" for k in range(1, 9)) + " SELECT state, round(pi, 9) AS pi FROM i8")
def power_iteration_pi(spark, d):
    return M.power_iteration(matrix(spark, d), 8).select("state", rounded(F.col("pi")).alias("pi"))


@query("matrix_power_ck", f"WITH {TM}, q2 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM t a JOIN t b ON a.dst = b.src GROUP BY ALL), q3 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM q2 a JOIN t b ON a.dst = b.src GROUP BY ALL) SELECT src, dst, round(p, 9) AS p FROM q3")
def matrix_power_ck(spark, d):
    return M.matrix_power(matrix(spark, d), 3).withColumn("p", rounded(F.col("p")))


@query("ck_rms_error", f"WITH {TM}, q2 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM t a JOIN t b ON a.dst = b.src GROUP BY ALL), pr2 AS (SELECT state AS src, lead(state, 10) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev), c2 AS (SELECT src, dst, count(*) AS n FROM pr2 WHERE dst IS NOT NULL GROUP BY ALL), t2 AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM c2) SELECT round(sqrt(avg((coalesce(q2.p, 0) - coalesce(t2.p, 0)) ** 2)), 9) AS error FROM q2 FULL JOIN t2 USING (src, dst)")
def ck_rms_error(spark, d):
    a = M.matrix_power(matrix(spark, d), 2)
    both = a.join(matrix(spark, d, 10).withColumnRenamed("p", "q"), ["src", "dst"], "full_outer")
    gap = F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    return both.agg(rounded(F.sqrt(F.avg(gap * gap))).alias("error"))


@query("ck_test", Q.chapman_kolmogorov())
def ck_test(spark, d):
    return M.ck_test(spark, S.event_frames(spark, d), 2).withColumn("mse", rounded(F.col("mse")))


@query("ck_choice")
def ck_choice(spark, d):
    """The same test on two macrostates if the spectrum parts them, else on the fifty most visited states."""
    return M.ck_choice(spark, S.event_frames(spark, d), 2, 2).withColumn("mse", rounded(F.col("mse")))


@query("stationary_distribution", Q.STATIONARY)
def stationary_distribution(spark, d):
    m = model(spark, d)
    return spark.createDataFrame([(str(s), float(p)) for s, p in zip(m.states, m.pi, strict=True)], "state string, pi double").withColumn("pi", rounded(F.col("pi")))


@query("mfpt", Q.PASSAGE)
def mfpt(spark, d):
    m = model(spark, d)
    return spark.createDataFrame([(str(s), str(m.states[k]), float(t)) for k in range(len(m.states)) for s, t in zip(m.states, linalg.mean_first_passage(m.p, [k]), strict=True)], "src string, dst string, mfpt double").withColumn("mfpt", rounded(F.col("mfpt"), 6))


@query("its")
def its(spark, d):
    return M.implied_timescales(spark, S.event_frames(spark, d), [1, 2, 5, 10])


@query("its_bayesian")
def its_bayesian(spark, d):
    """Intervals over 100 reversible models a lag, from effective counts."""
    return M.bayesian_timescales(spark, S.event_frames(spark, d), [1, 2, 5], samples=100)


@query("state_inefficiency")
def state_inefficiency(spark, d):
    """Statistical inefficiency of each state's indicator series."""
    from framewright.operators import posterior

    found = posterior.state_inefficiency(S.event_frames(spark, d), 32)
    return spark.createDataFrame(sorted((str(s), float(g)) for s, g in found.items()), "state string, inefficiency double").withColumn("inefficiency", rounded(F.col("inefficiency"), 6))


@query("posterior_populations")
def posterior_populations(spark, d):
    """Intervals of the stationary distribution over 100 reversible models."""
    from framewright.operators import posterior

    states, made = M.matrices(S.event_frames(spark, d), [5])
    return posterior.population_intervals(posterior.posterior_draws(spark, made, samples=100), states)


@query("timescale_transform", "WITH v AS (SELECT event_id, value / 500.0 AS l FROM events) SELECT event_id, round(CASE WHEN l > 0 AND l < 1 THEN -5 / ln(l) END, 9) AS timescale FROM v")
def timescale_transform(spark, d):
    return S.table(spark, d, "events").select("event_id", rounded(implied_timescale(F.col("value") / 500.0, 5)).alias("timescale"))


@query("pcca")
def pcca(spark, d):
    m = model(spark, d)
    of = linalg.macrostates(m.p, 2)
    return spark.createDataFrame([(str(s), int(c)) for s, c in zip(m.states, of, strict=True)], "state string, macro int")


@query("lag_selection")
def lag_selection(spark, d):
    return M.select_lag(spark, S.event_frames(spark, d), [1, 2, 5])[1]


@query("strong_components", Q.STRONG)
def strong_components(spark, d):
    c, states = C.collect_matrix(C.transition_counts(S.event_frames(spark, d), [5]))
    return spark.createDataFrame([(k, str(states[i])) for k, part in enumerate(linalg.strong_components(c > 0)) for i in part], "component int, state string")


GROSS = f"WITH {TM}, g AS (SELECT src, dst, p * ascii(src) / 100.0 AS flux FROM t WHERE src <> dst)"


def gross(spark, d) -> DataFrame:
    return matrix(spark, d).where("src <> dst").select("src", "dst", (F.col("p") * F.ascii("src") / 100.0).alias("flux"))


@query("net_flux", f"{GROSS} SELECT a.src, a.dst, round(a.flux - coalesce(b.flux, 0), 9) AS net FROM g a LEFT JOIN g b ON a.src = b.dst AND a.dst = b.src WHERE a.flux - coalesce(b.flux, 0) > 0")
def net_flux(spark, d):
    return T.net_flux(gross(spark, d)).withColumn("net", rounded(F.col("net")))


@query("state_flux", f"{GROSS} SELECT state, round(sum(flux), 9) AS flux FROM (SELECT src AS state, flux FROM g UNION ALL SELECT dst, flux FROM g) GROUP BY 1")
def state_flux(spark, d):
    return T.state_flux(gross(spark, d)).withColumn("flux", rounded(F.col("flux")))


@query("coarse_flux", f"{GROSS}, n AS (SELECT a.src, a.dst, a.flux - coalesce(b.flux, 0) AS net FROM g a LEFT JOIN g b ON a.src = b.dst AND a.dst = b.src WHERE a.flux - coalesce(b.flux, 0) > 0), c AS (SELECT ascii(src) % 2 AS src, ascii(dst) % 2 AS dst, sum(net) AS f FROM n WHERE ascii(src) % 2 <> ascii(dst) % 2 GROUP BY 1, 2) SELECT CAST(a.src AS INT) AS src, CAST(a.dst AS INT) AS dst, round(a.f - coalesce(b.f, 0), 9) AS net FROM c a LEFT JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.f - coalesce(b.f, 0) > 0")
def coarse_flux(spark, d):
    g = gross(spark, d)
    sets = g.select(F.col("src").alias("state")).distinct().select("state", (F.ascii("state") % 2).alias("set"))
    return T.coarse_flux(T.net_flux(g), sets).withColumn("net", rounded(F.col("net")))


@query("committor_classes", "WITH q AS (SELECT event_id AS state, value / 500.0 AS q FROM events) SELECT state, round(q, 9) AS q, CASE WHEN q <= 0.1 THEN 'source' WHEN q >= 0.9 THEN 'sink' ELSE 'transition' END AS kind, round(abs(q - 0.5), 12) BETWEEN 0 AND 0.05 AS tse FROM q")
def committor_classes(spark, d):
    q = S.table(spark, d, "events").select(F.col("event_id").alias("state"), (F.col("value") / 500.0).alias("q"))
    return T.classified(q).withColumn("q", rounded(F.col("q")))


@query("tpt_flux", Q.FLUX)
def tpt_flux(spark, d):
    m = model(spark, d)
    t = T.analyse(m.p, [0], [len(m.states) - 1], lag=5)
    return C.matrix_table(spark, t.net, [str(s) for s in m.states], "net").withColumn("net", rounded(F.col("net"))).where("net > 0")


@query("tpt_pathways")
def tpt_pathways(spark, d):
    m = model(spark, d)
    return T.paths_table(spark, T.analyse(m.p, [0], [len(m.states) - 1], lag=5), m.states)


@query("kis")
def kis(spark, d):
    m = model(spark, d)
    return spark.createDataFrame([(str(s), float(v)) for s, v in zip(m.states, T.kinetic_importance(m.p), strict=True)], "state string, importance double")


@query("trajectory_counts", f"WITH {EV}, p AS (SELECT traj_id, state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev) SELECT traj_id, src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL")
def trajectory_counts(spark, d):
    return T.trajectory_counts(S.event_frames(spark, d), 5)


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    """Intervals over 200 samples of all trajectories."""
    f = S.event_frames(spark, d)
    states = [r.state for r in f.select("state").distinct().orderBy("state").collect()]
    return T.bootstrap_paths(f, 5, states, [0], [len(states) - 1], draws=200)


@query("conformations")
def conformations(spark, d):
    return T.conformations(spark, S.event_frames(spark, d))


@query("markov_matrix", Q.MARKOV)
def markov_matrix(spark, d):
    m = model(spark, d)
    return C.matrix_table(spark, m.p, [str(s) for s in m.states]).withColumn("p", rounded(F.col("p")))


@query("analysis_debug")
def analysis_debug(spark, d):
    """Counts, components, coverage and warnings in one row."""
    from framewright.operators.workflow import diagnostics

    return diagnostics(spark, S.event_frames(spark, d), 5)


@query("discretized_dataset")
def discretized_dataset(spark, d):
    """Grid discretisation of two value columns with its count matrix."""
    from framewright.operators.workflow import discretise

    f = S.event_frames(spark, d).withColumn("split", F.when(F.col("traj_id") % 4 == 0, "val").otherwise("train")).withColumn("y", F.pmod("x", F.lit(50.0)))
    return discretise(f.drop("state"), ["x", "y"], n_states=16, lag=2, mode="grid").matrix


@query("complete_msm_analysis")
def complete_msm_analysis(spark, d):
    """TICA, k-means, lag choice and model over the vectors; the state table."""
    from framewright.operators.workflow import complete_analysis

    return complete_analysis(spark, vector_frames(spark, d), COMPONENTS, n_states=5, lags=(1, 2))["states"]


@query("hyperparameter_ensemble")
def hyperparameter_ensemble(spark, d):
    """Slowest timescale over lags and cluster numbers."""
    from framewright.operators.workflow import ensemble

    f = vectors(spark, d).select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame"), "x")
    return ensemble(spark, f, [1, 2], [3, 4])


@query("superposed_frames")
def superposed_frames(spark, d):
    """Frames rotated onto the first of their trajectory."""
    from framewright.operators.workflow import superposed
    from framewright.plans.scalar_queries import atom_frames

    f = atom_frames(spark, d, 21)
    least = f.groupBy("traj_id").agg(F.min("frame").alias("_f"))
    return superposed(f.join(least, "traj_id").withColumn("frame", F.col("frame") - F.col("_f")).drop("_f"))


@query("universal_embedding")
def universal_embedding(spark, d):
    """Geometry features reduced to one component."""
    from framewright.operators.workflow import universal_embedding as embed
    from framewright.plans.scalar_queries import atom_frames

    return embed(atom_frames(spark, d, 21), align=False)


@query("weighted_pair_sample")
def weighted_pair_sample(spark, d):
    """A thousand events drawn in proportion to their value, with replacement."""
    from framewright.operators.workflow import weighted_sample

    return weighted_sample(S.table(spark, d, "events"), "value", 1000, 7, ["event_id"])


@query("isolated_states", f"WITH {EV}, f AS (SELECT traj_id, frame, CAST(floor(x / 25) AS BIGINT) AS s FROM ev), p AS (SELECT s AS src, lead(s) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM f), c AS (SELECT DISTINCT src, dst FROM p WHERE dst IS NOT NULL) SELECT CAST(s AS BIGINT) AS state FROM (SELECT DISTINCT s FROM f) WHERE s NOT IN (SELECT src FROM c) OR s NOT IN (SELECT dst FROM c)")
def isolated_states(spark, d):
    """States that no transition enters or none leaves."""
    f = S.event_frames(spark, d).withColumn("state", F.floor(F.col("x") / 25))
    c = C.transition_counts(f, [1])
    both = c.select(F.col("src").alias("state")).intersect(c.select(F.col("dst").alias("state")))
    return f.select("state").distinct().exceptAll(both.distinct())
