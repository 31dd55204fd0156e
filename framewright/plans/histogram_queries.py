"""Queries on histograms, free energies, validation and moments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions.constants import kt
from framewright.functions.scalars import bin_index, inside_bin, is_finite, reweighting, rounded
from framewright.operators import histograms as H
from framewright.operators import reduction as R
from framewright.operators.quantiles import quantiles
from framewright.plans import matrix_sql as Q
from framewright.plans.registry import EV, query
from framewright.sources import frames as S

KT = "(0.00831446261815324 * 300)"


def hist(column: str, low: float, high: float, bins: int) -> str:
    return f"CAST(least(floor(({column} - {low}) / ({high} - {low}) * {bins}), {bins - 1}) AS INT)"


GRID = f"SELECT {hist('l_quantity', 1.0, 50.0, 10)} AS bx, {hist('l_discount', 0.0, 0.1, 10)} AS \"by\", l_tax AS w FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1"
RANGES = {"l_quantity": (1.0, 50.0), "l_discount": (0.0, 0.1)}


@query("pmf_1d", f"WITH h AS (SELECT {hist('value', 0.0, 500.0, 20)} AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1), p AS (SELECT bin, n, n / (sum(n) OVER () * 25) AS density FROM h), f AS (SELECT *, -{KT} * ln(density) AS f FROM p) SELECT bin, round(bin * 25.0, 6) AS lo, round((bin + 1) * 25.0, 6) AS hi, CAST(n AS BIGINT) AS n, round(density, 9) AS density, round(f - min(f) OVER (), 6) + 0.0 AS free_energy FROM f")
def pmf_1d(spark, d):
    out = H.pmf(S.table(spark, d, "events"), "value", 0.0, 500.0, 20)
    return out.select("bin", rounded(F.col("lo"), 6).alias("lo"), rounded(F.col("hi"), 6).alias("hi"), "n", rounded(F.col("density")).alias("density"), rounded(F.col("free_energy"), 6).alias("free_energy"))


@query("fes_2d_grid", f"WITH g AS ({GRID}), h AS (SELECT bx, \"by\", count(*) AS n FROM g GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER () AS p FROM h), f AS (SELECT *, CASE WHEN n >= 5 THEN -{KT} * ln(p) END AS f FROM p) SELECT bx, \"by\", CAST(n AS BIGINT) AS n, round(p, 9) AS p, round(f - min(f) OVER (), 6) + 0.0 AS free_energy FROM f")
def fes_2d_grid(spark, d):
    out = H.fes(S.table(spark, d, "lineitem"), "l_quantity", "l_discount", RANGES, (10, 10), least=5)
    return out.select("bx", "by", "n", rounded(F.col("p")).alias("p"), rounded(F.col("free_energy"), 6).alias("free_energy"))


@query("fes_weighted", f"WITH g AS ({GRID}), h AS (SELECT bx, \"by\", sum(w) AS n FROM g GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER () AS p FROM h), f AS (SELECT *, CASE WHEN p > 1e-12 THEN -{KT} * ln(p) END AS f FROM p) SELECT bx, \"by\", round(n, 4) + 0.0 AS n, round(f - min(f) OVER (), 6) + 0.0 AS free_energy FROM f")
def fes_weighted(spark, d):
    out = H.fes(S.table(spark, d, "lineitem"), "l_quantity", "l_discount", RANGES, (10, 10), weight="l_tax")
    return out.select("bx", "by", rounded(F.col("n"), 4).alias("n"), rounded(F.col("free_energy"), 6).alias("free_energy"))




@query("ramachandran_histogram", f"WITH {EV}, a AS (SELECT x / 80.0 AS u, lag(x / 80.0) OVER (PARTITION BY traj_id ORDER BY frame) AS v FROM ev), w AS (SELECT u + pi() - 2 * pi() * floor((u + pi()) / (2 * pi())) - pi() AS u, v + pi() - 2 * pi() * floor((v + pi()) / (2 * pi())) - pi() AS v FROM a WHERE v IS NOT NULL) SELECT CAST(least(floor((u + pi()) / (2 * pi()) * 12), 11) AS INT) AS bx, CAST(least(floor((v + pi()) / (2 * pi()) * 12), 11) AS INT) AS \"by\", CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL")
def ramachandran_histogram(spark, d):
    w = H.Window.partitionBy("traj_id").orderBy("frame")
    a = S.event_frames(spark, d).select((F.col("x") / 80.0).alias("phi"), F.lag(F.col("x") / 80.0).over(w).alias("psi")).where("psi is not null")
    whole = (-math.pi, math.pi)
    return H.fes(a, "phi", "psi", {"phi": whole, "psi": whole}, (12, 12), periodic=True).select("bx", "by", "n")


@query("fes_state_weighted", f"WITH {EV}, v AS (SELECT state, count(*) / (SELECT count(*) FROM ev) AS pi FROM ev GROUP BY 1), g AS (SELECT {hist('x', 0.0, 500.0, 40)} AS bin, pi FROM ev JOIN v USING (state) WHERE x BETWEEN 0 AND 500), h AS (SELECT bin, sum(pi) AS n FROM g GROUP BY 1) SELECT bin, round(n / sum(n) OVER (), 9) AS p FROM h")
def fes_state_weighted(spark, d):
    from framewright.plans.count_queries import populations

    f = S.event_frames(spark, d)
    h = H.histogram(f.join(populations(f), "state"), "x", 0.0, 500.0, 40, "pi")
    return h.select("bin", rounded(F.col("n") / F.sum("n").over(H.whole())).alias("p"))


@query("fes_minima", f"WITH g AS ({GRID}), c AS (SELECT bx, \"by\", count(*) AS n FROM g GROUP BY ALL), f AS (SELECT bx, \"by\", round(-ln(n), 9) AS v FROM c), a AS (SELECT f.bx, f.\"by\", f.v, count(*) AS k, min(o.v) AS low, max(o.v) AS top FROM f JOIN f o ON abs(f.bx - o.bx) <= 1 AND abs(f.\"by\" - o.\"by\") <= 1 GROUP BY 1, 2, 3) SELECT bx, \"by\", v AS free_energy FROM a WHERE k = 9 AND v = low AND top > v AND bx BETWEEN 1 AND 8 AND \"by\" BETWEEN 1 AND 8")
def fes_minima(spark, d):
    cells = H.fes(S.table(spark, d, "lineitem"), "l_quantity", "l_discount", RANGES, (10, 10)).select("bx", "by", rounded(-F.ln("n")).alias("free_energy"))
    return H.local_minima(cells, (10, 10))


@query("coverage_2d", f"WITH g AS ({GRID}) SELECT round(count(DISTINCT bx * 10 + \"by\") / 100, 9) AS coverage FROM g")
def coverage_2d(spark, d):
    return H.coverage(S.table(spark, d, "lineitem"), "l_quantity", "l_discount", RANGES, 10).select(rounded(F.col("coverage")).alias("coverage"))


@query("kl_histograms", f"WITH b AS (SELECT event_type, {hist('value', 0.0, 500.0, 25)} AS bin FROM events WHERE value BETWEEN 0 AND 500), p AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM b WHERE event_type = 'click' GROUP BY 1), q AS (SELECT bin, count(*) / sum(count(*)) OVER () AS q FROM b WHERE event_type = 'view' GROUP BY 1), j AS (SELECT coalesce(p, 0) + 1e-12 AS p, coalesce(q, 0) + 1e-12 AS q FROM p FULL JOIN q USING (bin)), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM j) SELECT round(sum(p * ln(p / q)), 7) + 0.0 AS kl FROM n")
def kl_histograms(spark, d):
    e = S.table(spark, d, "events")
    h = lambda s: H.histogram(e.where(F.col("event_type") == s), "value", 0.0, 500.0, 25)
    return H.kl_divergence(h("click"), h("view")).select(rounded(F.col("kl"), 7).alias("kl"))


@query("kde_grid", f"WITH b AS (SELECT {hist('l_quantity', 1.0, 50.0, 10)} AS bx, {hist('l_discount', 0.0, 0.1, 10)} AS \"by\" FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1), c AS (SELECT bx + 0.5 AS x, \"by\" + 0.5 AS y, count(*) AS w FROM b GROUP BY ALL), g AS (SELECT u.i + 0.5 AS gx, v.i + 0.5 AS gy FROM (SELECT unnest(range(0, 10)) AS i) u, (SELECT unnest(range(0, 10)) AS i) v) SELECT gx, gy, round(sum(w * exp(-((gx - x) ** 2 + (gy - y) ** 2) / 2) / (2 * pi())) / sum(w), 9) AS density FROM g, c GROUP BY ALL")
def kde_grid(spark, d):
    cells = H.fes(S.table(spark, d, "lineitem"), "l_quantity", "l_discount", RANGES, (10, 10)).select((F.col("bx") + 0.5).alias("x"), (F.col("by") + 0.5).alias("y"), F.col("n").alias("w"))
    axis = spark.range(10).select((F.col("id") + F.lit(0.5).cast("double")).alias("g"))
    points = axis.select(F.col("g").alias("gx"), F.explode(F.array(*[F.lit(i + 0.5) for i in range(10)])).alias("gy"))
    return H.kernel_density(spark, cells, points, 1.0).withColumn("density", rounded(F.col("density")))


@query("frames_in_minimum", f"WITH {EV}, b AS (SELECT traj_id, frame, {hist('x', 0.0, 500.0, 10)} AS bx FROM ev WHERE x BETWEEN 0 AND 500) SELECT traj_id, CAST(frame AS BIGINT) AS frame, bx FROM b WHERE bx = 3")
def frames_in_minimum(spark, d):
    f = S.event_frames(spark, d).select("traj_id", "frame", inside_bin(F.col("x"), 0.0, 500.0, 10).alias("bx"), F.lit(0).alias("by"))
    return H.frames_near(f, spark.createDataFrame([(3, 0)], "bx int, by int")).select("traj_id", "frame", "bx")


@query("adaptive_fes", Q.adaptive_grid(KT))
def adaptive_fes(spark, d):
    """Adaptive grid over two value columns, its ranges exact quantiles."""
    out = H.adaptive_bins(S.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", (16, 16))[2]
    return out.select("bx", "by", "n", rounded(F.col("p")).alias("p"), rounded(F.col("free_energy"), 6).alias("free_energy"))


@query("column_quantiles", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", quantile_cont(CAST({c} AS DOUBLE), {p}) AS value, CAST({p} AS DOUBLE) AS probability FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax") for p in (0.01, 0.25, 0.5, 0.99)).replace("quantile_cont(", "round(quantile_cont(").replace(") AS value", "), 6) AS value"))
def column_quantiles(spark, d):
    """Exact quantiles of three columns, found together."""
    ps = [0.01, 0.25, 0.5, 0.99]
    found = quantiles(S.table(spark, d, "lineitem"), {c: ps for c in ("l_quantity", "l_extendedprice", "l_tax")})
    rows = [(c, p, float(v)) for c, values in found.items() for p, v in zip(ps, values, strict=True)]
    return spark.createDataFrame(rows, "column string, probability double, value double").withColumn("value", rounded(F.col("value"), 6))


@query("fes_smoothed", Q.smoothed(GRID, KT))
def fes_smoothed(spark, d):
    """Blurred surface of the fixed grid."""
    grid = H.grid_of(H.fes(S.table(spark, d, "lineitem"), "l_quantity", "l_discount", RANGES, (10, 10)), (10, 10))
    f = H.smoothed_fes(H.sparse_bin_repair(grid, 5))
    return spark.createDataFrame([(i, j, float(f[i, j])) for i in range(10) for j in range(10) if math.isfinite(f[i, j])], "bx int, by int, free_energy double").withColumn("free_energy", rounded(F.col("free_energy"), 6))


@query("fes_uncertainty", Q.uncertainty(GRID))
def fes_uncertainty(spark, d):
    """Standard deviation of each cell's free energy in kT."""
    grid = H.grid_of(H.fes(S.table(spark, d, "lineitem"), "l_quantity", "l_discount", RANGES, (10, 10)), (10, 10))
    sd = H.uncertainty(grid)
    return spark.createDataFrame([(i, j, float(sd[i, j])) for i in range(10) for j in range(10)], "bx int, by int, sd double").withColumn("sd", rounded(F.col("sd"), 3))


@query("sign_changes", f"WITH {EV}, s AS (SELECT traj_id, sign(x - 250) AS s, lag(sign(x - 250)) OVER (PARTITION BY traj_id ORDER BY frame) AS b FROM ev) SELECT traj_id, CAST(sum(CASE WHEN s <> b THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM s GROUP BY 1")
def sign_changes(spark, d):
    return H.sign_changes(S.event_frames(spark, d).withColumn("x", F.col("x") - 250), "x")


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("validate_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n_finite, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max, CAST(NULL AS VARCHAR) AS error FROM lineitem" for c in COLS) + " UNION ALL SELECT 'flat', CAST(count(*) AS BIGINT), 1.0, 0.0, 1.0, 1.0, 'cv_zero_std' FROM lineitem")
def validate_columns(spark, d):
    out = R.validated(S.table(spark, d, "lineitem").withColumn("flat", F.lit(1.0)), [*COLS, "flat"])
    return out.withColumn("mean", rounded(F.col("mean"), 6)).withColumn("std", rounded(F.col("std"), 6))


@query("finite_rows", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN l_discount = 0 THEN 0 ELSE 1 END) AS BIGINT) AS finite FROM lineitem")
def finite_rows(spark, d):
    x = F.try_divide(F.lit(1.0), F.col("l_discount"))
    return S.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum(is_finite(x).cast("long")).alias("finite"))


@query("zscore_columns", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS l_quantity, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) + 0.0 AS l_tax FROM lineitem")
def zscore_columns(spark, d):
    out = R.standardised(S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return out.withColumn("l_quantity", rounded(F.col("l_quantity"), 6)).withColumn("l_tax", rounded(F.col("l_tax"), 6))


@query("variance_top2", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(var_pop({c}), 3) AS variance FROM lineitem" for c in COLS) + ") ORDER BY variance DESC LIMIT 2")
def variance_top2(spark, d):
    return R.highest_variance(S.table(spark, d, "lineitem"), COLS).select("column", rounded(F.col("variance"), 3).alias("variance"))


@query("autocorrelation_curve", f"WITH {EV}, z AS (SELECT traj_id, frame, (x - avg(x) OVER (PARTITION BY traj_id)) / nullif(stddev_pop(x) OVER (PARTITION BY traj_id), 0) AS z FROM ev), p AS (" + " UNION ALL ".join(f"SELECT {t} AS tau, z * lead(z, {t}) OVER (PARTITION BY traj_id ORDER BY frame) AS v FROM z" for t in (1, 2, 5, 10)) + ") SELECT CAST(tau AS INT) AS tau, round(avg(v), 9) + 0.0 AS rho FROM p WHERE v IS NOT NULL GROUP BY tau")
def autocorrelation_curve(spark, d):
    return R.autocorrelation(S.event_frames(spark, d), "x", [1, 2, 5, 10]).withColumn("rho", rounded(F.col("rho")))


@query("vamp2_proxy", f"WITH {EV}, p AS (SELECT x, lead(x, 3) OVER (PARTITION BY traj_id ORDER BY frame) AS y FROM ev) SELECT round(corr(x, y) ** 2, 9) AS score FROM p WHERE y IS NOT NULL")
def vamp2_proxy(spark, d):
    return R.vamp2_proxy(S.event_frames(spark, d), ["x"], 3).select(rounded(F.col("score")).alias("score"))


@query("lagged_covariance", f"WITH {EV}, p AS (SELECT x, lead(x, 3) OVER (PARTITION BY traj_id ORDER BY frame) AS y FROM ev) SELECT CAST(count(*) AS BIGINT) AS n, round(covar_pop(x, x), 5) AS c00, round(covar_pop(x, y), 5) AS c0t, round(covar_pop(y, y), 5) AS ctt FROM p WHERE y IS NOT NULL")
def lagged_covariance(spark, d):
    n, _, _, a, b, c = R.lagged_moments(S.event_frames(spark, d), ["x"], 3)
    return spark.createDataFrame([(n, float(a[0, 0]), float(b[0, 0]), float(c[0, 0]))], "n long, c00 double, c0t double, ctt double").select("n", *[rounded(F.col(x), 5).alias(x) for x in ("c00", "c0t", "ctt")])


@query("moving_vamp2", f"WITH {EV}, p AS (SELECT traj_id, frame, lag(x, 1) OVER (PARTITION BY traj_id ORDER BY frame) AS a, x AS b FROM ev), w AS (SELECT traj_id, frame, count(a) OVER v AS n, CASE WHEN count(a) OVER v > 1 THEN corr(a, b) OVER v END AS r FROM p WINDOW v AS (PARTITION BY traj_id ORDER BY frame ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT traj_id, CAST(frame AS BIGINT) AS frame, round(r * r, 6) + 0.0 AS score FROM w")
def moving_vamp2(spark, d):
    return R.moving_vamp2(S.event_frames(spark, d), "x", 1, 20).withColumn("score", rounded(F.col("score"), 6))


@query("reweighting_factors", f"WITH {EV} SELECT traj_id, CAST(frame AS BIGINT) AS frame, round(exp((x - max(x) OVER (PARTITION BY traj_id)) / {KT}), 9) AS w FROM ev")
def reweighting_factors(spark, d):
    w = H.Window.partitionBy("traj_id")
    return S.event_frames(spark, d).select("traj_id", "frame", rounded(reweighting(F.col("x"), kt(), w)).alias("w"))


@query("grid_cells", f"SELECT CAST({hist('l_quantity', 1.0, 50.0, 7)} * 7 + {hist('l_tax', 0.0, 0.08, 7)} AS BIGINT) AS cell, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def grid_cells(spark, d):
    from framewright.operators.clustering import grid_cells as cells

    return cells(S.table(spark, d, "lineitem"), ["l_quantity", "l_tax"], {"l_quantity": (1.0, 50.0), "l_tax": (0.0, 0.08)}, 7).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("digitised_values", f"SELECT event_id, {hist('greatest(least(value, 400.0), 100.0)', 100.0, 400.0, 30)} AS bin FROM events")
def digitised_values(spark, d):
    return S.table(spark, d, "events").select("event_id", bin_index(F.col("value"), 100.0, 400.0, 30).alias("bin"))
