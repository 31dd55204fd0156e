"""SQL of small matrix results: powers by squaring and series by doubling, for the oracles of the model queries."""

from __future__ import annotations

from framewright.plans.registry import EV

#: Counts at lag 5 with the prior in every cell, as the transition matrix t(src, dst, p) over the states st(s).
MODEL = f"""{EV}, pr AS (SELECT state AS src, lead(state, 5) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev),
ct AS (SELECT src, dst, count(*) AS n FROM pr WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL), st AS (SELECT src AS s FROM ct UNION SELECT dst FROM ct),
t AS MATERIALIZED (SELECT a.s AS src, b.s AS dst, (coalesce(n, 0) + 0.001) / sum(coalesce(n, 0) + 0.001) OVER (PARTITION BY a.s) AS p FROM st a CROSS JOIN st b LEFT JOIN ct ON ct.src = a.s AND ct.dst = b.s)"""


def stationary(rounds: int = 12) -> str:
    """Table expressions up to pi(s, pi): any row of the matrix's power 2^rounds."""
    steps = "".join(f", m{k + 1} AS MATERIALIZED (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM {f'm{k}' if k else 't'} a JOIN {f'm{k}' if k else 't'} b ON a.dst = b.src GROUP BY ALL)" for k in range(rounds))
    return f"{MODEL}{steps}, pi AS MATERIALIZED (SELECT dst AS s, avg(p) AS pi FROM m{rounds} GROUP BY 1)"


def series(rounds: int = 16) -> str:
    """From q0(g, i, j, p) and s0(g, i, v): v summed over all powers of q0 up to 2^rounds, as s<rounds>(g, i, v)."""
    return "".join(
        f", s{k + 1} AS MATERIALIZED (SELECT a.g, a.i, a.v + coalesce(b.v, 0) AS v FROM s{k} a LEFT JOIN (SELECT q.g, q.i, sum(q.p * s.v) AS v FROM q{k} q JOIN s{k} s ON s.g = q.g AND s.i = q.j GROUP BY 1, 2) b ON b.g = a.g AND b.i = a.i)"
        f", q{k + 1} AS MATERIALIZED (SELECT a.g, a.i, b.j, sum(a.p * b.p) AS p FROM q{k} a JOIN q{k} b ON a.g = b.g AND a.j = b.i GROUP BY 1, 2, 3)"
        for k in range(rounds)
    )


MARKOV = f"WITH {MODEL} SELECT src, dst, round(p, 9) AS p FROM t"
STATIONARY = f"WITH {stationary()} SELECT s AS state, round(pi, 9) AS pi FROM pi"
PASSAGE = f"WITH {MODEL}, q0 AS (SELECT st.s AS g, src AS i, dst AS j, p FROM t, st WHERE src <> st.s AND dst <> st.s), s0 AS (SELECT a.s AS g, b.s AS i, 1.0::DOUBLE AS v FROM st a, st b WHERE a.s <> b.s){series()} SELECT i AS src, g AS dst, round(v, 6) AS mfpt FROM s16 UNION ALL SELECT s, s, 0.0 FROM st"
FLUX = f"""WITH {stationary()}, ends AS (SELECT min(s) AS a, max(s) AS b FROM st), bk AS (SELECT t.dst AS src, t.src AS dst, x.pi * t.p / y.pi AS p FROM t JOIN pi x ON x.s = t.src JOIN pi y ON y.s = t.dst),
q0 AS (SELECT 'f' AS g, src AS i, dst AS j, p FROM t, ends WHERE src NOT IN (a, b) AND dst NOT IN (a, b) UNION ALL SELECT 'b', src, dst, p FROM bk, ends WHERE src NOT IN (a, b) AND dst NOT IN (a, b)),
s0 AS (SELECT 'f' AS g, src AS i, p AS v FROM t, ends WHERE src NOT IN (a, b) AND dst = b UNION ALL SELECT 'b', src, p FROM bk, ends WHERE src NOT IN (a, b) AND dst = a){series()},
q AS (SELECT s, CASE s WHEN a THEN 0.0 WHEN b THEN 1.0 ELSE f.v END AS qf, CASE s WHEN a THEN 1.0 WHEN b THEN 0.0 ELSE k.v END AS qb FROM ends, st LEFT JOIN s16 f ON f.g = 'f' AND f.i = s LEFT JOIN s16 k ON k.g = 'b' AND k.i = s),
g AS (SELECT t.src, t.dst, pi.pi * x.qb * t.p * y.qf AS f FROM t JOIN pi ON pi.s = t.src JOIN q x ON x.s = t.src JOIN q y ON y.s = t.dst WHERE t.src <> t.dst),
n AS (SELECT a.src, a.dst, round(a.f - b.f, 9) AS net FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src) SELECT src, dst, net FROM n WHERE net > 0"""
STRONG = f"""WITH RECURSIVE {MODEL}, r(a, b) AS (SELECT s, s FROM st UNION SELECT r.a, ct.dst FROM r JOIN ct ON ct.src = r.b), m AS (SELECT x.a, min(x.b) AS low, count(*) AS n FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT CAST(dense_rank() OVER (ORDER BY n DESC, low) - 1 AS INT) AS component, a AS state FROM m"""


def chapman_kolmogorov(lag: int = 2, factors: tuple[int, ...] = (2, 3, 4, 5), least: int = 50) -> str:
    """Mean squared difference of P(lag)^f and P(f lag) over rows with ``least`` counts at both lags."""
    lags = [lag, *(f * lag for f in factors)]
    out = f"WITH {EV}, pr AS (" + " UNION ALL ".join(f"SELECT {t} AS tau, state AS src, lead(state, {t}) OVER (PARTITION BY traj_id ORDER BY frame) AS dst FROM ev" for t in lags)
    out += f"), ct AS (SELECT tau, src, dst, count(*) AS n FROM pr WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL), w AS (SELECT tau, src, sum(n) AS n FROM ct GROUP BY ALL), st AS (SELECT src AS s FROM ct UNION SELECT dst FROM ct), t AS (SELECT ct.tau, ct.src, ct.dst, ct.n / w.n AS p FROM ct JOIN w ON w.tau = ct.tau AND w.src = ct.src), m1 AS (SELECT src, dst, p FROM t WHERE tau = {lag})"
    for k in range(1, max(factors)):
        out += f", m{k + 1} AS MATERIALIZED (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM m{k} a JOIN m1 b ON a.dst = b.src GROUP BY ALL)"
    for f in factors:
        rows = f"SELECT a.src AS s FROM w a JOIN w b ON a.src = b.src WHERE a.tau = {lag} AND b.tau = {f * lag} AND a.n >= {least} AND b.n >= {least}"
        out += f", e{f} AS (SELECT {f} AS factor, avg((coalesce(m.p, 0) - coalesce(t.p, 0)) ** 2) AS mse FROM ({rows}) r CROSS JOIN st LEFT JOIN m{f} m ON m.src = r.s AND m.dst = st.s LEFT JOIN t ON t.tau = {f * lag} AND t.src = r.s AND t.dst = st.s)"
    return out + " " + " UNION ALL ".join(f"SELECT CAST(factor AS INT) AS factor, round(mse, 9) AS mse FROM e{f}" for f in factors)


def spread_out(picks: int, where: str = "true") -> str:
    """Greedy max-min rows of each label: nearest to the centroid, then each time the farthest from those taken."""
    distance = "list_distance(CAST({}.embedding AS DOUBLE[]), CAST({}.embedding AS DOUBLE[]))".format
    out = f"WITH v AS (SELECT vec_id, label, embedding FROM embeddings WHERE {where}), c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), z AS (SELECT v.label, vec_id, round(sum((CAST(embedding[i] AS DOUBLE) - m) ** 2), 9) AS d FROM v JOIN c ON c.label = v.label GROUP BY ALL)"
    out += ", p1 AS (SELECT label, vec_id, 0.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM z) WHERE k = 1)"
    for n in range(2, picks + 1):
        taken = " UNION ALL ".join(f"SELECT label, vec_id FROM p{k}" for k in range(1, n))
        out += f", g{n} AS (SELECT v.label, v.vec_id, min({distance('v', 'o')}) AS gap FROM v JOIN ({taken}) s ON s.label = v.label JOIN v o ON o.vec_id = s.vec_id GROUP BY ALL), p{n} AS (SELECT label, vec_id, gap AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(gap, 9) DESC, vec_id) AS k FROM g{n}) WHERE k = 1 AND gap > 0)"
    return out + " " + " UNION ALL ".join(f"SELECT label, CAST({k} AS INT) AS rank, vec_id, round(score, 6) AS score FROM p{k}" for k in range(1, picks + 1))


def uncertainty(grid: str) -> str:
    """Root of trigamma(n + 1e-6) + trigamma(sum + 100e-6) over a 10 x 10 grid: recurrence to 12, then the asymptotic series."""
    trigamma = lambda x: f"(list_sum(list_transform(range(0, 12), lambda k: 1 / ({x} + k) ** 2)) + 1 / ({x} + 12) + 0.5 / ({x} + 12) ** 2 + 1.0 / 6 / ({x} + 12) ** 3 - 1.0 / 30 / ({x} + 12) ** 5 + 1.0 / 42 / ({x} + 12) ** 7 - 1.0 / 30 / ({x} + 12) ** 9)"
    return f'WITH g AS ({grid}), c AS (SELECT a.i AS bx, b.i AS "by", (SELECT count(*) FROM g WHERE g.bx = a.i AND g."by" = b.i) AS n FROM (SELECT unnest(range(0, 10)) AS i) a, (SELECT unnest(range(0, 10)) AS i) b), x AS (SELECT bx, "by", n + 1e-6::DOUBLE AS n, sum(n) OVER () + 100 * 1e-6::DOUBLE AS w FROM c) SELECT CAST(bx AS INT) AS bx, CAST("by" AS INT) AS "by", round(sqrt({trigamma("n")} + {trigamma("w")}), 3) AS sd FROM x'


def smoothed(grid: str, kt: str, sigma: float = 0.6, least: int = 5) -> str:
    """Sparse cells take their neighbours' mean (edges repeat), the grid is blurred (edges mirror), then -kT ln p."""
    reach = int(4 * sigma + 0.5)
    weight = f"exp(-0.5 * (k / {sigma}::DOUBLE) ** 2)"
    mirror = lambda x: f"CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} > 9 THEN 19 - ({x}) ELSE {x} END"
    return f"""WITH g AS ({grid}), i AS (SELECT unnest(range(0, 10)) AS i), c AS MATERIALIZED (SELECT a.i AS x, b.i AS y, (SELECT count(*) FROM g WHERE g.bx = a.i AND g."by" = b.i)::DOUBLE AS n FROM i a, i b),
d AS (SELECT unnest(range(-1, 2)) AS d), m AS (SELECT c.x, c.y, c.n, (sum(o.n) - max(c.n)) / 8 AS a FROM c, d e, d f, c o WHERE o.x = least(greatest(c.x + e.d, 0), 9) AND o.y = least(greatest(c.y + f.d, 0), 9) GROUP BY ALL),
r AS (SELECT x, y, CASE WHEN n < {least} AND a > 0 THEN greatest(a, {least}) ELSE n END AS v, n FROM m), s AS MATERIALIZED (SELECT x, y, v / sum(v) OVER () AS p FROM r),
k AS (SELECT k, {weight} / sum({weight}) OVER () AS w FROM (SELECT unnest(range({-reach}, {reach + 1})) AS k)), u AS MATERIALIZED (SELECT i.i AS x, s.y, sum(k.w * s.p) AS p FROM i, k, s WHERE s.x = {mirror("i.i + k.k")} GROUP BY ALL), v AS (SELECT u.x, i.i AS y, sum(k.w * u.p) AS p FROM i, k, u WHERE u.y = {mirror("i.i + k.k")} GROUP BY ALL),
f AS (SELECT x, y, -{kt} * ln(p) AS f FROM v WHERE p > 1e-12) SELECT CAST(x AS INT) AS bx, CAST(y AS INT) AS "by", round(f - min(f) OVER (), 6) + 0.0 AS free_energy FROM f"""


def adaptive_grid(kt: str) -> str:
    """Grid on the middle 98 percent of two columns, its bins a quarter fewer until six cells of ten are filled."""
    number = lambda c: f"CAST(floor(least(512, greatest(8, 16, sqrt(n), CASE WHEN {c}[3] > {c}[2] THEN ({c}[4] - {c}[1]) / (2 * ({c}[3] - {c}[2]) / pow(n, 1.0 / 3)) ELSE 0 END))) AS INT)"
    cell = lambda v, a, b, m: f"CAST(least(floor(({v} - {a}) / ({b} - {a}) * {m}), {m} - 1) AS INT)"
    return f"""WITH RECURSIVE q AS (SELECT count(*) AS n, quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.01, 0.25, 0.75, 0.99]) AS a, quantile_cont(CAST(l_quantity AS DOUBLE), [0.01, 0.25, 0.75, 0.99]) AS b FROM lineitem),
z AS (SELECT a[1] AS x0, a[4] AS x1, b[1] AS y0, b[4] AS y1, {number("a")} AS nx, {number("b")} AS ny FROM q),
t AS (SELECT 0 AS k, nx, ny FROM z UNION ALL SELECT k + 1, CAST(greatest(8, floor(0.75 * nx)) AS INT), CAST(greatest(8, floor(0.75 * ny)) AS INT) FROM t WHERE k < 10),
c AS (SELECT k, {cell("l_extendedprice", "x0", "x1", "t.nx")} AS bx, {cell("l_quantity", "y0", "y1", "t.ny")} AS "by", any_value(t.nx * t.ny) AS cells, any_value(greatest(t.nx, t.ny)) AS most, count(*) AS n FROM lineitem, z, t WHERE l_extendedprice BETWEEN x0 AND x1 AND l_quantity BETWEEN y0 AND y1 GROUP BY ALL),
g AS (SELECT k FROM c GROUP BY k HAVING count(*) >= 0.6 * any_value(cells) OR any_value(most) <= 8),
p AS (SELECT bx, "by", n, n / sum(n) OVER () AS p FROM c WHERE k = (SELECT coalesce(min(k), 10) FROM g))
SELECT bx, "by", CAST(n AS BIGINT) AS n, round(p, 9) AS p, round(-{kt} * ln(p) - min(-{kt} * ln(p)) OVER (), 6) + 0.0 AS free_energy FROM p"""
