"""Queries on scalar functions, geometry and serialisation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.functions import scalars as X
from framewright.operators.hills import hill_bias
from framewright.plans.registry import query
from framewright.sources import frames as S


@query("wrap_periodic", "SELECT event_id, round(value + pi() - 2 * pi() * floor((value + pi()) / (2 * pi())) - pi(), 7) + 0.0 AS half_open, round(pi() - (pi() - value - 2 * pi() * floor((pi() - value) / (2 * pi()))), 7) + 0.0 AS upper FROM events")
def wrap_periodic(spark, d):
    v = F.col("value")
    return S.table(spark, d, "events").select("event_id", X.rounded(X.wrap_half_open(v), 7).alias("half_open"), X.rounded(X.wrap_upper(v), 7).alias("upper"))


@query("trig_expand", "SELECT event_id, round(cos(value), 9) + 0.0 AS cos_value, round(sin(value), 9) + 0.0 AS sin_value, ts FROM events")
def trig_expand(spark, d):
    e = S.table(spark, d, "events").select("event_id", "value", "ts").select("event_id", *G.trig_columns({"value": True, "ts": False}))
    return e.select("event_id", X.rounded(F.col("cos_value")).alias("cos_value"), X.rounded(F.col("sin_value")).alias("sin_value"), "ts")


def atom_frames(spark: SparkSession, d: str, atoms: int = 4) -> DataFrame:
    """A frame a vector: its first twelve components as four atoms, or more of them (21 are all that its 64 components hold whole)."""
    e = S.table(spark, d, "embeddings")
    atom = lambda i: F.struct(*[F.col("embedding")[3 * i + k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return e.select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame"), F.array(*[atom(i) for i in range(atoms)]).alias("pos"))


def _atoms() -> str:
    return "a AS (SELECT label AS traj_id, vec_id AS frame, " + ", ".join(f"CAST(embedding[{3 * i + k + 1}] AS DOUBLE) AS {c}{i}" for i in range(4) for k, c in enumerate("xyz")) + " FROM embeddings)"


def _gap(i: int, j: int) -> str:
    return f"sqrt((x{i} - x{j}) ** 2 + (y{i} - y{j}) ** 2 + (z{i} - z{j}) ** 2)"


@query("distance_angle_dihedral", f"WITH {_atoms()}, u AS (SELECT *, x1 - x0 AS ax, y1 - y0 AS ay, z1 - z0 AS az, x2 - x1 AS bx, y2 - y1 AS by_, z2 - z1 AS bz, x3 - x2 AS cx, y3 - y2 AS cy, z3 - z2 AS cz FROM a), c AS (SELECT *, ay * bz - az * by_ AS mx, az * bx - ax * bz AS my, ax * by_ - ay * bx AS mz, by_ * cz - bz * cy AS nx, bz * cx - bx * cz AS ny, bx * cy - by_ * cx AS nz FROM u) SELECT traj_id, frame, round({_gap(0, 1)}, 9) AS distance_0_1, CASE WHEN {_gap(0, 2)} <= 0.2 THEN 1.0 ELSE 0.0 END AS contact_0_2, round(acos(greatest(-1.0, least(1.0, -(ax * bx + ay * by_ + az * bz) / ({_gap(0, 1)} * {_gap(1, 2)})))), 7) AS angle_0_1_2, round(atan2(((my * nz - mz * ny) * bx + (mz * nx - mx * nz) * by_ + (mx * ny - my * nx) * bz) / {_gap(1, 2)}, mx * nx + my * ny + mz * nz), 7) + 0.0 AS dihedral_0_1_2_3 FROM c")
def distance_angle_dihedral(spark, d):
    out, _ = G.compute_features(atom_frames(spark, d), ["dist:atompair(0,1)", "contacts:atompair(0,2,rcut=0.2)", "angle([0,1,2])", "dihedral([0,1,2,3])"])
    return out.select("traj_id", "frame", X.rounded(F.col("distance_0_1")).alias("distance_0_1"), F.col("contact_0_2"), X.rounded(F.col("angle_0_1_2"), 7).alias("angle_0_1_2"), X.rounded(F.col("dihedral_0_1_2_3"), 7).alias("dihedral_0_1_2_3"))


@query("radius_of_gyration", f"WITH {_atoms()} SELECT traj_id, frame, round(sqrt(greatest((" + " + ".join(f"{c}{i} * {c}{i}" for c in "xyz" for i in range(4)) + ") / 4 - " + " - ".join(f"(({c}0 + {c}1 + {c}2 + {c}3) / 4) ** 2" for c in "xyz") + ", 0)), 9) AS rg FROM a")
def radius_of_gyration(spark, d):
    return atom_frames(spark, d).select("traj_id", "frame", X.rounded(G.radius_of_gyration(F.col("pos"))).alias("rg"))


@query("minimum_image_distance", f"WITH {_atoms()}, u AS (SELECT traj_id, frame, x0 - x1 - round_even((x0 - x1) / 0.2, 0) * 0.2 AS dx, y0 - y1 - round_even((y0 - y1) / 0.2, 0) * 0.2 AS dy, z0 - z1 - round_even((z0 - z1) / 0.2, 0) * 0.2 AS dz FROM a) SELECT traj_id, frame, round(sqrt(dx * dx + dy * dy + dz * dz), 9) AS distance FROM u")
def minimum_image_distance(spark, d):
    pos = [G.position(F.col("pos"), i) for i in (0, 1)]
    return atom_frames(spark, d).select("traj_id", "frame", X.rounded(G.distance(*pos, box=(0.2, 0.2, 0.2))).alias("distance"))


@query("all_pair_distances", f"WITH {_atoms()} " + " UNION ALL ".join(f"SELECT traj_id, frame, CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, round({_gap(i, j)}, 9) AS distance FROM a" for i in range(4) for j in range(i + 1, 4)))
def all_pair_distances(spark, d):
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), G.distance(G.position(F.col("pos"), i), G.position(F.col("pos"), j)).alias("v")) for i in range(4) for j in range(i + 1, 4)]
    return atom_frames(spark, d).select("traj_id", "frame", F.explode(F.array(*pairs)).alias("e")).select("traj_id", "frame", "e.i", "e.j", X.rounded(F.col("e.v")).alias("distance"))


@query("slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugify(spark, d):
    return S.table(spark, d, "part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))


@query("parse_schedule", "WITH s AS (SELECT p_partkey, p_size || ',' || (p_size % 7) || ';x, ' || (p_size % 3) AS raw FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(raw, '[,;]'), lambda t: TRY_CAST(trim(t) AS INT)), lambda n: n IS NOT NULL AND n > 0))), '|') AS taus FROM s")
def parse_schedule(spark, d):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(","), (F.col("p_size") % 7).cast("string"), F.lit(";x, "), (F.col("p_size") % 3).cast("string"))
    return S.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(X.parse_schedule(raw), lambda n: n.cast("string")), "|").alias("taus"))


SEQ = "s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q FROM documents)"


def _n(letter: str) -> str:
    return f"(length(q) - length(replace(q, '{letter}', '')))"


_PLUS = " + ".join([f"1 / (1 + 10.0 ** (7.0 - {X.PK_N_TERMINUS}))", *(f"{_n(a)} / (1 + 10.0 ** (7.0 - {pk}))" for a, pk in X.PK_POSITIVE.items())])
_MINUS = " + ".join([f"1 / (1 + 10.0 ** ({X.PK_C_TERMINUS} - 7.0))", *(f"{_n(a)} / (1 + 10.0 ** ({pk} - 7.0))" for a, pk in X.PK_NEGATIVE.items())])


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("q"))


@query("sequence_metrics", f"WITH {SEQ} SELECT doc_id, CAST(length(q) AS BIGINT) AS n, CAST({_n('K')} AS BIGINT) AS n_k, round({_PLUS} - ({_MINUS}), 6) + 0.0 AS charge, round(length(regexp_replace(q, '[^{X.HYDROPHOBIC}]', '', 'g')) / nullif(length(q), 0), 9) AS hydrophobic, CAST(length(regexp_replace(q, '[^{X.AROMATIC}]', '', 'g')) AS BIGINT) AS aromatic FROM s")
def sequence_metrics(spark, d):
    q = F.col("q")
    return sequences(spark, d).select("doc_id", F.length(q).cast("long").alias("n"), X.letter_count(q, "K").cast("long").alias("n_k"), X.rounded(X.net_charge(q, F.lit(7.0)), 6).alias("charge"), X.rounded(X.hydrophobic_fraction(q)).alias("hydrophobic"), X.aromatic_count(q).cast("long").alias("aromatic"))


@query("isoelectric_points")
def isoelectric_points(spark, d):
    """pH of charge zero by sixty bisections inside one expression."""
    return sequences(spark, d).select("doc_id", F.round(X.isoelectric_point(F.col("q")), 4).alias("pi"))


@query("secondary_fractions", "WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q FROM documents), f AS (SELECT doc_id, length(regexp_replace(q, '[^HGI]', '', 'g')) / nullif(length(q), 0) AS h, length(regexp_replace(q, '[^EB]', '', 'g')) / nullif(length(q), 0) AS e FROM s) SELECT doc_id, round(h, 9) AS helix, round(e, 9) AS strand, round(greatest(1 - h - e, 0), 9) AS other FROM f")
def secondary_fractions(spark, d):
    h, e, o = G.secondary_fractions(F.col("q"))
    return sequences(spark, d).select("doc_id", X.rounded(h).alias("helix"), X.rounded(e).alias("strand"), X.rounded(o).alias("other"))


@query("macro_map_roundtrip", "SELECT p_partkey, '{\"micro_to_macro\":[' || p_size || ',' || (p_size % 5) || ']}' AS text, CAST(p_size % 5 AS INT) AS second FROM part")
def macro_map_roundtrip(spark, d):
    text = S.macro_map_json(F.array(F.col("p_size"), F.col("p_size") % 5))
    return S.table(spark, d, "part").select("p_partkey", text.alias("text")).withColumn("second", S.macro_map_parse(F.col("text"))[1])


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return S.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("timestamp_text", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def timestamp_text(spark, d):
    return S.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp"))


@query("gaussian_bias", "WITH e AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events) SELECT a.user_id AS traj_id, CAST(a.f AS BIGINT) AS frame, round(sum(CASE WHEN b.f IS NOT NULL THEN exp(-((a.x - b.x) ** 2) / 200) ELSE 0 END), 7) AS bias FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.f < a.f AND b.f % 10 = 0 GROUP BY 1, 2")
def gaussian_bias(spark, d):
    """Bias of every tenth frame's hill on all later frames of its trajectory."""
    f = S.event_frames(spark, d).select("traj_id", "frame", "x")
    out = hill_bias(f, f.where("frame % 10 = 0").withColumn("height", F.lit(1.0)), 10.0)
    return out.withColumn("bias", X.rounded(F.col("bias"), 7))


@query("kt_constant", "SELECT event_id, round(CAST(0.00831446261815324 * (250 + event_id % 100) AS DOUBLE), 12) AS kt, round(value / (0.00831446261815324 * (250 + event_id % 100)), 6) + 0.0 AS reduced FROM events")
def kt_constant(spark, d):
    """Values as energies at a temperature of each event, in units of its kT."""
    from framewright.functions.constants import kt

    own = F.lit(kt(1.0)) * (250 + F.col("event_id") % 100)
    return S.table(spark, d, "events").select("event_id", X.rounded(own, 12).alias("kt"), X.rounded(F.col("value") / own, 6).alias("reduced"))


@query("best_epoch", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best, max(o_totalprice) AS score FROM orders GROUP BY o_custkey")
def best_epoch(spark, d):
    """Best step of a curve: the key of the largest score."""
    return S.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"), F.max("o_totalprice").alias("score"))


@query("weighted_epoch_mean", "SELECT event_type, round(sum(value * (event_id % 7)) / nullif(sum(event_id % 7), 0), 6) AS mean, max(value) AS top FROM events GROUP BY 1")
def weighted_epoch_mean(spark, d):
    w = F.col("event_id") % 7
    return S.table(spark, d, "events").groupBy("event_type").agg(X.rounded(F.sum(F.col("value") * w) / F.nullif(F.sum(w), F.lit(0)), 6).alias("mean"), F.max("value").alias("top"))


def atom_rows(spark: SparkSession, d: str) -> DataFrame:
    """All whole triples of components of a vector as its atoms: elements N, H, O, C in turn, coordinates in nanometres."""
    e = S.table(spark, d, "embeddings").select(F.col("label").alias("traj_id"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    at = e.select("traj_id", "frame", "e", F.explode(F.sequence(F.lit(0), F.floor(F.size("e") / 3).cast("int") - 1)).alias("atom_id"))
    kinds = F.array(*[F.lit(k) for k in "NHOC"])
    return at.select("traj_id", "frame", "atom_id", kinds[F.col("atom_id") % 4].alias("element"), *[F.get("e", 3 * F.col("atom_id") + k).alias(c) for k, c in enumerate("xyz")])


ATOM_SQL = "t AS (SELECT label AS traj_id, vec_id AS frame, i AS atom_id, ['N', 'H', 'O', 'C'][i % 4 + 1] AS element, [0.155, 0.12, 0.152, 0.17][i % 4 + 1] + 0.14 AS r, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM embeddings, (SELECT unnest(range(0, 21)) AS i))"


@query("solvent_area", f"WITH {ATOM_SQL}, s AS (SELECT 2 * (k + 0.5) / 60 - 1 AS v, k * pi() * (3 - sqrt(5)) AS w FROM (SELECT unnest(range(0, 60)) AS k)), q AS (SELECT t.traj_id, t.frame, t.atom_id, t.r, t.x + t.r * cos(w) * sqrt(1 - v * v) AS x, t.y + t.r * v AS y, t.z + t.r * sin(w) * sqrt(1 - v * v) AS z FROM t, s), h AS (SELECT q.traj_id, q.frame, q.atom_id, any_value(q.r) AS r, bool_or((q.x - o.x) ** 2 + (q.y - o.y) ** 2 + (q.z - o.z) ** 2 < o.r * o.r) AS hidden FROM q JOIN t o ON o.traj_id = q.traj_id AND o.frame = q.frame AND o.atom_id <> q.atom_id GROUP BY q.traj_id, q.frame, q.atom_id, q.x, q.y, q.z) SELECT traj_id, frame, round(sum(4 * pi() * r * r / 60 * CASE WHEN hidden THEN 0 ELSE 1 END), 6) + 0.0 AS area FROM h GROUP BY 1, 2")
def solvent_area(spark, d):
    """Solvent-accessible area of every frame, its atoms all triples of the vector's components."""
    from framewright.functions import surface as A

    atoms = atom_rows(spark, d).withColumn("radius", A.radius_of(F.col("element")))
    return A.solvent_area(atoms, n_points=60).withColumn("area", X.rounded(F.col("area"), 6))


@query("hydrogen_bonds", f"WITH {ATOM_SQL}, b AS (SELECT d.traj_id, d.frame, d.atom_id AS donor, h.atom_id AS hydrogen, a.atom_id AS acceptor, sqrt((a.x - h.x) ** 2 + (a.y - h.y) ** 2 + (a.z - h.z) ** 2) AS ah, sqrt((d.x - h.x) ** 2 + (d.y - h.y) ** 2 + (d.z - h.z) ** 2) AS dh, (a.x - h.x) * (d.x - h.x) + (a.y - h.y) * (d.y - h.y) + (a.z - h.z) * (d.z - h.z) AS dot FROM t d JOIN t h ON h.traj_id = d.traj_id AND h.frame = d.frame AND d.element = 'N' AND h.atom_id = d.atom_id + 1 JOIN t a ON a.traj_id = d.traj_id AND a.frame = d.frame AND a.element IN ('N', 'O') AND a.atom_id <> d.atom_id), k AS (SELECT * FROM b WHERE ah < 0.25 AND degrees(acos(greatest(-1, least(1, dot / nullif(ah * dh, 0))))) > 120) SELECT f.traj_id, f.frame, CAST(count(k.donor) AS BIGINT) AS bonds FROM (SELECT DISTINCT traj_id, frame FROM t) f LEFT JOIN k ON k.traj_id = f.traj_id AND k.frame = f.frame GROUP BY 1, 2")
def hydrogen_bonds(spark, d):
    """Number of hydrogen bonds of every frame."""
    from framewright.functions import surface as A

    atoms = atom_rows(spark, d)
    bonds = atoms.where("element = 'N'").select(F.col("atom_id").alias("donor"), (F.col("atom_id") + 1).alias("hydrogen")).distinct()
    return A.bond_counts(atoms, A.hydrogen_bonds(atoms, bonds))
