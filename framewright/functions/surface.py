"""Solvent-accessible area and hydrogen bonds of atom tables, neighbours by a cell list."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radii of atoms by element and of a water probe, in nanometres.
RADII = {"H": 0.120, "C": 0.170, "N": 0.155, "O": 0.152, "S": 0.180, "P": 0.180, "F": 0.147}
PROBE = 0.14


def sphere_points(n: int) -> np.ndarray:
    """n points spread evenly over the unit sphere: equal bands of height, each turned on by the golden angle."""
    k = np.arange(n)
    y = 2 * (k + 0.5) / n - 1
    ring, turn = np.sqrt(1 - y * y), k * math.pi * (3 - math.sqrt(5))
    return np.stack([np.cos(turn) * ring, y, np.sin(turn) * ring], 1)


def with_cells(atoms: DataFrame, edge: float, reach: float) -> DataFrame:
    """``atoms(x, y, z, ...)`` once for every cell (cx, cy, cz) of width ``edge`` within ``reach`` of them; ``home`` marks an atom's own."""
    spans = [F.sequence(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge)) for c in "xyz"]
    out = atoms
    for c, span in zip("xyz", spans, strict=True):
        out = out.withColumn(f"c{c}", F.explode(span))
    home = F.lit(True)
    for c in "xyz":
        home = home & (F.col(f"c{c}") == F.floor(F.col(c) / edge))
    return out.withColumn("home", home)


def groups_in_order(tables: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal ``keys`` of batches sorted by them, many small ones together; the last group waits for its rest."""
    rest: list[pa.RecordBatch] = []
    for batch in tables:
        if not batch.num_rows:
            continue
        if rest and all(rest[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            rest.append(batch)  # a group that goes on
            continue
        table = pa.Table.from_batches([*rest, batch])
        at = int(group_starts(table, keys)[-1])
        if at:
            yield table.slice(0, at)
        rest = table.slice(at).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each run of equal ``keys``."""
    n = table.num_rows
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        code = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def exposed_shares(at: np.ndarray, radius: np.ndarray, home: np.ndarray, start: np.ndarray, points: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Share of the points of each ``home`` sphere that lie in no other of its group, groups beginning at the rows ``start``.

    A sphere does not hide itself. Pairs of spheres, and of points and spheres, are looked at ``most`` at a time.
    """
    end = np.append(start[1:], len(at))
    group = np.repeat(np.arange(len(start)), end - start)
    own = np.flatnonzero(home)
    first, size = start[group[own]], (end - start)[group[own]]
    hidden = np.zeros((len(own), len(points)), bool)
    done, step, k = np.cumsum(size), max(1, most // len(points)), 0
    while k < len(own):
        to = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + most, "right")))
        for low in range(0, int(size[k:to].max()), most):  # one sphere's own group may be larger than ``most``
            width = np.clip(size[k:to] - low, 0, most)
            i = np.repeat(np.arange(k, to), width)
            j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[k:to] + low, width)
            gap = np.sqrt(((at[j] - at[own[i]]) ** 2).sum(1))
            r = radius[own[i]]
            near = ((gap < r + radius[j]) & (gap > 0)) | ((gap == 0) & (radius[j] > r))  # a larger sphere around the same place hides it
            i, j = i[near], j[near]
            for n in range(0, len(i), step):
                a, b = i[n : n + step], j[n : n + step]
                x = at[own[a]][:, None] + radius[own[a]][:, None, None] * points
                inside = ((x - at[b][:, None]) ** 2).sum(2) < (radius[b] ** 2)[:, None]
                begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                hidden[a[begin]] |= np.logical_or.reduceat(inside, begin)
        k = to
    return 1 - hidden.mean(1)


def atom_areas(atoms: DataFrame, keys: tuple[str, ...] = ("traj_id", "frame"), n_points: int = 960, probe: float = PROBE, edge: float = 2.0) -> DataFrame:
    """(keys, atom_id, area) of ``atoms(keys, atom_id, x, y, z, radius)``: the solvent-accessible area of each atom.

    Shrake and Rupley's rule: of ``n_points`` on the sphere of an atom's radius and the probe's, those inside no
    other atom's such sphere count. Space is cut into cells of width ``edge``; a cell's atoms and those around it within reach meet in
    a group, so a frame of any number of atoms is dealt to many. A task takes its groups in order, many small ones at once. The unit is that of the coordinates, nanometres by the
    defaults. Atoms with a null, non-finite place or radius are left out.
    """
    ok = F.lit(True)
    for c in ("x", "y", "z", "radius"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    own = atoms.where(ok).select(*keys, "atom_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], (F.col("radius").cast("double") + probe).alias("r"))
    top = own.agg(F.max("r")).first()[0]
    points, kinds = sphere_points(n_points), dict(own.dtypes)
    cells = with_cells(own, edge, 2 * (top or 0.0))

    by = [*keys, "cx", "cy", "cz"]

    def run(batches):
        for table in groups_in_order(batches, by):
            home = table["home"].to_numpy()
            at = np.stack([table[c].to_numpy() for c in "xyz"], 1)
            r = table["r"].to_numpy()
            share = exposed_shares(at, r, home, group_starts(table, by), points)
            mine = table.filter(table["home"])
            made = pa.table({**{c: mine[c] for c in (*keys, "atom_id")}, "area": 4 * math.pi * r[home] ** 2 * share})
            yield from made.combine_chunks().to_batches()

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, "atom_id")), "area double"])
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def solvent_area(atoms: DataFrame, keys: tuple[str, ...] = ("traj_id", "frame"), **how) -> DataFrame:
    """(keys, area): sum of the atoms' areas; add a residue's column to ``keys`` of the result of ``atom_areas`` for residues."""
    return atom_areas(atoms, keys, **how).groupBy(*keys).agg(F.sum("area").alias("area"))


def radius_of(element: Column) -> Column:
    """Radius of an element's symbol; unknown ones have that of carbon."""
    table = F.create_map(*[x for k, v in RADII.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[F.upper(element)], F.lit(RADII["C"]))


def hydrogen_bonds(atoms: DataFrame, bonds: DataFrame, keys: tuple[str, ...] = ("traj_id", "frame"), most: float = 0.25, least_angle: float = 120.0) -> DataFrame:
    """(keys, donor, hydrogen, acceptor, distance, angle) of ``atoms(keys, atom_id, element, x, y, z)``.

    Baker and Hubbard's rule: a hydrogen that ``bonds(donor, hydrogen)`` ties to N or O, with an acceptor N or O other than the
    donor nearer than ``most``, and an angle donor-hydrogen-acceptor above ``least_angle`` degrees. Hydrogens look for
    acceptors in their own and the neighbouring cells only, by an equi-join on (keys, cell).
    """
    cell = [F.floor(F.col(c) / most).alias(f"c{c}") for c in "xyz"]
    heavy = atoms.where(F.upper("element").isin("N", "O"))
    acceptor = heavy.select(*keys, F.col("atom_id").alias("acceptor"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *cell)
    donor = heavy.join(F.broadcast(bonds), F.col("atom_id") == F.col("donor")).select(*keys, "donor", "hydrogen", *[F.col(c).alias(f"d{c}") for c in "xyz"])  # bonds: one row a hydrogen of the structure
    light = atoms.select(*keys, F.col("atom_id").alias("hydrogen"), *[F.col(c).alias(f"h{c}") for c in "xyz"], *cell)
    pairs = donor.join(light, [*keys, "hydrogen"])
    for c in "xyz":
        pairs = pairs.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
    met = pairs.join(acceptor, [*keys, "cx", "cy", "cz"]).where("acceptor <> donor and acceptor <> hydrogen")
    to = lambda a: [F.col(f"{a}{c}") - F.col(f"h{c}") for c in "xyz"]
    dot = lambda u, v: sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))
    length = F.sqrt(dot(to("a"), to("a")))
    cosine = dot(to("a"), to("d")) / F.nullif(length * F.sqrt(dot(to("d"), to("d"))), F.lit(0.0))
    met = met.withColumn("distance", length).where(F.col("distance") < most).withColumn("angle", F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))))
    return met.where(F.col("angle") > least_angle).select(*keys, "donor", "hydrogen", "acceptor", "distance", "angle")


def bond_counts(atoms: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("traj_id", "frame"), frequency: float = 0.0) -> DataFrame:
    """(keys, bonds): number of bonds of every frame; only triplets that stand in more than ``frequency`` of all frames count."""
    frames = atoms.select(*keys).distinct()
    if frequency > 0:
        triple = ["donor", "hydrogen", "acceptor"]
        often = found.groupBy(*triple).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > frequency * frames.count()).select(*triple)
        found = found.join(often, triple, "left_semi")
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return frames.join(n, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("bonds"))
