"""Backbone and side-chain torsions and alpha-carbon distances, found in a table of atoms by residue."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.functions.scalars import wrap_upper

#: Names of the fourth atom of the first side-chain torsion.
GAMMA = ("CG", "CG1", "SG", "OG", "OG1")
KINDS = ("phi_psi", "backbone_torsions", "ca_distances")


def residues(atoms: list[tuple]) -> list[tuple[str, int, dict[str, int]]]:
    """(chain, number, atom name -> place) in file order, of rows (name, chain, res_id) in atom order."""
    out: list[tuple[str, int, dict[str, int]]] = []
    for place, (name, chain, number) in enumerate(atoms):
        if not out or out[-1][:2] != (chain, number):
            out.append((chain, number, {}))
        out[-1][2].setdefault(name, place)
    return out


def torsions(atoms: list[tuple], chi: bool = False) -> list[tuple[str, tuple[int, int, int, int]]]:
    """(label, four atom places): phi and psi of residues whose neighbour in the chain follows without a gap, then chi1.

    Labels are ``phi:res7``; with several chains ``phi:A:res7``. Residues without the atoms are left out.
    """
    rows = residues(atoms)
    several = len({c for c, _, _ in rows}) > 1
    label = lambda kind, r: f"{kind}:{r[0]}:res{r[1]}" if several else f"{kind}:res{r[1]}"
    found: dict[str, list] = {"phi": [], "psi": [], "chi1": []}
    for before, own in zip([None, *rows[:-1]], rows, strict=True):
        if before is not None and before[0] == own[0] and own[1] - before[1] == 1:
            if "C" in before[2] and {"N", "CA", "C"} <= own[2].keys():
                found["phi"].append((label("phi", own), (before[2]["C"], *(own[2][n] for n in ("N", "CA", "C")))))
            if {"N", "CA", "C"} <= before[2].keys() and "N" in own[2]:
                found["psi"].append((label("psi", before), (*(before[2][n] for n in ("N", "CA", "C")), own[2]["N"])))
        gamma = next((own[2][g] for g in GAMMA if g in own[2]), None)
        if gamma is not None and {"N", "CA", "CB"} <= own[2].keys():
            found["chi1"].append((label("chi1", own), (own[2]["N"], own[2]["CA"], own[2]["CB"], gamma)))
    return found["phi"] + found["psi"] + (found["chi1"] if chi else [])


def alpha_pairs(atoms: list[tuple], most: int | None = None, stride: int = 1) -> list[tuple[str, tuple[int, int]]]:
    """(label, two atom places) of all pairs of alpha carbons, or of every ``stride``-th; the first ``most`` if given."""
    alpha = [i for i, (name, _, _) in enumerate(atoms) if name == "CA"][::stride]
    if len(alpha) < 2:
        raise ValueError("fewer than two alpha carbons")
    pairs = itertools.islice(itertools.combinations(alpha, 2), most)
    return [(f"dist:atoms:{i}-{j}", (i, j)) for i, j in pairs]


def featurised(frames: DataFrame, atoms: list[tuple], kind: str = "phi_psi", most: int | None = None, stride: int = 1) -> DataFrame:
    """(traj_id, frame, a column a feature) of ``frames(traj_id, frame, pos)``; angles in radians in (-pi, pi].

    ``atoms`` are the (name, chain, res_id) of the positions, a table of one structure. All columns are
    one projection over the frames.
    """
    at = lambda i: G.position(F.col("pos"), i)
    if kind == "ca_distances":
        made = [G.distance(at(i), at(j)).alias(label) for label, (i, j) in alpha_pairs(atoms, most, stride)]
    elif kind in KINDS:
        made = [wrap_upper(G.dihedral(*map(at, four))).alias(label) for label, four in torsions(atoms, kind == "backbone_torsions")]
    else:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")
    return frames.select("traj_id", "frame", *made)
