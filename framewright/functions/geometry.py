"""Geometry of positions as Column arithmetic, feature specifications and their registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalars import is_finite

Vector = tuple[Column, Column, Column]


def position(atoms: Column, index: int) -> Vector:
    """Coordinates of an atom in ``ARRAY<STRUCT<x, y, z>>``; an index past the end gives nulls."""
    own = F.try_element_at(atoms, F.lit(index + 1))
    return own["x"], own["y"], own["z"]


def minus(a: Vector, b: Vector, box: tuple[float, float, float] | None = None) -> Vector:
    """a - b; in a rectangular box the nearest image (halves round to even)."""
    out = tuple(x - y for x, y in zip(a, b, strict=True))
    return out if box is None else tuple(d - F.rint(d / w) * w for d, w in zip(out, box, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def distance(a: Vector, b: Vector, box=None) -> Column:
    """Euclidean distance; not finite counts as 0."""
    d = minus(a, b, box)
    out = F.sqrt(dot(d, d))
    return F.when(is_finite(out), out).otherwise(0.0)


def contact(a: Vector, b: Vector, cutoff: float = 0.5, box=None) -> Column:
    """1.0 within the cutoff, else 0.0; an unknown distance is no contact."""
    if cutoff <= 0:
        raise ValueError("the cutoff must be positive")
    d = minus(a, b, box)
    return F.when(F.sqrt(dot(d, d)) <= cutoff, 1.0).otherwise(0.0)


def angle(a: Vector, b: Vector, c: Vector, box=None) -> Column:
    """Angle at b in radians; 0 for a degenerate one."""
    u, v = minus(a, b, box), minus(c, b, box)
    size = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(size > 1e-12, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.nullif(size, F.lit(0.0)))))).otherwise(0.0)


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector, box=None) -> Column:
    """Torsion about b-c in (-pi, pi]; 0 for a degenerate one."""
    u, v, w = minus(b, a, box), minus(c, b, box), minus(d, c, box)
    m, n = cross(u, v), cross(v, w)
    y = dot(cross(m, n), v) / F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))
    return F.coalesce(F.atan2(y, dot(m, n)), F.lit(0.0))


def radius_of_gyration(atoms: Column) -> Column:
    """Root mean square distance of the atoms from their mean."""
    n = F.nullif(F.size(atoms), F.lit(0)).cast("double")
    total = lambda f: F.aggregate(atoms, F.lit(0.0), lambda s, p: s + f(p))
    square = total(lambda p: p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]) / n
    mean = [total(lambda p, c=c: p[c]) / n for c in "xyz"]
    return F.sqrt(F.greatest(square - dot(tuple(mean), tuple(mean)), F.lit(0.0)))


def secondary_fractions(codes: Column) -> tuple[Column, Column, Column]:
    """Helix (H, G, I), strand (E, B) and other shares of a string of codes."""
    n = F.nullif(F.length(codes), F.lit(0)).cast("double")
    share = lambda letters: F.length(F.regexp_replace(codes, f"[^{letters}]", "")) / n
    helix, strand = share("HGI"), share("EB")
    return helix, strand, F.greatest(1 - helix - strand, F.lit(0.0))


def trig_columns(columns: dict[str, bool]) -> list[Column]:
    """cos and sin of each periodic column, the others as they are."""
    out = []
    for name, periodic in columns.items():
        out += [F.cos(name).alias(f"cos_{name}"), F.sin(name).alias(f"sin_{name}")] if periodic else [F.col(name)]
    return out


@dataclass
class FeatureSpec:
    """A named feature with its atom indices and options."""

    name: str
    atoms: tuple[int, ...] = ()
    options: dict[str, float] = field(default_factory=dict)


_CALL = re.compile(r"^\s*(?:([A-Za-z_]\w*)\s*:)?\s*([A-Za-z_]\w*)\s*(?:\((.*)\))?\s*$", re.DOTALL)


def parse_feature(spec: str) -> FeatureSpec:
    """Parse ``Rg``, ``dist:atompair(0,5)``, ``contacts:atompair(0,5,rcut=0.4)``, ``dihedral([0,1,2,3])``.

    Names fold to lower case; arguments that make no sense are dropped.
    """
    found = _CALL.match(spec)
    if not found:
        raise KeyError(spec)
    space, name, inside = found.groups()
    key = {"dist": "distance", "contacts": "contact"}.get((space or name).lower(), (space or name).lower())
    options = {k: float(v) for k, v in re.findall(r"([A-Za-z_]\w*)\s*=\s*([-+.\deE]+)", inside or "")}
    atoms = tuple(map(int, re.findall(r"(?<![\w.=])\d+(?![\w.])", re.sub(r"\w+\s*=\s*[-+.\deE]+", "", inside or ""))))
    return FeatureSpec(key, atoms, options)


Builder = Callable[[Column, FeatureSpec], list[Column]]
_REGISTRY: dict[str, tuple[int, bool, Builder]] = {}


def register_feature(name: str, arity: int, periodic: bool = False):
    """Register a builder of Columns from the atoms of a frame; names are case-insensitive."""

    def add(f: Builder) -> Builder:
        _REGISTRY[name.lower()] = (arity, periodic, f)
        return f

    return add


def feature(name: str) -> tuple[int, bool, Builder]:
    """The registered feature; KeyError if there is none."""
    return _REGISTRY[name.lower()]


@register_feature("rg", 0)
def _rg(atoms: Column, spec: FeatureSpec) -> list[Column]:
    return [radius_of_gyration(atoms)]


@register_feature("distance", 2)
def _distance(atoms: Column, spec: FeatureSpec) -> list[Column]:
    return [distance(*(position(atoms, i) for i in spec.atoms))]


@register_feature("contact", 2)
def _contact(atoms: Column, spec: FeatureSpec) -> list[Column]:
    return [contact(*(position(atoms, i) for i in spec.atoms), cutoff=spec.options.get("rcut", 0.5))]


@register_feature("angle", 3)
def _angle(atoms: Column, spec: FeatureSpec) -> list[Column]:
    return [angle(*(position(atoms, i) for i in spec.atoms))]


@register_feature("dihedral", 4, periodic=True)
def _dihedral(atoms: Column, spec: FeatureSpec) -> list[Column]:
    return [dihedral(*(position(atoms, i) for i in spec.atoms))]


def compute_features(frames: DataFrame, specs: list[str], keep: tuple[str, ...] = ("traj_id", "frame"), atoms: str = "pos") -> tuple[DataFrame, dict[str, bool]]:
    """One column a feature over ``frames(..., pos)``, and which are periodic. All in one projection."""
    columns, periodic = [], {}
    for text in specs:
        spec = parse_feature(text)
        arity, wraps, build = feature(spec.name)
        if len(spec.atoms) != arity:
            raise ValueError(f"{text}: {arity} atoms are needed")
        made = build(F.col(atoms), spec)
        for k, c in enumerate(made):
            label = "_".join([spec.name, *map(str, spec.atoms)]) + (f"_{k}" if len(made) > 1 else "")
            columns.append(c.alias(label))
            periodic[label] = wraps
    return frames.select(*keep, *columns), periodic
