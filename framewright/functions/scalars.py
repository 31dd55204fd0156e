"""Scalar expressions as Columns, and small driver helpers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.constants import TINY

PI = math.pi


def rounded(x: Column, digits: int = 9) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def wrap_half_open(x: Column, period: float = 2 * PI) -> Column:
    """Into [-period/2, period/2)."""
    return F.pmod(x + period / 2, F.lit(period)) - period / 2


def wrap_upper(x: Column, period: float = 2 * PI) -> Column:
    """Into (-period/2, period/2]."""
    return period / 2 - F.pmod(period / 2 - x, F.lit(period))


def bin_index(x: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Equal-width bin of x; values outside go to the nearest bin, the top edge to the last."""
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    width = F.nullif(high - low, F.lit(0.0))
    return F.least(F.greatest(F.floor((x - low) / width * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def inside_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin of x as np.histogram has it: null outside [low, high], the top edge in the last bin."""
    return F.when(x.between(low, high), bin_index(x, low, high, bins))


def implied_timescale(value: Column, lag: Column | float) -> Column:
    """-lag / ln(value) for a real eigenvalue inside (0, 1), else null."""
    lag = F.lit(lag) if isinstance(lag, (int, float)) else lag
    return F.when((value > 0) & (value < 1), -lag / F.ln(value))


def free_energy(p: Column, kt: float, tiny: float = TINY) -> Column:
    """-kT ln p, null where p is not above ``tiny``; not shifted."""
    return F.when(p > tiny, -kt * F.ln(p))


def slugify(x: Column) -> Column:
    """File-name part: lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_schedule(x: Column) -> Column:
    """Sorted distinct positive integers of a list with commas or semicolons; other tokens are skipped."""
    numbers = F.transform(F.split(x, "[,;]"), lambda t: F.trim(t).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n > 0))))


def reweighting(bias: Column, kt: float, over) -> Column:
    """exp(bias / kT) relative to the largest of the window ``over``."""
    return F.exp((bias - F.max(bias).over(over)) / kt)


#: pK of the charged residues and the termini, hydrophobic and aromatic residues.
PK_POSITIVE = {"K": 10.5, "R": 12.5, "H": 6.0}
PK_NEGATIVE = {"C": 8.3, "D": 3.9, "E": 4.1, "Y": 10.1}
PK_N_TERMINUS, PK_C_TERMINUS = 9.69, 2.34
HYDROPHOBIC, AROMATIC = "AVILMFYWPG", "FYW"


def letter_count(sequence: Column, letter: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(letter), F.lit("")))


def without(sequence: Column, kept: str) -> Column:
    """The sequence without the capital letters that are not in ``kept``, in one pass."""
    return F.translate(sequence, "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in kept), "")


def charged_letters(sequence: Column) -> Column:
    """struct of the numbers of charged residues by letter; they are counted in what one pass leaves."""
    kept = without(sequence, "".join([*PK_POSITIVE, *PK_NEGATIVE]))
    return F.struct(*[letter_count(kept, letter).alias(letter) for letter in [*PK_POSITIVE, *PK_NEGATIVE]])


def charge_of(letters: Column, ph: Column) -> Column:
    """Charge of ``charged_letters`` at a pH, by the Henderson-Hasselbalch equation."""
    plus = F.lit(1.0) / (1 + F.pow(F.lit(10.0), ph - PK_N_TERMINUS))
    minus = F.lit(1.0) / (1 + F.pow(F.lit(10.0), F.lit(PK_C_TERMINUS) - ph))
    for letter, pk in PK_POSITIVE.items():
        plus = plus + letters[letter] / (1 + F.pow(F.lit(10.0), ph - pk))
    for letter, pk in PK_NEGATIVE.items():
        minus = minus + letters[letter] / (1 + F.pow(F.lit(10.0), F.lit(pk) - ph))
    return plus - minus


def net_charge(sequence: Column, ph: Column) -> Column:
    """Charge of a residue sequence at a pH."""
    return charge_of(charged_letters(sequence), ph)


def hydrophobic_fraction(sequence: Column) -> Column:
    return F.length(without(sequence, HYDROPHOBIC)) / F.nullif(F.length(sequence), F.lit(0))


def aromatic_count(sequence: Column) -> Column:
    return F.length(without(sequence, AROMATIC))


def isoelectric_point(sequence: Column, rounds: int = 60) -> Column:
    """pH of charge zero in [0, 14], by a fixed number of bisections; ``sequence`` holds capital letters.

    The letters are counted once and travel in the bisection's state.
    """
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi"), charged_letters(sequence).alias("n"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = charge_of(s["n"], mid) > 0
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"), s["n"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


#: Lags of the ladder.
LADDER = [1, 2, 3, 5, 8, 10, 15, 20, 30, 40, 50, 75, 80, 100, 150, 160, 200, 300, 320, 500, 640, 750, 1000, 1280, 1500, 2000]


def lag_ladder(least: int = 1, most: int = 200, n: int | None = None) -> list[int]:
    """Ladder lags in [least, most], thinned evenly to ``n`` with both ends kept; none in range raises."""
    if least < 1 or most < least or (n is not None and n < 1):
        raise ValueError("need 1 <= least <= most and a positive number")
    own = [x for x in LADDER if least <= x <= most]
    if not own:
        raise ValueError(f"the ladder has no lag from {least} to {most}")
    if n is None or n >= len(own):
        return own
    if n == 1:
        return own[:1]
    return [own[k] for k in sorted({0, len(own) - 1, *(round(i * (len(own) - 1) / (n - 1)) for i in range(n))})]


def geometric_taus(length: int, n: int = 10, least: int = 1, share: float = 1 / 3) -> list[int]:
    """Up to ``n`` log-spaced lags from ``least`` to ``share`` of the length, strictly increasing."""
    most = int(length * share)
    if most < least:
        return []
    if n < 2 or most == least:
        return [least]
    return sorted({max(least, min(most, round(least * (most / least) ** (i / (n - 1))))) for i in range(n)})


def parse_taus(raw: str | Iterable, strict: bool = True) -> list[int]:
    """Sorted distinct positive lags of a text or a list; bad tokens raise or are skipped."""
    out = set()
    for token in re.split("[,;]", raw) if isinstance(raw, str) else raw:
        try:
            value = int(str(token).strip())
            if value < 1:
                raise ValueError(f"not positive: {value}")
            out.add(value)
        except ValueError:
            if strict:
                raise
    return sorted(out)


def deep_merge(base: dict, override: dict) -> dict:
    """Nested override; neither argument changes."""
    out = dict(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
