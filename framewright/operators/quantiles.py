"""Exact quantiles of distributed columns by repeated refinement of histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalars import is_finite


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], bins: int = 1024) -> dict[tuple[str, int], float]:
    """The values of the given ranks (from 0) among each column's finite values.

    A pass counts, for every rank still open, the values in each of ``bins`` parts of the interval that holds it;
    the part with the rank, from its least to its largest value, is the next interval, until both are one value. All
    ranks of all columns share a pass; a task sends at most a row a rank and part, so no column is gathered or sorted.
    A pass narrows an interval to a ``bins``-th: values of ordinary spread take two to five passes at any number of rows.
    """
    columns = [c for c in ranks if ranks[c]]
    if not columns:
        return {}
    good = {c: F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    ends = df.agg(*[f(good[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    #: (column, rank) -> least and largest value it may have, and how many values lie before the least.
    open_at = {(c, r): (ends[f"a{i}"], ends[f"b{i}"], 0) for i, c in enumerate(columns) for r in sorted(set(ranks[c]))}
    found: dict[tuple[str, int], float] = {}
    while True:
        for key, (low, high, _) in list(open_at.items()):
            if low is None or low == high:
                found[key] = math.nan if low is None else low
                del open_at[key]
        if not open_at:
            return found
        spans = list(dict.fromkeys((c, low, high) for (c, _), (low, high, _) in open_at.items()))
        parts = []
        for i, (c, low, high) in enumerate(spans):
            v = good[c]
            at = F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1)).cast("int")
            parts.append(F.when((v >= low) & (v <= high), F.struct(F.lit(i).alias("span"), at.alias("bin"), v.alias("v"))))
        rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy("p.span", "p.bin").agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("low"), F.max("p.v").alias("high"))
        seen: dict[int, list] = {}
        for r in rows.collect():  # at most ``bins`` rows a span
            seen.setdefault(r.span, []).append((r.bin, r.n, r.low, r.high))
        for (c, rank), (low, high, before) in list(open_at.items()):
            for _, n, a, b in sorted(seen[spans.index((c, low, high))]):
                if rank < before + n:
                    open_at[c, rank] = (a, b, before)
                    break
                before += n


def quantiles(df: DataFrame, probabilities: dict[str, list[float]], bins: int = 1024) -> dict[str, list[float]]:
    """Exact quantiles, linear between order statistics, of each column's finite values; NaN where there are none."""
    columns = list(probabilities)
    if not columns:
        return {}
    row = df.agg(*[F.count(F.when(is_finite(F.col(c).cast("double")), 1)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    n = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    place = {c: [p * (n[c] - 1) for p in probabilities[c]] for c in columns if n[c]}
    got = order_statistics(df, {c: [r for x in at for r in (math.floor(x), math.ceil(x))] for c, at in place.items()}, bins)
    out = {}
    for c in columns:
        out[c] = [math.nan] * len(probabilities[c])
        for i, x in enumerate(place.get(c, [])):
            a, b = got[c, math.floor(x)], got[c, math.ceil(x)]
            out[c][i] = a + (b - a) * (x - math.floor(x)) if a != b else a
    return out
