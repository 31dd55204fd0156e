"""Bias of all earlier hills by cells of merged hills over dyadic ranges of time.

The sum of Gaussians that earlier frames have left is not taken hill by hill. Time is cut into short blocks; every
dyadic range of blocks has a table of cells along x, each with the coefficients of a Hermite series that stands for all
its hills. The blocks before a frame's own are the union of as many ranges as their number has binary ones, so
a frame meets a logarithmic number of ranges times the cells within reach, and hills one by one in its own block only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of the series, reach in widths, and frames of a block. A hill half a width off its cell's middle is
#: off by less than 1e-15 at twenty terms; one out of reach is under 3e-16.
TERMS, REACH, BLOCK = 20, 8.5, 64


def hermite_table(terms: int) -> np.ndarray:
    """Coefficients of the probabilists' Hermite polynomials: row m gives He_m by powers of x."""
    table = np.zeros((terms, terms))
    table[0, 0] = 1
    for m in range(1, terms):
        table[m, 1:] = table[m - 1, :-1]
        table[m] -= (m - 1) * table[m - 2] if m > 1 else 0
    return table


def merged_hills(hills: DataFrame, width: float, levels: int, block: int, terms: int) -> DataFrame:
    """(traj_id, level, range, cell, power series) of ``hills(traj_id, frame, x, height)``.

    Level l has ranges of 2^l blocks; only even ones are ever a part of a prefix. The series' coefficients are sums
    over the hills, so a hot trajectory's are added up in many tasks before they meet.
    """
    cell = F.floor(F.col("x") / width)
    at = F.col("x") / width - cell - 0.5  # the hill from its cell's middle, in widths
    own = hills.select("traj_id", F.floor(F.col("frame") / block).alias("b"), cell.alias("cell"), at.alias("t"), "height")
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("range", F.floor(F.col("b") / F.pow(F.lit(2.0), F.col("level"))).cast("long")).where("range % 2 = 0")
    moments = own.groupBy("traj_id", "level", "range", "cell").agg(*[F.sum(F.col("height") * F.pow("t", F.lit(float(m))) / math.factorial(m)).alias(f"m{m}") for m in range(terms)])
    table = hermite_table(terms)
    power = [sum((F.col(f"m{m}") * float(table[m, j]) for m in range(j, terms) if table[m, j]), F.lit(0.0)) for j in range(terms)]
    return moments.select("traj_id", "level", "range", "cell", *[p.alias(f"a{j}") for j, p in enumerate(power)])


def series(x: Column, terms: int) -> Column:
    """The power series a0 + a1 x + ... by Horner's rule."""
    out = F.col(f"a{terms - 1}")
    for j in range(terms - 2, -1, -1):
        out = out * x + F.col(f"a{j}")
    return out


def hill_bias(frames: DataFrame, hills: DataFrame, width: float, block: int = BLOCK, terms: int = TERMS, reach: float = REACH) -> DataFrame:
    """(traj_id, frame, bias): sum of height exp(-(x - h)^2 / (2 width^2)) over the earlier hills of each frame's trajectory.

    ``frames(traj_id, frame, x)`` are numbered from 0 without repeats, ``hills(traj_id, frame, x, height)`` are of any
    of those numbers; hills of the frame itself and of later ones do not count. The error is under 1e-15 of the
    sum of the heights. Frames and hills are dealt by trajectory, range and cell: however long a trajectory,
    it is spread over tasks, and the joined rows are its length times the logarithm of it. Hills with a null or
    non-finite x do not count; a frame with one has no bias (null). Without hills the bias is 0.
    """
    ok = lambda t: t.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    hills = ok(hills)
    last = frames.agg(F.max("frame")).first()[0]
    levels = max(0, int(math.floor(math.log2(max(1, (last or 0) // block)))))
    table = merged_hills(hills, width, levels, block, terms)
    own = ok(frames).select("traj_id", "frame", "x", F.floor(F.col("frame") / block).alias("b"))
    n = math.ceil(reach + 0.5)
    half = F.floor(F.col("b") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    asked = own.where("b > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("range", half - 1).where("range % 2 = 0 and range >= 0")
    asked = asked.select("traj_id", "frame", "level", "range", "x", F.explode(F.sequence(F.floor(F.col("x") / width) - n, F.floor(F.col("x") / width) + n)).alias("cell"))
    d = F.col("x") / width - F.col("cell") - 0.5
    far = asked.join(table, ["traj_id", "level", "range", "cell"]).select("traj_id", "frame", (F.exp(-d * d / 2) * series(d, terms)).alias("v"))
    near = own.join(hills.select("traj_id", F.floor(F.col("frame") / block).alias("b"), F.col("frame").alias("h"), F.col("x").alias("hx"), "height"), ["traj_id", "b"]).where("h < frame")
    gap = (F.col("x") - F.col("hx")) / width
    close = near.select("traj_id", "frame", (F.col("height") * F.exp(-gap * gap / 2)).alias("v"))
    none = frames.select("traj_id", "frame", F.when(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")), F.lit(0.0)).alias("v"))
    return far.union(close).union(none).groupBy("traj_id", "frame").agg(F.sum("v").alias("bias"))
