"""Histograms, free-energy surfaces, densities and what is read off them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.constants import TINY, kt
from framewright.functions.linalg import blur
from framewright.functions.scalars import free_energy, inside_bin, wrap_half_open
from framewright.operators.quantiles import quantiles


def whole() -> Window:
    """All rows as one window: for tables of one row a bin only."""
    return Window.partitionBy()


def value_range(df: DataFrame, columns: list[str], probabilities: tuple[float, float] | None = None) -> dict[str, tuple[float, float]]:
    """Least and largest value of each column, in one aggregation, or two of its exact quantiles."""
    if probabilities:
        return {c: (v[0], v[1]) for c, v in quantiles(df, {c: list(probabilities) for c in columns}).items()}
    row = df.agg(*[x.alias(f"v{2 * i + j}") for i, c in enumerate(columns) for j, x in enumerate((F.min(c), F.max(c)))]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, weight: str | None = None) -> DataFrame:
    """(bin, n) of values inside [low, high]; weights are summed."""
    own = df.where(F.col(column).between(low, high)).select(inside_bin(F.col(column), low, high, bins).alias("bin"), *([F.col(weight).alias("w")] if weight else []))
    return own.groupBy("bin").agg((F.sum("w") if weight else F.count(F.lit(1))).alias("n"))


def shifted(df: DataFrame, p: Column, temperature: float) -> DataFrame:
    """Add ``free_energy``: -kT ln p with its least at 0, null for empty cells."""
    return df.withColumn("_f", free_energy(p, kt(temperature))).withColumn("free_energy", F.col("_f") - F.min("_f").over(whole())).drop("_f")


def pmf(df: DataFrame, column: str, low: float, high: float, bins: int = 100, temperature: float = 300.0, weight: str | None = None) -> DataFrame:
    """(bin, lo, hi, n, density, free_energy) of a column; bins without values are absent."""
    width = (high - low) / bins
    h = histogram(df, column, low, high, bins, weight)
    out = h.select("bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), "n", (F.col("n") / (F.sum("n").over(whole()) * width)).alias("density"))
    return shifted(out, F.col("density"), temperature)


def fes(df: DataFrame, x: str, y: str, ranges: dict[str, tuple[float, float]], bins: tuple[int, int], temperature: float = 300.0, weight: str | None = None, least: float = 0, periodic: bool = False) -> DataFrame:
    """(bx, by, n, p, free_energy) over a grid; cells under ``least`` are masked (null).

    Periodic columns are wrapped into [-pi, pi) first; otherwise the ranges are pushed to the scan.
    """
    if not periodic:
        df = df.where(F.col(x).between(*ranges[x]) & F.col(y).between(*ranges[y]))
    get = lambda c: wrap_half_open(F.col(c)) if periodic else F.col(c)
    own = df.select(inside_bin(get(x), *ranges[x], bins[0]).alias("bx"), inside_bin(get(y), *ranges[y], bins[1]).alias("by"), *([F.col(weight).alias("w")] if weight else []))
    cells = own.where("bx is not null and by is not null").groupBy("bx", "by").agg((F.sum("w") if weight else F.count(F.lit(1))).alias("n"))
    cells = cells.withColumn("p", F.col("n") / F.sum("n").over(whole()))
    return shifted(cells, F.when(F.col("n") >= least, F.col("p")), temperature)


def adaptive_bins(df: DataFrame, x: str, y: str, request: tuple[int, int] = (100, 100), least: int = 1, filled: float = 0.6, rounds: int = 10) -> tuple[dict, tuple[int, int], DataFrame]:
    """Ranges, bins and cells of a grid on the middle 98 percent of both columns.

    Bins start at the largest of the request, the Freedman-Diaconis number and the root of n, within
    8 to 512, and shrink by a quarter while fewer than ``filled`` of the cells have ``least`` values. Each try is
    one aggregation to at most bins squared cells.
    """
    n = df.count()
    q = quantiles(df, {c: [0.01, 0.25, 0.75, 0.99] for c in (x, y)})
    ranges = {c: (q[c][0], q[c][3]) for c in (x, y)}
    bins = []
    for want, c in zip(request, (x, y), strict=True):
        step = 2 * (q[c][2] - q[c][1]) / max(n, 1) ** (1 / 3)
        bins.append(int(min(512, max(8, want, (q[c][3] - q[c][0]) / step if step > 0 else 0, n**0.5))))
    for _ in range(rounds + 1):
        cells = fes(df, x, y, ranges, (bins[0], bins[1]), least=least)
        if cells.where(F.col("n") >= least).count() >= filled * bins[0] * bins[1] or max(bins) <= 8:
            break
        bins = [max(8, int(0.75 * b)) for b in bins]
    return ranges, (bins[0], bins[1]), cells


def grid_of(cells: DataFrame, bins: tuple[int, int], value: str = "n") -> np.ndarray:
    """A dense grid of a small table of cells."""
    out = np.zeros(bins)
    for r in cells.select("bx", "by", value).collect():
        out[r.bx, r.by] = r[value]
    return out


def smoothed_fes(grid: np.ndarray, temperature: float = 300.0, sigma: float = 0.6, wrap: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Blurred density to free energy; empty cells are infinite, the least is 0."""
    p = blur(grid / grid.sum(), sigma, wrap)
    with np.errstate(divide="ignore"):
        f = np.where(p > TINY, -kt(temperature) * np.log(np.maximum(p, 1e-300)), np.inf)
    return f - f[np.isfinite(f)].min()


def sparse_bin_repair(grid: np.ndarray, least: float) -> np.ndarray:
    """Cells under ``least`` get their neighbours' mean (at least ``least``) if that is positive; the total stays."""
    wide = np.pad(grid, 1, mode="edge")
    around = (sum(wide[1 + a : wide.shape[0] - 1 + a, 1 + b : wide.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) - grid) / 8
    out = np.where((grid < least) & (around > 0), np.maximum(around, least), grid)
    return out * (grid.sum() / out.sum()) if out.sum() > 0 else out


def adaptive_bandwidth(ess: np.ndarray, h0: float = 1.2, reference: float = 50.0, least: float = 0.4, most: float = 3.0) -> np.ndarray:
    """h0 sqrt(reference / ess) within bounds."""
    return np.clip(h0 * np.sqrt(reference / np.maximum(ess, 1e-12)), least, most)


def adaptive_blur(grid: np.ndarray, bandwidth: np.ndarray, levels: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0)) -> np.ndarray:
    """Cellwise blend of blurs at neighbouring levels."""
    stack = np.stack([blur(grid, s) for s in levels])
    at = np.interp(bandwidth, levels, np.arange(len(levels)))
    low = np.minimum(at.astype(int), len(levels) - 2)
    i, j = np.indices(grid.shape)
    return (1 - (at - low)) * stack[low, i, j] + (at - low) * stack[low + 1, i, j]


def uncertainty(grid: np.ndarray, alpha: float = 1e-6, scale: float = 1.0) -> np.ndarray:
    """Standard deviation of a cell's free energy, in units of ``scale``."""
    from framewright.functions.linalg import trigamma

    return scale * np.sqrt(trigamma(grid + alpha) + trigamma(np.full(grid.shape, grid.sum() + alpha * grid.size)))


#: Widths beyond which a Gaussian kernel is left out: it is under 3e-16 of its top there.
REACH = 8.5


def near_values(rows: DataFrame, column: str, axis: DataFrame, width: float, periodic: bool) -> DataFrame:
    """``rows`` with each value ``g`` of ``axis(g)`` within the kernel's reach, and the kernel ``k`` between them.

    Both sides are dealt to strips as wide as the reach and meet in a row's own strip and its two neighbours.
    """
    strips = max(1, int(2 * np.pi / (REACH * width))) if periodic else 0
    strip = lambda v: F.floor((wrap_half_open(v) + np.pi) / (2 * np.pi / strips)).cast("long") if periodic else F.floor(v / (REACH * width)).cast("long")
    turned = lambda s: F.pmod(s, F.lit(strips)) if periodic else s
    own = rows.withColumn("_s", F.explode(F.array_distinct(F.array(*[turned(strip(F.col(column)) + i) for i in (-1, 0, 1)]))))
    d = F.col("g") - F.col(column)
    d = (wrap_half_open(d) if periodic else d) / width
    met = own.join(axis.withColumn("_s", turned(strip(F.col("g")))), "_s").drop("_s").withColumn("_d", d)
    return met.where(F.abs("_d") <= REACH).withColumn("k", F.exp(-F.col("_d") * F.col("_d") / 2)).drop("_d")


def kernel_density(spark: SparkSession, cells: DataFrame, points: DataFrame, width: float, periodic: bool = False) -> DataFrame:
    """(gx, gy, density) at grid ``points(gx, gy)`` from weighted, pre-binned ``cells(x, y, w)``.

    The kernel is a product, so cells are spread along x to the grid's columns within reach, summed, and then along
    y: rows are cells times the grid values within the reach, not cells times points. Kernels beyond 8.5 widths are
    left out, under 3e-16 of a kernel's top each; points out of every cell's reach have density 0. A periodic
    axis is wrapped into [-pi, pi).
    """
    total = cells.agg(F.sum("w")).first()[0]
    along = near_values(cells.groupBy("x", "y").agg(F.sum("w").alias("w")), "x", points.select(F.col("gx").alias("g")).distinct(), width, periodic)
    columns = along.groupBy(F.col("g").alias("gx"), "y").agg(F.sum(F.col("w") * F.col("k")).alias("w"))
    across = near_values(columns, "y", points.select(F.col("gy").alias("g")).distinct(), width, periodic)
    grid = across.groupBy("gx", F.col("g").alias("gy")).agg(F.sum(F.col("w") * F.col("k")).alias("v"))
    share = F.col("v") / (2 * np.pi * width * width * total) if total else F.lit(None).cast("double")
    return points.join(grid, ["gx", "gy"], "left").select("gx", "gy", F.when(F.lit(bool(total)), F.coalesce(share, F.lit(0.0))).alias("density"))


def scott_bandwidth(n_effective: float, spread: float, dims: int = 2, silverman: bool = False) -> float:
    """Bandwidth of a Gaussian kernel by Scott's or Silverman's rule."""
    base = n_effective * (dims + 2) / 4 if silverman else n_effective
    return spread * base ** (-1 / (dims + 4))


def local_minima(cells: DataFrame, bins: tuple[int, int], value: str = "free_energy") -> DataFrame:
    """Interior cells with all eight neighbours present that are their 3 x 3 least and have a larger neighbour."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    own = cells.where(F.col(value).isNotNull())
    spread = own.select("bx", "by", F.col(value).alias("v"), near.alias("d")).select((F.col("bx") + F.col("d.a")).alias("bx"), (F.col("by") + F.col("d.b")).alias("by"), "v")
    around = spread.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("low"), F.max("v").alias("top"))
    hit = own.join(around, ["bx", "by"]).where((F.col("k") == 9) & (F.col(value) == F.col("low")) & (F.col("top") > F.col(value)))
    return hit.where(F.col("bx").between(1, bins[0] - 2) & F.col("by").between(1, bins[1] - 2)).select("bx", "by", value)


def frames_near(frames: DataFrame, minima: DataFrame, surface: DataFrame | None = None, delta: float = 0.0, most: int | None = None) -> DataFrame:
    """All frames of each minimum's cell with the minimum as ``min_bx`` and ``min_by``; ``frames`` carry bx and by.

    With ``surface(bx, by, free_energy)`` a minimum whose cell holds no frame gets those of all cells
    within ``delta`` of its own free energy. ``most`` (off by default) keeps the first by trajectory and frame.
    """
    at = minima.select(F.col("bx").alias("min_bx"), F.col("by").alias("min_by")).distinct()
    cells = at.withColumn("bx", F.col("min_bx")).withColumn("by", F.col("min_by"))  # at most one row a grid cell, as all below
    if surface is not None:
        empty = cells.join(frames.select("bx", "by").distinct(), ["bx", "by"], "left_anti").select("min_bx", "min_by")
        own = surface.select(F.col("bx").alias("min_bx"), F.col("by").alias("min_by"), F.col("free_energy").alias("_low"))
        near = empty.join(own, ["min_bx", "min_by"]).join(F.broadcast(surface.select("bx", "by", "free_energy")), F.expr(f"free_energy <= _low + {float(delta)!r}D"))
        cells = cells.unionByName(near.select("min_bx", "min_by", "bx", "by")).distinct()
    hit = frames.join(F.broadcast(cells), ["bx", "by"])
    if most is None:
        return hit
    w = Window.partitionBy("min_bx", "min_by").orderBy("traj_id", "frame")
    return hit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def coverage(df: DataFrame, x: str, y: str, ranges: dict, bins: int) -> DataFrame:
    """Share of the grid's cells that were visited."""
    cell = inside_bin(F.col(x), *ranges[x], bins) * bins + inside_bin(F.col(y), *ranges[y], bins)
    return df.agg((F.count_distinct(cell) / (bins * bins)).alias("coverage"))


def sign_changes(frames: DataFrame, column: str) -> DataFrame:
    """(traj_id, changes): how often the sign differs from that of the frame before."""
    w = Window.partitionBy("traj_id").orderBy("frame")
    s = frames.select("traj_id", F.signum(column).alias("s"), F.lag(F.signum(column)).over(w).alias("b"))
    return s.groupBy("traj_id").agg(F.sum(F.coalesce((F.col("s") != F.col("b")).cast("long"), F.lit(0))).alias("changes"))


def kl_divergence(reference: DataFrame, estimate: DataFrame, key: str = "bin", pseudo: float = TINY) -> DataFrame:
    """KL(reference || estimate) of two (key, n) histograms, each with ``pseudo`` added to its share."""
    share = lambda df, c: df.select(key, (F.col("n") / F.sum("n").over(whole())).alias(c))
    both = share(reference, "p").join(share(estimate, "q"), key, "full_outer").select(*[(F.coalesce(c, F.lit(0.0)) + pseudo).alias(c) for c in "pq"])
    shares = both.select(*[(F.col(c) / F.sum(c).over(whole())).alias(c) for c in "pq"])
    return shares.agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))
