"""Moments in Spark, small eigenproblems on the driver, projections as Columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from framewright.functions import linalg
from framewright.functions.scalars import is_finite


#: Up to so many columns the moments are one SQL aggregation; beyond, Gram sums of whole batches.
NARROW = 12

#: Rows of an Arrow batch that numpy takes at a time; a batch of 10,000 rows would be held in several whole copies.
PIECE_ROWS = 1024


def unpacked(df: DataFrame, column: str, width: int, prefix: str = "x") -> DataFrame:
    """The first ``width`` entries of an array column as columns prefix0, prefix1, ..."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[k].cast("double").alias(f"{prefix}{k}") for k in range(width)])


def moments(df: DataFrame, left: list[str], right: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row count, means and population covariances (left-left, left-right, right-right) in one aggregation."""
    both = [*left, *(c for c in right if c not in left)]
    if len(both) > NARROW:
        n, mean, cov = gram_moments(df, both)
        i, j = np.arange(len(left)), np.array([both.index(c) for c in right])
        return n, mean[i], mean[j], cov[np.ix_(i, i)], cov[np.ix_(i, j)], cov[np.ix_(j, j)]
    cells = [(a, b) for i, a in enumerate(both) for b in both[i:]]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(both)], *[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(cells)]).first()
    mean = {c: row[f"m{i}"] for i, c in enumerate(both)}
    cov = {}
    for i, (a, b) in enumerate(cells):
        cov[a, b] = cov[b, a] = row[f"c{i}"] or 0.0
    m = lambda p, q: np.array([[cov[a, b] for b in q] for a in p], "f8")
    return row.n, np.array([mean[c] for c in left]), np.array([mean[c] for c in right]), m(left, left), m(left, right), m(right, right)


def _merged(sums: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Rows and (shift, pairs, sums, products) about one shift of several parts; [a, b] counts rows where both are given."""
    rows, whole = sums[0]
    for n, part in sums[1:]:
        step = (part[0] - whole[0])[0][:, None]  # the part's values lie so much higher about the common shift
        products = part[3] + step * part[2].T + step.T * part[2] + step * step.T * part[1]
        rows, whole = rows + n, np.stack([whole[0], whole[1] + part[1], whole[2] + part[2] + step * part[1], whole[3] + products])
    return rows, whole


def pieces(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The batch in slices of ``PIECE_ROWS`` rows, without a copy."""
    return [batch.slice(a, PIECE_ROWS) for a in range(0, batch.num_rows, PIECE_ROWS)]


def gram_moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariances of many columns by Gram sums; nulls are left out pair by pair."""
    d = len(columns)

    def one(rows: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])

    def read(batch) -> list[tuple[int, np.ndarray]]:
        return [(n, np.frombuffer(b).reshape(4, d, d)) for n, b in zip(batch["n"].to_pylist(), batch["sums"].to_pylist(), strict=True)]

    def gather(batches):
        whole = None
        for batch in (piece for whole_batch in batches for piece in pieces(whole_batch)):
            given = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype("f8")
            x = np.where(given > 0, np.column_stack([c.to_numpy(zero_copy_only=False).astype("f8") for c in batch.columns]), 0.0)
            shift = np.nan_to_num(x.sum(0) / np.maximum(given.sum(0), 1), posinf=0.0, neginf=0.0)
            x = np.where(given > 0, x - shift, 0.0)
            own = (batch.num_rows, np.stack([np.broadcast_to(shift, (d, d)), given.T @ given, x.T @ given, x.T @ x]))
            whole = own if whole is None else _merged([whole, own])
        if whole is not None:
            yield one(*whole)

    def join(batches):
        whole = None
        for batch in batches:
            for own in read(batch):
                whole = own if whole is None else _merged([whole, own])
        if whole is not None:
            yield one(*whole)

    parts = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(gather, "n long, sums binary")
    got = read(parts.repartition(8).mapInArrow(join, "n long, sums binary").toArrow())
    if not got:
        return 0, np.full(d, np.nan), np.zeros((d, d))
    rows, (shift, pairs, sums, products) = _merged(got)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = shift[0] + np.diag(sums) / np.diag(pairs)
        cov = np.where(pairs > 0, products / pairs - (sums / pairs) * (sums / pairs).T, 0.0)
    return rows, mean, (cov + cov.T) / 2


@dataclass
class Projection:
    """(x - mean) W as Columns, for many columns by batches."""

    columns: list[str]
    mean: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def apply(self, df: DataFrame, prefix: str = "ic") -> DataFrame:
        made: list[Column] = []
        if len(self.columns) > NARROW:  # thousands of terms are too much for a plan
            return self._over_batches(df, prefix)
        for k in range(self.basis.shape[1]):
            total = F.lit(0.0)
            for c, m, w in zip(self.columns, self.mean, self.basis[:, k], strict=True):
                total = total + (F.col(c) - float(m)) * float(w)
            made.append(total.alias(f"{prefix}{k}"))
        return df.select("*", *made)

    def _over_batches(self, df: DataFrame, prefix: str) -> DataFrame:
        columns, mean, basis = self.columns, np.asarray(self.mean, "f8"), np.asarray(self.basis, "f8")
        names = [*df.columns, *(f"{prefix}{k}" for k in range(basis.shape[1]))]

        def run(batches):
            for batch in batches:
                lost, y = np.empty(batch.num_rows, bool), np.empty((batch.num_rows, basis.shape[1]))
                for k, piece in enumerate(pieces(batch)):
                    own, at = [piece.column(c) for c in columns], slice(k * PIECE_ROWS, k * PIECE_ROWS + piece.num_rows)
                    lost[at] = ~np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in own]).all(1)
                    y[at] = (np.column_stack([c.to_numpy(zero_copy_only=False).astype("f8") for c in own]) - mean) @ basis
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.float64(), mask=lost, from_pandas=False) for v in y.T)], names=names)

        schema = StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in names[len(df.columns) :])])
        return df.mapInArrow(run, schema)


def _scaled(basis: np.ndarray, cov: np.ndarray, scale: bool) -> np.ndarray:
    return 1 / np.sqrt(np.where(np.diag(cov) > 1e-12, np.diag(cov), 1.0)) if scale else np.ones(len(cov))


def pca(df: DataFrame, columns: list[str], k: int = 2, scale: bool = True) -> Projection:
    _, mean, _, cov, _, _ = moments(df, columns, columns)
    s = _scaled(cov, cov, scale)
    values, basis = linalg.pca_basis(cov * np.outer(s, s), k)
    return Projection(columns, mean, basis * s[:, None], values)


def lagged_moments(frames: DataFrame, columns: list[str], tau: int, keys: tuple[str, ...] = ("traj_id",)):
    """Moments of (x at t, x at t + tau) within ``keys``."""
    from framewright.operators.pairs import lagged_pairs

    pairs = lagged_pairs(frames, tau, columns, keys)
    return moments(pairs, [f"{c}_0" for c in columns], [f"{c}_t" for c in columns])


def tica(frames: DataFrame, columns: list[str], tau: int = 1, k: int = 2, scale: bool = True, keys: tuple[str, ...] = ("traj_id",)) -> Projection:
    """Time-lagged independent components; both ends of the pairs count for the instantaneous covariance."""
    _, m0, mt, c00, c0t, ctt = lagged_moments(frames, columns, tau, keys)
    mean = (m0 + mt) / 2
    shift = np.outer(m0 - mean, m0 - mean)
    cov = (c00 + ctt) / 2 + shift
    lag = c0t + np.outer(m0 - mean, mt - mean)
    s = _scaled(cov, cov, scale)
    values, basis = linalg.tica_basis(cov * np.outer(s, s), lag * np.outer(s, s), k)
    return Projection(columns, mean, basis * s[:, None], values)


def vamp(frames: DataFrame, columns: list[str], tau: int = 1, k: int = 2, scale: bool = True, epsilon: float = 1e-6, keys: tuple[str, ...] = ("traj_id",)) -> Projection:
    _, m0, _, c00, c0t, ctt = lagged_moments(frames, columns, tau, keys)
    a, b = _scaled(c00, c00, scale), _scaled(ctt, ctt, scale)
    values, basis = linalg.vamp_basis(c00 * np.outer(a, a), c0t * np.outer(a, b), ctt * np.outer(b, b), k, epsilon)
    return Projection(columns, m0, basis * a[:, None], values)


def reduce_features(frames: DataFrame, columns: list[str], method: str = "pca", k: int = 2, tau: int = 1, scale: bool = True) -> Projection:
    """Dispatch to pca, tica or vamp."""
    if method == "pca":
        return pca(frames, columns, k, scale)
    if method in ("tica", "vamp"):
        return {"tica": tica, "vamp": vamp}[method](frames, columns, tau, k, scale)
    raise ValueError(f"unknown method {method!r}")


def standardised(df: DataFrame, columns: list[str], ddof: int = 0) -> DataFrame:
    """Missing values as the mean, then z-scores with population (0) or sample (1) deviation, floor 1e-10 as 1."""
    deviation = F.stddev_pop if ddof == 0 else F.stddev_samp
    finite = lambda c: F.when(is_finite(F.col(c)), F.col(c))
    row = df.agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(columns)], *[deviation(finite(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    z = []
    for i, c in enumerate(columns):
        mean, spread = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
        z.append(((F.coalesce(finite(c), F.lit(mean)) - mean) / (spread if spread > 1e-10 else 1.0)).alias(c))
    return df.select(*[c for c in df.columns if c not in columns], *z)


def whitened(df: DataFrame, columns: list[str]) -> Projection:
    """Projection to zero mean and unit covariance by the Cholesky factor."""
    n, mean, _, cov, _, _ = moments(df, columns, columns)
    if n <= len(columns):
        return Projection(columns, mean, np.eye(len(columns)), np.ones(len(columns)))
    factor = np.linalg.cholesky(cov + 1e-12 * np.eye(len(cov)))
    return Projection(columns, mean, np.linalg.inv(factor).T, np.ones(len(columns)))


def validated(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_finite, mean, std, min, max, error): the first of no finite row, non-finite rows, zero deviation."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    v = F.when(is_finite(F.col("v")), F.col("v"))
    out = df.select(one.alias("e")).select("e.*").groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_finite"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    error = F.when(F.col("n_finite") == 0, "cv_no_finite_rows").when(F.col("n_finite") < F.col("n"), "cv_non_finite").when(F.col("std") <= 1e-12, "cv_zero_std")
    return out.select("column", "n_finite", "mean", "std", "min", "max", error.alias("error"))


def schema_drift(fitted: list[str], candidate: DataFrame, split: str) -> None:
    """Raise if a split's columns differ from those fitted."""
    if list(candidate.columns) != list(fitted):
        raise ValueError(f"split {split!r} has columns {candidate.columns}, fitted were {fitted}")


def highest_variance(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """The k columns of the largest population variance, constants left out, ties by name."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    out = df.select(one.alias("e")).select("e.*").groupBy("column").agg(F.var_pop("v").alias("variance"))
    return out.where("variance > 1e-24").orderBy(F.desc("variance"), "column").limit(k)


def autocorrelation(frames: DataFrame, column: str, taus: list[int], keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """(tau, rho): mean product of z-scores tau apart, segments weighted by their pairs, within [-1, 1].

    Segments of zero variance are left out; rho at 0 is 1 by definition.
    """
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("frame")
    z = (F.col(column) - F.avg(column).over(whole)) / F.nullif(F.stddev_pop(column).over(whole), F.lit(0.0))
    own = frames.select(*keys, "frame", z.alias("z")).where("z is not null")
    ahead = F.array(*[F.struct(F.lit(t).alias("tau"), (F.col("z") * F.lead("z", t).over(w)).alias("v")) for t in taus])
    out = own.select(ahead.alias("a")).select(F.explode("a").alias("e")).where("e.v is not null").groupBy("e.tau").agg(F.avg("e.v").alias("rho"))
    return out.select("tau", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "rho")).alias("rho"))


def integrated_autocorrelation(taus: list[int], rho: list[float]) -> float:
    """1 + 2 times the trapezoid area of the curve up to its first value not above zero."""
    total, before = 0.0, (0, 1.0)
    for t, r in sorted(zip(taus, rho, strict=True)):
        if r <= 0:
            break
        total += (t - before[0]) * (r + before[1]) / 2
        before = (t, r)
    return 1 + 2 * total


def correlation(a: str, b: str, window: WindowSpec | None = None) -> Column:
    """Correlation of the pairs without a null; NaN where either side is constant (``corr`` fails there), null without a pair."""
    of = (lambda x: x.over(window)) if window is not None else (lambda x: x)
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    scale = of(F.stddev_pop(x)) * of(F.stddev_pop(y))
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(of(F.covar_pop(x, y)) / F.nullif(scale, F.lit(0.0)))


def vamp2_proxy(frames: DataFrame, columns: list[str], tau: int, keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Mean over columns of the squared correlation of values tau apart."""
    from framewright.operators.pairs import lagged_pairs

    pairs = lagged_pairs(frames, tau, columns, keys)
    squares = [F.pow(correlation(f"{c}_0", f"{c}_t"), F.lit(2.0)) for c in columns]
    return pairs.agg((sum(squares[1:], squares[0]) / len(columns)).alias("score"))


def moving_vamp2(frames: DataFrame, column: str, tau: int, window: int) -> DataFrame:
    """Squared lag correlation over the last ``window`` frames, at each frame; NaN where its values are constant."""
    w = Window.partitionBy("traj_id").orderBy("frame")
    tail = w.rowsBetween(-(window - 1), 0)
    own = frames.select("traj_id", "frame", F.col(column).alias("b"), F.lag(column, tau).over(w).alias("a"))
    return own.select("traj_id", "frame", F.pow(F.when(F.count("a").over(tail) > 1, correlation("a", "b", tail)), F.lit(2.0)).alias("score"))


def canonical_correlation(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Canonical correlations of two column sets."""
    n, _, _, cxx, cxy, cyy = moments(df, left, right)
    if n < 2:
        raise ValueError("too few rows")
    return linalg.canonical_correlations(cxx, cxy, cyy)
