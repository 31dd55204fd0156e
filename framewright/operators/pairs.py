"""Segments and lagged pairs: offset joins within trajectories by one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.sources.shared import shared_folder


def order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("frame")


def valid_runs(frames: DataFrame, valid: Column) -> DataFrame:
    """Valid frames with ``seg_id``: runs of consecutive valid frames of a trajectory (gaps and islands)."""
    own = frames.where(valid)
    return own.withColumn("seg_id", F.col("frame") - F.row_number().over(order("traj_id")))


def compacted(frames: DataFrame, valid: Column) -> DataFrame:
    """Valid frames renumbered without gaps, so that survivors become neighbours."""
    own = frames.where(valid)
    return own.withColumn("frame", F.row_number().over(order("traj_id")).cast("long") - 1)


def lagged_pairs(frames: DataFrame, tau: int, columns: list[str], keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Rows (keys, frame, tau, c_0, c_tau ...) of frames ``tau`` rows apart within ``keys``."""
    if tau < 1:
        raise ValueError("the lag must be at least 1")
    w = order(*keys)
    ahead = [F.lead(c, tau).over(w).alias(f"{c}_t") for c in columns]
    out = frames.select(*keys, "frame", F.lead("frame", tau).over(w).alias("_f"), *[F.col(c).alias(f"{c}_0") for c in columns], *ahead)
    return out.where("_f is not null").select(*keys, "frame", F.lit(tau).alias("tau"), *[f"{c}_{s}" for c in columns for s in "0t"])


def multi_lag_pairs(frames: DataFrame, taus: list[int], column: str, keys: tuple[str, ...] = ("traj_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frame, tau, src, dst) for several lags in one window and one explode."""
    if not taus or min(taus) < 1:
        raise ValueError("lags must be at least 1")
    w = order(*keys)
    pairs = F.array(*[F.struct(F.lit(t).alias("tau"), F.lead(column, t).over(w).alias("dst"), F.lead("frame", t).over(w).alias("f")) for t in taus])
    out = frames.select(*keys, "frame", *carry, F.col(column).alias("src"), pairs.alias("p"))
    return out.select(*keys, "frame", *carry, "src", F.explode("p").alias("p")).where("p.f is not null").select(*keys, "frame", *carry, F.col("p.tau").alias("tau"), "src", F.col("p.dst").alias("dst"))


def gathered_pairs(frames: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Given ``pairs(i, j)`` of global frames with i < j, the values at both; others are left out."""
    side = lambda s: frames.select(F.col("global_frame").alias(s), F.col(column).alias(f"{column}_{s}"))
    return pairs.where("i < j").join(side("i"), "i").join(side("j"), "j")


def expected_pairs(length: Column, tau: int | Column, stride: int | Column = 1) -> Column:
    """Pairs of a segment: 1 + (L - tau - 1) div stride if L > tau, else 0."""
    tau, stride = (F.lit(v) if isinstance(v, int) else v for v in (tau, stride))
    return F.when(length > tau, 1 + F.floor((length - tau - 1) / F.greatest(stride, F.lit(1)))).otherwise(0).cast("long")


def pair_diagnostics(lengths: DataFrame, taus: list[int]) -> DataFrame:
    """One row a lag over ``lengths(traj_id, n_frames)``: usable and possible pairs, coverage, short trajectories."""
    longest = max(taus)
    rows = lengths.select("traj_id", "n_frames", F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    usable = expected_pairs(F.col("n_frames"), F.col("tau"))
    possible = F.greatest(F.col("n_frames") - 1, F.lit(0))
    out = rows.groupBy("tau").agg(F.sum(usable).alias("usable"), F.sum(possible).alias("possible"), F.sum((F.col("n_frames") <= longest).cast("long")).alias("short"))
    return out.withColumn("coverage", F.col("usable") / F.nullif(F.col("possible"), F.lit(0)))


def running_offsets(lengths: DataFrame) -> DataFrame:
    """(traj_id, n_frames, offset): global frame of each trajectory's first frame.

    The lengths are written in ranges of traj_id, one file a range; sums run over the files, then within each,
    so no task sorts all trajectories.
    """
    spark, folder = lengths.sparkSession, shared_folder(lengths.sparkSession, "offsets")
    lengths.repartitionByRange("traj_id").write.parquet(folder)
    rows = spark.read.schema(lengths.schema).parquet(folder).withColumn("_file", F.col("_metadata.file_name"))
    files = rows.groupBy("_file").agg(F.min("traj_id").alias("_first"), F.sum("n_frames").alias("_n"))
    before = files.select("_file", (F.sum("_n").over(Window.orderBy("_first")) - F.col("_n")).alias("_before"))  # a row a file
    w = Window.partitionBy("_file").orderBy("traj_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.col("_before") + F.sum("n_frames").over(w) - F.col("n_frames")
    return rows.join(F.broadcast(before), "_file").withColumn("offset", offset.cast("long")).drop("_file", "_before")


def global_frames(frames: DataFrame) -> DataFrame:
    """Frames with ``global_frame``, the place in all trajectories laid end to end."""
    lengths = frames.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return frames.join(running_offsets(lengths).select("traj_id", "offset"), "traj_id").withColumn("global_frame", F.col("offset") + F.col("frame")).drop("offset")


def locate(queries: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """Local frame of each ``queries(g)`` in ``segments(path, start, stop, local_start, local_stride)``.

    A range join through buckets of ``width`` frames, so it is an equi-join; a miss gives no row.
    """
    cut = segments.where("stop > start").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    hit = queries.withColumn("_b", F.floor(F.col("g") / width)).join(cut, "_b").where("g >= start and g < stop")
    return hit.select("g", "path", (F.col("local_start") + (F.col("g") - F.col("start")) * F.greatest("local_stride", F.lit(1))).alias("local_frame"))


def expand_segments(segments: DataFrame) -> DataFrame:
    """Rows (split, seg_id, frame) of ``segments(split, seg_id, start, stop, stride)``; a stride under 1 is 1."""
    return segments.where("stop > start").select("split", "seg_id", F.explode(F.sequence("start", F.col("stop") - 1, F.greatest("stride", F.lit(1)))).alias("frame"))
