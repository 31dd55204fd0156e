"""Canonical frames (traj_id, frame, ...) from tables, and reading and writing them."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.sources.binary_frames import KINDS, read_binary_frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, traj: str, order: list[str]) -> DataFrame:
    """Add ``frame``, 0-based within each trajectory; ``order`` must have no ties."""
    return df.withColumn("frame", F.row_number().over(Window.partitionBy(traj).orderBy(*order)).cast("long") - 1)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, frame, state, x, event_id) of ``events``: a trajectory a user, in time order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("traj_id"), "ts", "event_id", F.col("event_type").alias("state"), F.col("value").alias("x"))
    return numbered(e, "traj_id", ["ts", "event_id"]).select("traj_id", "frame", "state", "x", "event_id")


def conversation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, frame, state) of ``conversations``: a trajectory a conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("frame"), F.col("role").alias("state"))


def scan(frames: DataFrame, start: int = 0, stop: int | None = None, stride: int = 1) -> DataFrame:
    """Frames with start <= frame < stop, every ``stride``-th from start; the range is pushed to the scan.

    A negative start counts as 0 and a stride under 1 as 1.
    """
    start, stride = max(0, start), max(1, stride)
    out = frames.where(F.col("frame") >= start)
    if stop is not None:
        out = out.where(F.col("frame") < stop)
    return out if stride == 1 else out.where((F.col("frame") - start) % stride == 0)


def probe_length(frames: DataFrame) -> DataFrame:
    """(traj_id, n_frames)."""
    return frames.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_frames"))


READERS = {"parquet", "orc", "json", "csv"}


def read_frames(spark: SparkSession, paths: list[str], fmt: str = "parquet", schema=None, ignore_errors: bool = False) -> DataFrame:
    """Frames of several files with the file as ``path``; unknown formats raise, bad files only if asked to.

    Binary trajectories (xtc, trr, nc, ncdf, dcd) have a schema of their own.
    """
    if fmt in KINDS:
        return read_binary_frames(spark, paths, ignore_errors=ignore_errors)
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}; known: {sorted(READERS | set(KINDS))}")
    reader = spark.read.format(fmt).option("ignoreMissingFiles", ignore_errors).option("ignoreCorruptFiles", ignore_errors)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths).withColumn("path", F.col("_metadata.file_path"))


def select_atoms(atoms: DataFrame, ids: list[int] | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of (traj_id, frame, atom_id, name, x, y, z) of chosen atoms; nothing chosen means all."""
    out = atoms
    if ids is not None:
        out = out.where(F.col("atom_id").isin(ids))
    if names is not None:
        out = out.where(F.col("name").isin(names))
    return out


def last_frames(frames: DataFrame, jitter: float = 0.0, seed: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
    """The last frame of each trajectory; Gaussian noise of ``jitter`` on ``columns``, drawn from hashes of (seed, column, trajectory)."""
    rest = [c for c in frames.columns if c != "traj_id"]
    out = frames.groupBy("traj_id").agg(F.max_by(F.struct(*rest), "frame").alias("r")).select("traj_id", "r.*")
    for k, c in enumerate(columns if jitter else ()):
        u, v = ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(2 * k + i), "traj_id"), 11).cast("double") + 0.5) / float(1 << 53) for i in (0, 1))
        out = out.withColumn(c, F.col(c) + jitter * F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v))
    return out


def write_frames(frames: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Append frames to a Parquet folder; the commit protocol makes the step atomic."""
    frames.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder a result table: counts, matrices, state tables, assignments."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def union_aligned(parts: list[DataFrame], spark: SparkSession | None = None, schema=None) -> DataFrame:
    """Rows of all parts by column name, absent columns null; the empty table of ``schema`` without parts."""
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def feature_cache(frames: DataFrame, key: str, folder: str) -> DataFrame:
    """``frames`` from the cache folder of ``key`` (a hash of what made them), written there at first."""
    path = f"{folder}/{key}"
    spark = frames.sparkSession
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").schema  # noqa: B018
    except AnalysisException:  # no such file: nothing was written, or not to its end
        frames.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_safe(value):
    """A value as JSON allows it: arrays as lists, NaN and infinities as null, paths as text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if hasattr(value, "tolist"):
        return json_safe(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return str(value) if isinstance(value, Path) else value


def to_json(value) -> str:
    return json.dumps(json_safe(value), sort_keys=True)


RESULT_VERSION = "1.0"


def result_json(result: dict, metadata_only: bool = False) -> str:
    """A result as JSON with its version; arrays keep their kind, or only shape and kind with ``metadata_only``."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if hasattr(v, "dtype") and hasattr(v, "shape") and v.shape:
            return {"__array__": None if metadata_only else json_safe(v), "shape": list(v.shape), "dtype": str(v.dtype)}
        return json_safe(v)

    return json.dumps({"schema_version": RESULT_VERSION, "result": plain(result)}, sort_keys=True)


def result_from_json(text: str) -> dict:
    """The result of such a text, arrays as numpy arrays (NaN where there was no number); another version raises."""
    import numpy as np

    def back(v):
        if isinstance(v, dict) and "__array__" in v:
            if v["__array__"] is None:
                return {"shape": tuple(v["shape"]), "dtype": v["dtype"]}
            kind = np.dtype(v["dtype"])
            return np.array(v["__array__"], "f8" if kind.kind == "f" else kind).astype(kind).reshape(v["shape"])
        if isinstance(v, dict):
            return {k: back(x) for k, x in v.items()}
        return [back(x) for x in v] if isinstance(v, list) else v

    whole = json.loads(text)
    if whole.get("schema_version") != RESULT_VERSION:
        raise ValueError(f"unknown result version {whole.get('schema_version')!r}")
    return back(whole["result"])


def macro_map_json(mapping: Column) -> Column:
    """``{"micro_to_macro": [...]}`` of an array column."""
    return F.to_json(F.struct(mapping.alias("micro_to_macro")))


def macro_map_parse(text: Column) -> Column:
    """The array of such a text; null if the text is none."""
    return F.from_json(text, "micro_to_macro array<int>")["micro_to_macro"]
