"""Queries on streams, run to their end over finite folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans.registry import query
from framewright.sources import frames as S
from framewright.sources.shared import shared_folder
from framewright.streaming import detectors as D
from framewright.streaming import ordered as O

#: Longer than the events last: frames dealt by hash come as late as that.
ALL = "36500 days"


def _as_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of a table as a file stream from the shared folder."""
    folder = shared_folder(spark, "stream")
    df.write.parquet(folder)
    return D.read_stream(spark, df.schema, folder, 1000)


def _frames_as_stream(spark: SparkSession, d: str) -> DataFrame:
    """(traj_id, frame, x, ts) of the events, dealt by hash over three micro-batches, so that frames come out of order."""
    frames = S.numbered(S.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("traj_id"), "frame", F.col("value").alias("x"), F.col("ts").cast("timestamp").alias("ts"))
    folder = shared_folder(spark, "stream")
    frames.repartition(3 * max(2, spark.sparkContext.defaultParallelism), F.xxhash64("traj_id", "frame")).write.parquet(folder)
    files = max(1, len(spark.read.parquet(folder).inputFiles()) // 3)
    return D.read_stream(spark, frames.schema, folder, files)


def _run(df: DataFrame, mode: str) -> DataFrame:
    return D.run_to_files(df, shared_folder(df.sparkSession, "stream-out"), mode)


@query("live_counts", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def live_counts(spark, d):
    e = S.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return _run(D.live_counts(_as_stream(spark, e)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("adwin_drift")
def adwin_drift(spark, d):
    return _run(O.drift(_frames_as_stream(spark, d), delay=ALL), "append")


@query("fixed_trigger", "WITH e AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) SELECT traj_id, CAST(frame AS BIGINT) AS frame FROM e WHERE frame % 25 = 24")
def fixed_trigger(spark, d):
    return _run(O.triggers(_frames_as_stream(spark, d), "fixed", 25, delay=ALL), "append")


@query("bias_ledger")
def bias_ledger(spark, d):
    return _run(O.bias_ledger(_frames_as_stream(spark, d), 10, 10.0, delay=ALL), "append")


@query("training_window", "WITH e AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) SELECT traj_id, CAST(frame AS BIGINT) AS frame FROM e WHERE frame <= 40 AND frame > 20")
def training_window(spark, d):
    return D.training_window(S.event_frames(spark, d).select("traj_id", "frame"), 40, 20)


@query("sliding_windows", "WITH b AS (SELECT event_type, value, date_trunc('hour', ts) AS h FROM events), w AS (SELECT h AS start, event_type, value FROM b UNION ALL SELECT h - INTERVAL 1 HOUR, event_type, value FROM b) SELECT CAST(start AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def sliding_windows(spark, d):
    """Extension: two-hour windows every hour."""
    e = S.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
