"""Stateful operators on streams of frames: drift detection, triggers, windows and a bias ledger."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@functools.lru_cache(maxsize=1024)
def cut_bounds(n: int, delta: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both parts of a window of ``n`` at each cut that leaves ``least``, and the Hoeffding bound of their means."""
    a = np.arange(max(1, least), n - max(1, least) + 1)
    b = n - a
    return a, b, np.sqrt(0.5 * math.log(4 / delta) * (1 / a + 1 / b))


def adaptive_window_cut(values: list[float], delta: float, least: int = 5) -> int:
    """First cut of a window whose two means differ by more than the Hoeffding bound; 0 without one."""
    a, b, bound = cut_bounds(len(values), delta, least)
    if not len(a):
        return 0
    with np.errstate(all="ignore"):
        run = np.cumsum(values)[a - 1]
        hit = np.abs(run / a - (sum(values) - run) / b) > bound
    k = int(hit.argmax())
    return int(a[k]) if hit[k] else 0


def drift_step(window: list[float], value: float, delta: float = 0.002, most: int = 256) -> tuple[list[float], bool]:
    """Add a value to a bounded window; on drift the part before the cut goes."""
    window = [*window, value][-most:]
    cut = adaptive_window_cut(window, delta)
    return window[cut:], cut > 0


def replay_drift(values: list[float], delta: float = 0.002, most: int = 256) -> list[bool]:
    """The detector over a whole series; the batch twin of ``drift``."""
    window: list[float] = []
    out = []
    for v in values:
        window, hit = drift_step(window, v, delta, most)
        out.append(hit)
    return out


DRIFT = "traj_id long, frame long, drift boolean, width int"


def drift(frames: DataFrame, delta: float = 0.002, most: int = 256) -> DataFrame:
    """(traj_id, frame, drift, width) of a stream of (traj_id, frame, x): the bounded window is the state of a key.

    Rows of a micro-batch are taken in frame order; frames that come in a later micro-batch than their
    successors are detected on in the order of the micro-batches.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for f, v in zip(rows["frame"], rows["x"], strict=True):
            window, hit = drift_step(window, float(v), delta, most)
            out.append((key[0], f, hit, len(window)))
        state.update((window,))
        yield pd.DataFrame(out, columns=["traj_id", "frame", "drift", "width"])

    return frames.groupBy("traj_id").applyInPandasWithState(run, DRIFT, "window array<double>", "append", GroupStateTimeout.NoTimeout)


def should_retrain(policy: str, frame: int, last: int, score: float, score_then: float, drifted: bool, every: int = 100, drop: float = 0.2) -> bool:
    """Fixed-T: after ``every`` frames; Threshold-delta: when the score fell by ``drop``; ADWIN: on drift."""
    if policy == "fixed":
        return frame - last >= every
    if policy == "threshold":
        return score < score_then - drop
    if policy == "adwin":
        return drifted
    raise ValueError(f"unknown policy {policy!r}")


def triggers(frames: DataFrame, policy: str = "fixed", every: int = 100) -> DataFrame:
    """(traj_id, frame) at which a stream retrains; the state of a key is the last such frame and the bounded window.

    The order of rows is that of ``drift``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, window, then = state.get if state.exists else (-1, [], 0.0)
        window = list(window)
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for f, v in zip(rows["frame"], rows["x"], strict=True):
            window, hit = drift_step(window, float(v))
            mean = sum(window) / len(window)
            if should_retrain(policy, int(f), last, mean, then, hit, every):
                out.append((key[0], f))
                last, then = int(f), mean
        state.update((last, window, then))
        yield pd.DataFrame(out, columns=["traj_id", "frame"])

    return frames.groupBy("traj_id").applyInPandasWithState(run, "traj_id long, frame long", "last long, window array<double>, score double", "append", GroupStateTimeout.NoTimeout)


def bias_ledger(frames: DataFrame, stride: int = 10, sigma: float = 1.0, height: float = 1.0, cell: float | None = None) -> DataFrame:
    """(traj_id, frame, bias): Gaussian potential of the hills that every ``stride``-th frame has left so far.

    The state of a key is its hills' places and numbers. Without ``cell`` each different place is kept, so
    the state grows with the trajectory; with it hills move to the middle of their cell of that width,
    and the state is bounded by the range of x over ``cell``. Rows of a micro-batch are taken in frame
    order; a frame that comes in a later micro-batch than its successors sees the hills left by then.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, number = (np.array(v, "f8") for v in state.get) if state.exists else (np.zeros(0), np.zeros(0))
        hills = dict(zip(place.tolist(), number.tolist(), strict=True))
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for f, v in zip(rows["frame"], rows["x"].astype(float), strict=True):
            out.append((key[0], f, height * float((number * np.exp(-((v - place) ** 2) / (2 * sigma**2))).sum())))
            if f % stride == 0:
                at = v if cell is None else (math.floor(v / cell) + 0.5) * cell
                hills[at] = hills.get(at, 0.0) + 1
                place, number = np.array(list(hills)), np.array(list(hills.values()))
        state.update((place.tolist(), number.tolist()))
        yield pd.DataFrame(out, columns=["traj_id", "frame", "bias"])

    return frames.groupBy("traj_id").applyInPandasWithState(run, "traj_id long, frame long, bias double", "place array<double>, number array<double>", "append", GroupStateTimeout.NoTimeout)


def training_window(frames: DataFrame, end: int, width: int | None = None) -> DataFrame:
    """Frames up to ``end``: all, or the last ``width``."""
    out = frames.where(F.col("frame") <= end)
    return out if width is None else out.where(F.col("frame") > end - width)


def live_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events a state and window of event time, with a watermark."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def read_stream(spark: SparkSession, schema, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, a bounded number a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_files(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a finite stream to its end into Parquet files of a shared folder, and read those.

    Appended rows go through the file sink, whose log makes every micro-batch count once; a complete
    result replaces the one before.
    """
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").option("path", f"{folder}/rows").start()
    else:
        q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    q.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(f"{folder}/rows") if q.lastProgress else spark.createDataFrame([], df.schema)


class ProgressLog(StreamingQueryListener):
    """Keeps the last ``most`` progress events of all queries as plain dictionaries."""

    def __init__(self, most: int = 1000):
        self.most, self.events = most, []

    def onQueryStarted(self, event) -> None:
        self._add({"kind": "started", "id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add({"kind": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add({"kind": "terminated", "id": str(event.id), "error": event.exception})

    def _add(self, event: dict) -> None:
        self.events = [*self.events, event][-self.most :]
