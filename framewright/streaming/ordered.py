"""Stateful operators that take a trajectory's frames in order, however the micro-batches bring them.

Frames that come before their predecessors are held in map state, in blocks; once the next frame in line is there they are
handled. If it never comes, an event-time timer lets the watermark close the gap.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewright.streaming.detectors import DRIFT, drift_step, should_retrain

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Held frames, or hills, of one state entry.
BLOCK = 256


def use_map_state(spark: SparkSession) -> None:
    """Set the state store that map state and timers need; queries of the session that start later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Hands frames to ``step(frame, x)`` in ascending order; what it returns are output rows.

    ``own`` is what a trajectory keeps between micro-batches, any value that JSON holds; ``start()`` gives it first.
    A frame at or before the last one handled (late, or repeated) is left out. Held frames lie in blocks of ``BLOCK``
    frames, one state entry each, so that a micro-batch touches blocks and not frames; of the timers of a
    trajectory's held frames the earliest is registered, and when it expires that of the frames then left.
    """

    columns: list[str] = []

    def start(self):
        return []

    def step(self, frame: int, x: float) -> tuple | None:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "block long", "frames string")
        self.place = handle.getValueState("place", "last long, held long, timer long, own string")

    def begin(self) -> None:
        """``n_held`` counts the frames held, ``before`` those of earlier micro-batches; ``timer`` is the earliest registered, or -1."""
        got = self.place.get()
        self.last, self.n_held, self.timer = got[:3] if got else (-1, 0, -1)
        self.own = json.loads(got[3]) if got else self.start()
        self.blocks: dict[int, dict[int, list]] = {}
        self.changed: set[int] = set()
        self.stored: set[int] = set()
        self.before = self.n_held

    def end(self) -> None:
        for block in self.changed:
            if self.blocks[block]:
                self.held.updateValue((block,), (json.dumps(self.blocks[block]),))
            elif block in self.stored:
                self.held.removeKey((block,))
        self.place.update((self.last, self.n_held, self.timer, json.dumps(self.own)))

    def block(self, frame: int) -> dict[int, list]:
        """{frame: [x, due]} of the held frames in the block of a frame."""
        at = frame // BLOCK
        if at not in self.blocks:
            got = self.held.getValue((at,)) if self.before else None
            if got:
                self.stored.add(at)
            self.blocks[at] = {int(f): v for f, v in json.loads(got[0]).items()} if got else {}
        return self.blocks[at]

    def hold(self, frame: int, x: float, due: int) -> None:
        self.block(frame)[frame] = [x, due]
        self.changed.add(frame // BLOCK)
        self.n_held += 1

    def taken(self, frame: int) -> float | None:
        """The x of a held frame, which is held no longer."""
        got = self.block(frame).pop(frame, None) if self.n_held else None
        if got is None:
            return None
        self.changed.add(frame // BLOCK)
        self.n_held -= 1
        return got[0]

    def wake(self, due: int) -> None:
        if self.timer < 0 or due < self.timer:
            self.handle.registerTimer(due)
            self.timer = due

    def handled(self, key, frame: int, x: float) -> Iterator[Row]:
        self.last = frame
        row = self.step(frame, x)
        if row is not None:
            yield Row(traj_id=key[0], frame=frame, **dict(zip(self.columns, row, strict=True)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.begin()
        waiting: dict[int, tuple] = {}
        for r in rows:
            if r.frame > self.last and r.frame not in waiting:
                waiting[r.frame] = (float("nan") if r.x is None else float(r.x), r.due)
        while True:
            frame = self.last + 1
            new, old = waiting.pop(frame, None), self.taken(frame)
            if new is None and old is None:
                break
            yield from self.handled(key, frame, old if new is None else new[0])
        new = [(frame, x, due) for frame, (x, due) in waiting.items() if frame not in self.block(frame)]
        for frame, x, due in new:
            self.hold(frame, x, due)
        if new:
            self.wake(max(min(due for _, _, due in new), timerValues.getCurrentWatermarkInMs() + 1))
        self.end()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The watermark has passed a held frame: its predecessors, and those that follow it without a gap, are handled."""
        self.begin()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known, passed, later = [], -1, -1
        for (block,), (text,) in self.held.iterator() if self.n_held else ():
            known.append(block)
            for frame, (_, due) in json.loads(text).items():
                if due <= now:
                    passed = max(passed, int(frame))
                elif later < 0 or due < later:
                    later = due
        for block in sorted(known):
            for frame in sorted(self.block(block * BLOCK)):
                if frame > passed and frame != self.last + 1:
                    break
                x = self.taken(frame)
                if frame > self.last:
                    yield from self.handled(key, frame, x)
        self.timer = -1
        if self.n_held:
            self.wake(later)
        self.end()

    def close(self) -> None:
        pass


class Drift(InOrder):
    columns = ["drift", "width"]

    def __init__(self, delta: float, most: int):
        self.delta, self.most = delta, most

    def step(self, frame: int, x: float) -> tuple:
        self.own, hit = drift_step(self.own, x, self.delta, self.most)
        return hit, len(self.own)


class Trigger(InOrder):
    def __init__(self, policy: str, every: int):
        self.policy, self.every = policy, every

    def start(self):
        return [-1, [], 0.0]

    def step(self, frame: int, x: float) -> tuple | None:
        last, window, then = self.own
        if self.policy == "fixed":  # neither window nor score is asked for
            hit, mean = False, then
        else:
            window, hit = drift_step(window, x)
            mean = sum(window) / len(window)
        fires = should_retrain(self.policy, frame, last, mean, then, hit, self.every)
        self.own = [frame, window, mean] if fires else [last, window, then]
        return () if fires else None


class Ledger(InOrder):
    """Hills are map state of their own, in blocks of places as they came: a micro-batch writes the blocks it has touched."""

    columns = ["bias"]

    def __init__(self, stride: int, sigma: float, height: float, cell: float | None):
        self.stride, self.sigma, self.height, self.cell = stride, sigma, height, cell

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.hills = handle.getMapState("hills", "block long", "hills string")

    def start(self):
        return 0

    def begin(self) -> None:
        """``own`` is the number of different places."""
        super().begin()
        kept = sorted((k[0], v[0]) for k, v in self.hills.iterator()) if self.own else []
        hills = [hill for _, text in kept for hill in json.loads(text)]
        self.index = {place: i for i, (place, _) in enumerate(hills)}
        self.at, self.number = (np.array([h[k] for h in hills], "f8") for k in (0, 1))
        self.touched: set[int] = set()

    def end(self) -> None:
        for block in self.touched:
            own = slice(block * BLOCK, min((block + 1) * BLOCK, self.own))
            self.hills.updateValue((block,), (json.dumps(list(zip(self.at[own].tolist(), self.number[own].tolist(), strict=True))),))
        super().end()

    def step(self, frame: int, x: float) -> tuple:
        n = self.own
        bias = self.height * float((self.number[:n] * np.exp(-((x - self.at[:n]) ** 2) / (2 * self.sigma**2))).sum())
        if frame % self.stride == 0:
            place = x if self.cell is None else (math.floor(x / self.cell) + 0.5) * self.cell
            i = self.index.setdefault(place, n)
            if i == n:
                self.own += 1
                if i == len(self.at):
                    self.at, self.number = (np.concatenate([a, np.zeros(max(16, i))]) for a in (self.at, self.number))
                self.at[i] = place
            self.number[i] += 1
            self.touched.add(i // BLOCK)
        return (bias,)


def _run(frames: DataFrame, processor: InOrder, schema: str, delay: str) -> DataFrame:
    """Apply a processor to a stream of (traj_id, frame, x, ts); a gap is closed once the watermark is past the frame behind it."""
    from pyspark.sql import functions as F

    use_map_state(frames.sparkSession)
    own = frames.withWatermark("ts", delay).withColumn("due", F.unix_millis("ts"))
    return own.groupBy("traj_id").transformWithState(processor, schema, "Append", "EventTime")


def drift(frames: DataFrame, delta: float = 0.002, most: int = 256, delay: str = "1 hour") -> DataFrame:
    """(traj_id, frame, drift, width): the bounded-window detector over frames in order."""
    return _run(frames, Drift(delta, most), DRIFT, delay)


def triggers(frames: DataFrame, policy: str = "fixed", every: int = 100, delay: str = "1 hour") -> DataFrame:
    """(traj_id, frame) at which a stream retrains, its frames in order."""
    return _run(frames, Trigger(policy, every), "traj_id long, frame long", delay)


def bias_ledger(frames: DataFrame, stride: int = 10, sigma: float = 1.0, height: float = 1.0, cell: float | None = None, delay: str = "1 hour") -> DataFrame:
    """(traj_id, frame, bias): potential of the hills that every ``stride``-th earlier frame has left, frames in order.

    With ``cell`` hills move to the middle of their cell, which bounds the state by the range of x.
    """
    return _run(frames, Ledger(stride, sigma, height, cell), "traj_id long, frame long, bias double", delay)
