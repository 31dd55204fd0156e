"""DCD sink that appends: tasks write segments, the commit puts them behind what is there and renames once.

A task writes its frames to a segment of its own beside the trajectory and reports it. The commit copies
header, old frames and segments, in frame order and by buffers of a megabyte, to a new file that replaces the old
one. Until that rename the old file is untouched; a failed job deletes its segments.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from framewright.sources.trajectories import read_header

BUFFER = 1 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), ("/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else path
    return pafs.FileSystem.from_uri(path)


def header(frames: int, atoms: int) -> bytes:
    control = [frames, 0, 1, *[0] * 16, 24]
    title = b"frames".ljust(80)
    return struct.pack("<i4s20ii", 84, b"CORD", *control, 84) + struct.pack("<ii80si", 84, 1, title, 84) + struct.pack("<3i", 4, atoms, 4)


def frame_bytes(pos: np.ndarray) -> bytes:
    mark = struct.pack("<i", 4 * len(pos))
    return b"".join(mark + pos[:, k].astype("<f4").tobytes() + mark for k in range(3))


@dataclass
class Segment(WriterCommitMessage):
    path: str
    first: int
    last: int
    frames: int
    atoms: int


class DcdWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"{path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        rows = []
        for batch in iterator:
            cells = batch.column("pos").flatten()
            xyz = np.stack([cells.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            ends = np.cumsum(batch.column("pos").value_lengths().to_numpy(zero_copy_only=False))
            rows += [(f, frame_bytes(xyz[e - n : e]), n) for f, e, n in zip(batch.column("frame").to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
        rows.sort(key=lambda r: r[0])  # a partition's frames
        if not rows:
            return Segment("", 0, 0, 0, 0)
        if len({f for f, _, _ in rows}) < len(rows):
            raise ValueError("repeated frames")
        if len({n for _, _, n in rows}) > 1:
            raise ValueError("frames of a trajectory have one number of atoms")
        fs, at = located(self.staging)
        fs.create_dir(at, recursive=True)
        name = f"{at}/{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as out:
            for _, data, _ in rows:
                out.write(data)
        return Segment(name, rows[0][0], rows[-1][0], len(rows), rows[0][2])

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        parts = sorted((m for m in messages if m is not None and m.frames), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(parts[:-1], parts[1:], strict=True)):
            self.abort(messages)
            raise ValueError("partitions hold interleaved or repeated frames: range-partition by frame first")
        fs, at = located(self.path)
        old = not self.overwrite and fs.get_file_info(at).type == pafs.FileType.File
        frames = atoms = start = size = 0
        if old:
            with fs.open_input_file(at) as f:
                _, atoms, start, size = read_header(f)
            frames = (fs.get_file_info(at).size - start) // size  # a cut-off frame is left behind
        kinds = {m.atoms for m in parts} | ({atoms} if old else set())
        if len(kinds) > 1 or (old and size != 3 * (4 * atoms + 8)):
            self.abort(messages)
            raise ValueError("the file's frames have another size than the new ones")
        if not kinds:
            return
        new = f"{self.staging}.whole"
        _, to = located(new)
        with fs.open_output_stream(to) as out:
            out.write(header(frames + sum(m.frames for m in parts), kinds.pop()))
            for source, begin, n in [*([(at, start, frames * size)] if old else []), *((m.path, 0, None) for m in parts)]:
                with fs.open_input_file(source) as f:
                    f.seek(begin)
                    left = n if n is not None else fs.get_file_info(source).size
                    while left > 0:
                        data = f.read(min(BUFFER, left))
                        out.write(data)
                        left -= len(data)
        fs.move(to, at)
        self.clear()

    def clear(self) -> None:
        fs, at = located(self.staging)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self.clear()


class DcdSink(DataSource):
    """``df.write.format("dcd_sink").mode("append").save(path)`` of (frame, pos)."""

    @classmethod
    def name(cls) -> str:
        return "dcd_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DcdWriter(self.options["path"], overwrite)


def append_dcd(frames: DataFrame, path: str, parts: int = 8, overwrite: bool = False) -> None:
    """Append ``frames(frame, pos)`` in frame order to the DCD file at ``path``, which appears or grows whole or not at all.

    Frames are numbered anew behind those of the file. All have the file's number of atoms. A path of any file
    system that pyarrow knows; repeated frame numbers in one call are an error.
    """
    frames.sparkSession.dataSource.register(DcdSink)
    own = frames.select("frame", "pos").repartitionByRange(parts, "frame")
    own.write.format("dcd_sink").mode("overwrite" if overwrite else "append").save(path)
