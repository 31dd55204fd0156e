"""Binary trajectories and structures as tables: DCD files by a Python data source, PDB atoms by text columns."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "path string, frame long, pos array<struct<x:double,y:double,z:double>>"


def read_header(f) -> tuple[int, int, int, int]:
    """Frames, atoms, bytes before the first frame and bytes a frame of an open DCD file."""
    head = f.read(92)
    if len(head) < 92 or head[4:8] != b"CORD":
        raise ValueError("not a DCD file")
    control = struct.unpack("<20i", head[8:88])
    (size,) = struct.unpack("<i", f.read(4))
    f.seek(size + 4, os.SEEK_CUR)
    _, atoms, _ = struct.unpack("<3i", f.read(12))
    start = f.tell()
    frame = 3 * (4 * atoms + 8) + (56 if control[10] else 0)
    return control[0], atoms, start, frame


def write_dcd(path: str, frames: np.ndarray) -> None:
    """Write (frames, atoms, 3) positions as single-precision DCD without a cell; the file appears whole."""
    n, atoms, _ = frames.shape
    control = [n, 0, 1, *[0] * 16, 24]
    title = b"frames".ljust(80)
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(struct.pack("<i4s20ii", 84, b"CORD", *control, 84))
        f.write(struct.pack("<ii80si", 84, 1, title, 84) + struct.pack("<3i", 4, atoms, 4))
        mark = struct.pack("<i", 4 * atoms)
        for x in np.asarray(frames, "<f4"):
            for k in range(3):
                f.write(mark + x[:, k].tobytes() + mark)
    os.replace(part, path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for x in options["path"].split(",") for p in glob.glob(x.removeprefix("file://")))
        self.start, self.stride = max(0, int(options.get("start", 0))), max(1, int(options.get("stride", 1)))
        self.stop = int(options["stop"]) if "stop" in options else None
        self.chunk = max(1, int(options.get("chunk", 1000)))
        self.atoms = [int(a) for a in options["atoms"].split(",")] if options.get("atoms") else None

    def partitions(self) -> list[_Range]:
        if not self.paths:
            raise FileNotFoundError("no trajectory file matches")
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                _, _, start, frame = read_header(f)
                n = (os.path.getsize(path) - start) // frame  # what is there, whatever the header says
            end = n if self.stop is None else min(n, self.stop)
            out += [_Range(path, a, min(a + self.chunk, end)) for a in range(self.start, end, self.chunk)]
        return out or [_Range(self.paths[0], 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            _, atoms, start, frame = read_header(f)
            for i in range(partition.start, partition.stop):
                if (i - self.start) % self.stride:
                    continue
                f.seek(start + i * frame + (frame - 3 * (4 * atoms + 8)))
                raw = np.frombuffer(f.read(3 * (4 * atoms + 8)), "<f4").reshape(3, atoms + 2)[:, 1:-1].T
                own = raw if self.atoms is None else raw[self.atoms]
                yield (partition.path, i, [tuple(map(float, p)) for p in own])


class TrajectorySource(DataSource):
    """``spark.read.format("dcd")`` with options path, start, stop, stride, chunk, atoms.

    Frames have a fixed size, so a chunk of frames is a partition that seeks to its place.
    """

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_trajectories(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames of one or more DCD files."""
    spark.dataSource.register(TrajectorySource)
    reader = spark.read.format("dcd").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def write_pdb(atoms: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> None:
    """Write ``atoms(name, atom_id, atom, res_name, chain, res_id, x, y, z)`` as PDB text, a folder ``structure=...`` for each value of ``name``.

    A structure's lines are in one file, in the order of atom_id, and end with END; structures are dealt to tasks.
    Null names of residues and chains are blank; atoms without a place are left out. Lengths are in angstrom.
    """
    text = lambda c, n: F.rpad(F.coalesce(F.substring(F.col(c).cast("string"), 1, n), F.lit("")), n, " ")
    line = F.format_string("ATOM  %5d %s %s %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.col("atom_id").cast("int"), text("atom", 4), text("res_name", 3), text("chain", 1), F.coalesce(F.col("res_id"), F.lit(0)).cast("int"), *[F.col(c).cast("double") for c in "xyz"], F.lit(1.0), F.lit(0.0))
    placed = atoms.where(F.col(name).isNotNull() & F.col("atom_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    lines = placed.select(F.col(name).cast("string").alias("structure"), F.col("atom_id").cast("long").alias("o"), line.alias("value"))
    ends = lines.select("structure").distinct().select("structure", F.lit((1 << 63) - 1).alias("o"), F.lit("END").alias("value"))
    whole = lines.union(ends).repartition("structure").sortWithinPartitions("structure", "o").select("structure", "value")
    whole.write.mode(mode).partitionBy("structure").text(folder)


def export_structures(atoms: DataFrame, chosen: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write the frames ``chosen(traj_id, frame, state, rank)`` of ``atoms(traj_id, frame, ...)`` as PDB, named by state and rank."""
    name = F.concat_ws("_", F.concat(F.lit("state"), F.col("state").cast("string")), F.concat(F.lit("rank"), F.col("rank").cast("string")))
    own = chosen.select("traj_id", "frame", name.alias("_structure")).distinct()
    write_pdb(atoms.join(own, ["traj_id", "frame"]), folder, "_structure", mode)


def read_pdb(spark: SparkSession, path: str | Iterable[str]) -> DataFrame:
    """Atoms of PDB text by its fixed columns; native expressions over the text source."""
    line = spark.read.text(path).where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    return line.select(cut(7, 5).try_cast("int").alias("atom_id"), cut(13, 4).alias("name"), cut(18, 3).alias("res_name"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("res_id"), *[cut(31 + 8 * k, 8).try_cast("double").alias(c) for k, c in enumerate("xyz")])
