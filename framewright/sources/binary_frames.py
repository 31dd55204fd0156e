"""Binary trajectories (XTC, TRR, NetCDF-3, DCD) by a data source that starts in the middle of files.

A first job indexes the files, a task each: where every chunk of frames begins and ends. The data source then makes
a partition of each chunk, reads its bytes through the file system that the path names, and hands on Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framewright.sources.shared import shared_folder

FRAMES = "path string, frame long, time double, units string, box array<double>, pos array<struct<x:double,y:double,z:double>>"
INDEX = "path string, kind string, first long, frames long, begin long, stop long, atoms long"
#: Sizes of the small steps of the XTC coding, by their index; the first nine are not used.
STEPS = [0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216]
FIRST_STEP = 9


def opened(path: str):
    """A readable file of any file system that pyarrow knows, and its size."""
    if path.startswith("file:") or "://" not in path:
        fs, at = pafs.LocalFileSystem(), ("/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else path
    else:
        fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(at), fs.get_file_info(at).size


# XTC


class Bits:
    """Numbers of any width from a stream of bits, the first bit highest."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        a, b = self.at, self.at + n
        self.at = b
        word = int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big")
        return (word >> (-b % 8)) & ((1 << n) - 1)

    def triple(self, n: int, sizes: tuple[int, int, int]) -> tuple[int, int, int]:
        """Three numbers below ``sizes`` in one of n bits, whose bytes come lowest first."""
        word, rest, whole = self.take(n), n % 8, n // 8
        value = int.from_bytes((word >> rest).to_bytes(whole, "big"), "little") + ((word & ((1 << rest) - 1)) << (8 * whole))
        value, c = divmod(value, sizes[2])
        a, b = divmod(value, sizes[1])
        return a, b, c


def unpacked_coordinates(data: bytes, atoms: int, low: tuple[int, int, int], high: tuple[int, int, int], step: int) -> np.ndarray:
    """Whole-number coordinates of a frame: atoms by their place in the box, or by small steps from the one before."""
    sizes = tuple(b - a + 1 for a, b in zip(low, high, strict=True))
    apart = max(sizes) > 0xFFFFFF
    widths, width = [s.bit_length() for s in sizes], (sizes[0] * sizes[1] * sizes[2]).bit_length()
    bits = Bits(data)
    out = np.empty((atoms, 3), "i8")
    i = run = 0
    while i < atoms:
        here = tuple(bits.take(w) for w in widths) if apart else bits.triple(width, sizes)
        here = tuple(h + m for h, m in zip(here, low, strict=True))
        change = 0
        if bits.take(1):
            change = bits.take(5)
            run = change - change % 3
            change = change % 3 - 1
        if not run:
            out[i] = here
            i += 1
        last = here
        for k in range(run // 3):
            small = STEPS[step]
            moved = tuple(d + m - small // 2 for d, m in zip(bits.triple(step, (small,) * 3), last, strict=True))
            out[i] = moved
            i += 1
            if k == 0:  # the first step leads back to the atom before the one that was given in full
                out[i] = here
                i += 1
            last = moved
        step += change
    return out


@dataclass
class Frame:
    number: int
    time: float | None
    box: np.ndarray | None
    pos: np.ndarray | None


def xtc_header(head: bytes) -> tuple[int, int]:
    """Atoms of the frame that begins here, and its bytes; (0, 0) if the header is not whole."""
    if len(head) < 56:
        return 0, 0
    magic, atoms = struct.unpack(">2i", head[:8])
    if magic != 1995:
        raise ValueError("not an XTC frame")
    if atoms <= 9:
        return atoms, 56 + 12 * atoms
    if len(head) < 92:
        return 0, 0
    (size,) = struct.unpack(">i", head[88:92])
    return atoms, 92 + size + -size % 4


def chain_index(f, size: int, chunk: int, header) -> Iterator[tuple[int, int, int, int, int]]:
    """(first frame, frames, begin, stop, atoms) of chunks of frames that follow each other, each with its ``header``.

    Headers alone are read; a last frame that is cut off is left out.
    """
    at = begin = number = held = most = 0
    while at < size:
        f.seek(at)
        atoms, n = header(f.read(92))
        if not n or at + n > size:
            break
        at, held, most = at + n, held + 1, max(most, atoms)
        if held == chunk:
            yield number, held, begin, at, most
            number, held, begin, most = number + held, 0, at, 0
    if held:
        yield number, held, begin, at, most


def xtc_frames(data: bytes, first: int) -> Iterator[Frame]:
    at, number = 0, first
    while at < len(data):
        head = data[at : at + 92]
        atoms, n = xtc_header(head)
        time, *box = struct.unpack(">10f", head[12:52])
        if atoms <= 9:
            pos = np.frombuffer(data[at + 56 : at + n], ">f4").reshape(atoms, 3).astype("f8")
        else:
            (precision,) = struct.unpack(">f", head[56:60])
            low, high, (step, size) = struct.unpack(">3i", head[60:72]), struct.unpack(">3i", head[72:84]), struct.unpack(">2i", head[84:92])
            pos = unpacked_coordinates(data[at + 92 : at + 92 + size], atoms, low, high, step) / float(precision)
        yield Frame(number, float(time), np.array(box), pos)
        at, number = at + n, number + 1


# TRR

#: What a TRR frame begins with, the magic number and the version as a counted string.
TRR_START = struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file"
#: The order of the counts of bytes in a TRR header, and of the arrays after it.
TRR_SIZES = ("ir", "e", "box", "vir", "pres", "top", "sym", "x", "v", "f")


@dataclass
class TrrHeader:
    sizes: dict[str, int]
    atoms: int
    real: str  # big-endian singles or doubles
    start: int  # of the arrays

    @property
    def bytes(self) -> int:
        return self.start + sum(self.sizes.values())

    def array(self, frame: bytes, name: str) -> np.ndarray | None:
        """Values of one array of the frame; null where it has none."""
        at = self.start + sum(self.sizes[c] for c in TRR_SIZES[: TRR_SIZES.index(name)])
        return np.frombuffer(frame[at : at + self.sizes[name]], self.real).astype("f8") if self.sizes[name] else None


def trr_layout(head: bytes) -> TrrHeader | None:
    """The header of a TRR frame; null if it is not whole.

    Reals are singles or doubles by what the box, or else any array of the atoms, takes.
    """
    if not TRR_START.startswith(head[:24]) and head[:24] != TRR_START:
        raise ValueError("not a TRR frame")
    if len(head) < 76:
        return None
    *sizes, atoms, _, _ = struct.unpack(">13i", head[24:76])
    own = dict(zip(TRR_SIZES, sizes, strict=True))
    of_three = next((own[c] // (3 * atoms) for c in ("x", "v", "f") if own[c] and atoms), 4)
    width = own["box"] // 9 if own["box"] else of_three
    if width not in (4, 8) or atoms < 0 or min(sizes) < 0:
        raise ValueError("not a TRR frame")
    start = 76 + 2 * width
    return TrrHeader(own, atoms, f">f{width}", start) if len(head) >= start else None


def trr_header(head: bytes) -> tuple[int, int]:
    """Atoms of the frame that begins here, and its bytes; (0, 0) if the header is not whole."""
    own = trr_layout(head)
    return (own.atoms, own.bytes) if own else (0, 0)


def trr_frames(data: bytes, first: int) -> Iterator[Frame]:
    """Frames with their positions; a frame of velocities or forces alone has none."""
    at, number = 0, first
    while at < len(data):
        own = trr_layout(data[at : at + 92])
        frame = data[at : at + own.bytes]
        (time,) = np.frombuffer(frame[76 : own.start], own.real)[:1].tolist()
        pos = own.array(frame, "x")
        yield Frame(number, time, own.array(frame, "box"), None if pos is None else pos.reshape(own.atoms, 3))
        at, number = at + own.bytes, number + 1


# NetCDF-3


@dataclass
class Variable:
    dims: tuple[int, ...]
    kind: int
    size: int
    begin: int
    attributes: dict


#: The external types of the classic format.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class ClassicHeader:
    """Dimensions, variables and the record layout of a NetCDF classic, 64-bit-offset or 64-bit-data file."""

    def __init__(self, f, size: int):
        f.seek(0)
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF-3 file")
        self.version = magic[3]
        self.records = self.whole()
        self.dims = [(self.name(), self.whole()) for _ in range(self.count())]
        self.attributes = self.attribute_list()
        self.variables: dict[str, Variable] = {}
        for _ in range(self.count()):
            name = self.name()
            dims = tuple(self.whole() for _ in range(self.whole()))
            attributes = self.attribute_list()
            kind, vsize = struct.unpack(">i", f.read(4))[0], self.whole()
            begin = struct.unpack(">i" if self.version == 1 else ">q", f.read(4 if self.version == 1 else 8))[0]
            self.variables[name] = Variable(dims, kind, vsize, begin, attributes)
        open_ones = [v for v in self.variables.values() if v.dims and self.dims[v.dims[0]][1] == 0]
        self.stride = sum(self.bytes_of(v) + (-self.bytes_of(v) % 4 if len(open_ones) > 1 else 0) for v in open_ones)
        first = min((v.begin for v in open_ones), default=size)
        there = (size - first) // self.stride if self.stride else 0
        self.records = there if self.records < 0 else min(self.records, there)  # -1: still being written

    def whole(self) -> int:
        return struct.unpack(">q" if self.version == 5 else ">i", self.f.read(8 if self.version == 5 else 4))[0]

    def count(self) -> int:
        self.f.read(4)  # the tag of the list
        return self.whole()

    def name(self) -> str:
        n = self.whole()
        return self.f.read(n + -n % 4)[:n].decode()

    def attribute_list(self) -> dict:
        out = {}
        for _ in range(self.count()):
            name = self.name()
            kind, n = struct.unpack(">i", self.f.read(4))[0], self.whole()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = self.f.read(size + -size % 4)[:size]
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out

    def bytes_of(self, v: Variable) -> int:
        """Bytes of one record of an open variable."""
        return int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype="i8")) * np.dtype(TYPES[v.kind]).itemsize

    def record(self, name: str, i: int) -> np.ndarray | None:
        v = self.variables.get(name)
        if v is None:
            return None
        self.f.seek(v.begin + i * self.stride)
        return np.frombuffer(self.f.read(self.bytes_of(v)), TYPES[v.kind]).reshape([self.dims[d][1] for d in v.dims[1:]]).astype("f8")


def netcdf_frames(f, size: int, first: int, n: int) -> Iterator[Frame]:
    head = ClassicHeader(f, size)
    for i in range(first, first + n):
        time, lengths, pos = (head.record(c, i) for c in ("time", "cell_lengths", "coordinates"))
        yield Frame(i, None if time is None else float(time), lengths, pos)


# The source


def dcd_layout(f, size: int) -> tuple[int, int, int, int]:
    """(frames, atoms, start, bytes a frame) of a DCD file."""
    from framewright.sources.trajectories import read_header

    f.seek(0)
    _, atoms, start, frame = read_header(f)
    return (size - start) // frame, atoms, start, frame


def dcd_frames(f, size: int, first: int, n: int) -> Iterator[Frame]:
    _, atoms, start, frame = dcd_layout(f, size)
    cell = frame - 3 * (4 * atoms + 8)
    f.seek(start + first * frame)
    for i in range(first, first + n):
        raw = f.read(frame)[cell:]
        yield Frame(i, None, None, np.frombuffer(raw, "<f4").reshape(3, atoms + 2)[:, 1:-1].T.astype("f8"))


#: Kinds whose frames follow each other with headers of their own: what reads a header, and what reads the frames.
CHAINS = {"xtc": (xtc_header, xtc_frames), "trr": (trr_header, trr_frames)}
#: Suffix of each kind, and the unit of its lengths unless the file says another.
KINDS = {"xtc": "nanometer", "trr": "nanometer", "nc": "angstrom", "ncdf": "angstrom", "dcd": "angstrom"}


def kind_of(path: str) -> str:
    kind = path.rpartition(".")[2].lower()
    if kind not in KINDS:
        raise ValueError(f"unknown trajectory format {path!r}; known: {sorted(KINDS)}")
    return kind


def file_index(path: str, chunk: int) -> Iterator[tuple]:
    """Rows of the index of one file."""
    kind = kind_of(path)
    f, size = opened(path)
    with f:
        if kind in CHAINS:
            yield from ((path, kind, *row) for row in chain_index(f, size, chunk, CHAINS[kind][0]))
            return
        n, atoms = dcd_layout(f, size)[:2] if kind == "dcd" else ((h := ClassicHeader(f, size)).records, h.dims[h.variables["coordinates"].dims[1]][1])
        yield from ((path, kind, a, min(chunk, n - a), 0, size, atoms) for a in range(0, n, chunk))


def trajectory_index(spark: SparkSession, paths: str | list[str], chunk: int = 100, ignore_errors: bool = False) -> DataFrame:
    """(path, kind, first, frames, begin, stop, atoms): a row for each chunk of frames of the files that the paths or patterns name.

    Spark lists the files; a task reads the headers of one. An unreadable file is an error unless ``ignore_errors``;
    a file without a whole frame has no row.
    """
    files = spark.read.format("binaryFile").load(paths).select("path")
    found = files.count()

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    rows = list(file_index(path, chunk))
                except (ValueError, OSError, struct.error, KeyError):
                    if not ignore_errors:
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 2 else pa.int64()) for i in range(7)], names=["path", "kind", "first", "frames", "begin", "stop", "atoms"])

    return files.repartition(max(1, min(found, 10_000))).mapInArrow(run, INDEX)


def position_list(pos: np.ndarray | None, atoms: list[int] | None) -> pa.ListArray:
    """One list of the positions of all or of chosen atoms, null without positions."""
    chosen = np.empty((0, 3)) if pos is None else pos if atoms is None else pos[atoms]
    cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(chosen[:, k])) for k in range(3)], names=["x", "y", "z"])
    return pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), cells, mask=pa.array([pos is None]))


@dataclass
class Chunk(InputPartition):
    path: str
    kind: str
    first: int
    frames: int
    begin: int
    stop: int


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.index = options["path"]
        self.start, self.stride = max(0, int(options.get("start", 0))), max(1, int(options.get("stride", 1)))
        self.end = int(options["stop"]) if "stop" in options else None
        self.atoms = [int(a) for a in options["atoms"].split(",")] if options.get("atoms") else None

    def partitions(self) -> list[InputPartition]:
        fs, at = (pafs.LocalFileSystem(), "/" + self.index.removeprefix("file:").lstrip("/")) if self.index.startswith("file:") else pafs.FileSystem.from_uri(self.index)
        rows = pq.read_table(at, filesystem=fs).to_pylist()  # a row a chunk
        some = [Chunk(*(r[c] for c in ("path", "kind", "first", "frames", "begin", "stop"))) for r in sorted(rows, key=lambda r: (r["path"], r["first"]))]
        return [c for c in some if c.first + c.frames > self.start and (self.end is None or c.first < self.end)] or [Chunk("", "", 0, 0, 0, 0)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        if not chunk.frames:
            return
        f, size = opened(chunk.path)
        with f:
            units = KINDS[chunk.kind]
            if chunk.kind in CHAINS:
                f.seek(chunk.begin)
                frames = CHAINS[chunk.kind][1](f.read(chunk.stop - chunk.begin), chunk.first)
            elif chunk.kind == "dcd":
                frames = dcd_frames(f, size, chunk.first, chunk.frames)
            else:
                units = ClassicHeader(f, size).variables["coordinates"].attributes.get("units", units)
                frames = netcdf_frames(f, size, chunk.first, chunk.frames)
            for x in frames:
                if x.number < self.start or (x.number - self.start) % self.stride or (self.end is not None and x.number >= self.end):
                    continue
                box = pa.array([None if x.box is None else x.box.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([chunk.path]), pa.array([x.number], pa.int64()), pa.array([x.time], pa.float64()), pa.array([units]), box, position_list(x.pos, self.atoms)], names=["path", "frame", "time", "units", "box", "pos"])


class BinaryFrames(DataSource):
    """``spark.read.format("binary_frames")`` over a stored index; options start, stop, stride (frames of each file) and atoms."""

    @classmethod
    def name(cls) -> str:
        return "binary_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


def read_binary_frames(spark: SparkSession, paths: str | list[str], chunk: int = 100, ignore_errors: bool = False, **options) -> DataFrame:
    """(path, frame, time, units, box, pos) of XTC, TRR, NetCDF-3 and DCD files: the files are indexed first, then read by chunks.

    Lengths are in ``units`` as the file has them. A box is nine numbers (XTC, TRR), three lengths (NetCDF) or null. Positions are null in a TRR frame of
    velocities or forces alone, which counts as a frame.
    """
    folder = shared_folder(spark, "frame-index")
    trajectory_index(spark, paths, chunk, ignore_errors).coalesce(64).write.parquet(folder)
    spark.dataSource.register(BinaryFrames)
    reader = spark.read.format("binary_frames")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(folder)
