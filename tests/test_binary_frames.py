"""XTC, TRR, NetCDF-3 and DCD files written here, read by chunks that begin inside a file."""

import struct

import numpy as np
import pytest

from framewright.sources import binary_frames as B
from framewright.sources import frames as S
from framewright.sources import trajectories as T


class BitWriter:
    def __init__(self):
        self.word = self.n = 0

    def put(self, value, n):
        self.word, self.n = (self.word << n) | value, self.n + n

    def triple(self, values, n, sizes):
        value = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        low = value.to_bytes(n // 8 + 1, "little")
        for k in range(n // 8):
            self.put(low[k], 8)
        if n % 8:
            self.put(low[n // 8], n % 8)

    def bytes(self):
        return (self.word << (-self.n % 8)).to_bytes((self.n + 7) // 8, "big")


def xtc_frame(step, time, box, pos, precision, rng, wide=False):
    """A frame with runs of small steps wherever they fit, of random lengths and with changing step sizes."""
    atoms = len(pos)
    head = struct.pack(">3if9fi", 1995, atoms, step, time, *box, atoms)
    if atoms <= 9:
        return head + pos.astype(">f4").tobytes()
    x = np.rint(pos * precision).astype(int)
    if wide:
        x[0, 0] += 1 << 25
    low, high = x.min(0), x.max(0)
    sizes = (high - low + 1).tolist()
    apart, widths, width = max(sizes) > 0xFFFFFF, [s.bit_length() for s in sizes], (sizes[0] * sizes[1] * sizes[2]).bit_length()
    first = small = 20
    bits, i, run = BitWriter(), 0, 0
    full = lambda a: [bits.put(int(v), w) for v, w in zip(a - low, widths, strict=True)] if apart else bits.triple((a - low).tolist(), width, sizes)
    while i < atoms:
        half = B.STEPS[small] // 2
        fits = lambda a, b: ((a - b + half >= 0) & (a - b + half < B.STEPS[small])).all()  # noqa: B023, E731
        chain = []
        if i + 1 < atoms and fits(x[i], x[i + 1]):
            chain = [(x[i], x[i + 1])]
            while len(chain) < 8 and i + 1 + len(chain) < atoms and fits(x[i + 1 + len(chain)], x[i + len(chain)] if len(chain) > 1 else x[i]) and rng.random() < 0.8:
                k = i + 1 + len(chain)
                chain.append((x[k], x[k - 1] if len(chain) > 1 else x[i]))
        change = int(rng.integers(-1, 2)) if 12 < small < 30 else 0
        full(x[i + 1] if chain else x[i])
        if 3 * len(chain) != run or change:
            run = 3 * len(chain)
            bits.put(1, 1)
            bits.put(run + change + 1, 5)
        else:
            bits.put(0, 1)
        for a, b in chain:
            bits.triple((a - b + half).tolist(), small, (B.STEPS[small],) * 3)
        i += 1 + len(chain)
        small += change
    data = bits.bytes()
    return head + struct.pack(">f3i3i2i", precision, *low.tolist(), *high.tolist(), first, len(data)) + data + b"\0" * (-len(data) % 4)


def water(rng, atoms):
    """Groups of three near atoms, as the coding likes them, and some far ones."""
    centre = rng.uniform(-4, 4, (atoms // 3 + 1, 3))
    return (np.repeat(centre, 3, 0)[:atoms] + rng.normal(size=(atoms, 3)) * 0.05).round(3)


def write_xtc(path, n, atoms, seed, wide=False):
    rng = np.random.default_rng(seed)
    pos = np.array([water(rng, atoms) for _ in range(n)])
    box = np.diag([3.0, 4.0, 5.0]).ravel()
    path.write_bytes(b"".join(xtc_frame(i, 0.5 * i, box, p, 1000.0, rng, wide) for i, p in enumerate(pos)))
    return pos


def rows_of(df):
    return {(r.path.rpartition("/")[2], r.frame): r for r in df.collect()}


def positions(row):
    return np.array([[p.x, p.y, p.z] for p in row.pos])


@pytest.mark.parametrize("atoms", [1, 9, 10, 11, 60])
def test_xtc_frames_come_back(spark, tmp_path, atoms):
    want = write_xtc(tmp_path / "a.xtc", 13, atoms, atoms)
    df = B.read_binary_frames(spark, str(tmp_path / "a.xtc"), chunk=4)
    got = rows_of(df)
    assert sorted(got) == [("a.xtc", i) for i in range(13)] and df.rdd.getNumPartitions() == 4
    for (_, i), r in got.items():
        assert np.allclose(positions(r), want[i], atol=1e-6) and r.time == 0.5 * i and r.units == "nanometer" and r.box[::4] == [3.0, 4.0, 5.0]


def test_small_steps_are_used_and_wide_boxes_read(tmp_path):
    want = write_xtc(tmp_path / "a.xtc", 1, 300, 5)
    assert (tmp_path / "a.xtc").stat().st_size < 300 * 3 * 4  # packed
    wide = write_xtc(tmp_path / "b.xtc", 1, 40, 5, True)
    for name, pos in (("a", want), ("b", wide)):
        (frame,) = B.xtc_frames((tmp_path / f"{name}.xtc").read_bytes(), 0)
        assert np.allclose(frame.pos[1:], pos[0][1:], atol=1e-6)
    assert np.isclose(frame.pos[0, 0], wide[0, 0, 0] + (1 << 25) / 1000)


def test_index_ends_at_the_last_whole_frame(spark, tmp_path):
    write_xtc(tmp_path / "a.xtc", 6, 30, 1)
    data = (tmp_path / "a.xtc").read_bytes()
    (tmp_path / "a.xtc").write_bytes(data[:-5])
    write_xtc(tmp_path / "b.xtc", 3, 30, 2)
    (tmp_path / "c.xtc").write_bytes(b"")
    index = sorted((r.path.rpartition("/")[2], r.first, r.frames) for r in B.trajectory_index(spark, str(tmp_path / "*.xtc"), 2).collect())
    assert index == [("a.xtc", 0, 2), ("a.xtc", 2, 2), ("a.xtc", 4, 1), ("b.xtc", 0, 2), ("b.xtc", 2, 1)]
    got = rows_of(B.read_binary_frames(spark, str(tmp_path), chunk=2, start=1, stride=2, atoms="3,0"))
    assert sorted(got) == [("a.xtc", 1), ("a.xtc", 3), ("b.xtc", 1)] and all(len(r.pos) == 2 for r in got.values())
    (tmp_path / "d.xtc").write_bytes(b"x" * 200)
    assert len(rows_of(S.read_frames(spark, [str(tmp_path)], "xtc", ignore_errors=True))) == 8
    with pytest.raises(Exception, match="not an XTC frame"):
        B.trajectory_index(spark, str(tmp_path)).collect()


def trr_frame(step, time, box, pos, velocities, real):
    """A frame with any of box, positions and velocities, and a virial, in singles (f) or doubles (d)."""
    width, atoms = struct.calcsize(real), len(pos if pos is not None else velocities)
    parts = {"box": box, "vir": box, "x": pos, "v": velocities}
    sizes = [0 if parts.get(c) is None else np.size(parts[c]) * width for c in ("ir", "e", "box", "vir", "pres", "top", "sym", "x", "v", "f")]
    head = struct.pack(">3i", 1993, 13, 12) + b"GMX_trn_file" + struct.pack(">13i", *sizes, atoms, step, 0) + struct.pack(f">2{real}", time, 0.0)
    return head + b"".join(np.asarray(parts[c]).astype(f">{real}").tobytes() for c in ("box", "vir", "x", "v") if parts[c] is not None)


@pytest.mark.parametrize("real", ["f", "d"])
@pytest.mark.parametrize("boxed", [True, False])
def test_trr_frames_come_back(spark, tmp_path, real, boxed):
    rng = np.random.default_rng(4)
    pos, box = rng.normal(size=(11, 7, 3)).astype("f4"), np.diag([3.0, 4.0, 5.0]) if boxed else None
    frames = [trr_frame(i, 0.5 * i, box, None if i % 5 == 3 else p, p if i % 2 or i == 8 else None, real) for i, p in enumerate(pos)]
    (tmp_path / "a.trr").write_bytes(b"".join(frames))
    index = sorted((r.first, r.frames, r.atoms) for r in B.trajectory_index(spark, str(tmp_path / "a.trr"), 4).collect())
    assert index == [(0, 4, 7), (4, 4, 7), (8, 3, 7)]
    df = B.read_binary_frames(spark, str(tmp_path / "a.trr"), chunk=4)
    got = rows_of(df)
    assert sorted(got) == [("a.trr", i) for i in range(11)] and df.rdd.getNumPartitions() == 3
    for (_, i), r in got.items():
        assert r.time == 0.5 * i and r.units == "nanometer" and (r.box[::4] == [3.0, 4.0, 5.0] if boxed else r.box is None)
        assert (r.pos is None) == (i in (3, 8)) and (r.pos is None or np.array_equal(positions(r), pos[i]))
    some = rows_of(S.read_frames(spark, [str(tmp_path / "a.trr")], "trr").where("frame > 8"))
    assert sorted(f for _, f in some) == [9, 10]
    chosen = rows_of(B.read_binary_frames(spark, str(tmp_path / "a.trr"), atoms="6,0", start=2, stride=3))
    assert sorted(f for _, f in chosen) == [2, 5, 8] and chosen["a.trr", 8].pos is None
    assert np.array_equal(positions(chosen["a.trr", 5]), pos[5][[6, 0]])


def test_trr_files_that_end_early_or_are_none(spark, tmp_path):
    frame = trr_frame(0, 0.0, np.eye(3), np.ones((5, 3)), None, "f")
    for name, data in (("a", frame * 3 + frame[:-1]), ("b", frame + frame[:40]), ("c", frame + frame[:10]), ("d", b"")):
        (tmp_path / f"{name}.trr").write_bytes(data)
    index = sorted((r.path.rpartition("/")[2], r.frames) for r in B.trajectory_index(spark, str(tmp_path)).collect())
    assert index == [("a.trr", 3), ("b.trr", 1), ("c.trr", 1)]
    (tmp_path / "e.trr").write_bytes(frame[:8] + b"\0" * 100)
    assert len(rows_of(S.read_frames(spark, [str(tmp_path)], "trr", ignore_errors=True))) == 5
    with pytest.raises(Exception, match="not a TRR frame"):
        B.trajectory_index(spark, str(tmp_path)).collect()


def padded(b):
    return b + b"\0" * (-len(b) % 4)


def write_netcdf(path, pos, time, version=1, units="angstrom"):
    """Classic layout: dimensions frame (open), spatial, atom, cell; a fixed variable and three open ones."""
    n, atoms, _ = pos.shape
    number = lambda v: struct.pack(">q" if version == 5 else ">i", v)
    name = lambda s: number(len(s)) + padded(s.encode())
    text = lambda k, v: name(k) + struct.pack(">i", 2) + number(len(v)) + padded(v.encode())
    dims = [("frame", 0), ("spatial", 3), ("atom", atoms), ("cell_spatial", 3)]
    variables = [("spatial", (1,), 2, 3, {}), ("time", (0,), 5, 4, {}), ("coordinates", (0, 2, 1), 5, 12 * atoms, {"units": units} if units else {}), ("cell_lengths", (0, 3), 6, 24, {"units": "angstrom"})]
    wide = 4 if version == 1 else 8

    def head(begins):
        out = b"CDF" + bytes([version]) + number(n) + struct.pack(">i", 10) + number(len(dims)) + b"".join(name(k) + number(v) for k, v in dims)
        out += struct.pack(">i", 12) + number(1) + text("Conventions", "AMBER") + struct.pack(">i", 11) + number(len(variables))
        for (k, d, kind, size, attributes), begin in zip(variables, begins, strict=True):
            out += name(k) + number(len(d)) + b"".join(map(number, d)) + struct.pack(">i", 12 if attributes else 0) + number(len(attributes)) + b"".join(text(a, v) for a, v in attributes.items())
            out += struct.pack(">i", kind) + number(size + -size % 4) + struct.pack(">i" if wide == 4 else ">q", begin)
        return out

    at = len(head([0] * 4))
    begins = [at, at + 4, at + 8, at + 8 + 12 * atoms]
    records = b"".join(struct.pack(">f", t) + p.astype(">f4").tobytes() + struct.pack(">3d", 7, 8, 9) for p, t in zip(pos, time, strict=True))
    path.write_bytes(head(begins) + b"xyz\0" + records)


@pytest.mark.parametrize("version, units", [(1, "angstrom"), (2, "nanometer"), (5, None)])
def test_netcdf_frames_come_back(spark, tmp_path, version, units):
    pos = np.random.default_rng(version).normal(size=(11, 7, 3)).astype("f4")
    write_netcdf(tmp_path / "t.nc", pos, np.arange(11) * 2.0, version, units)
    df = B.read_binary_frames(spark, str(tmp_path / "t.nc"), chunk=3, stop=10)
    got = rows_of(df)
    assert sorted(got) == [("t.nc", i) for i in range(10)] and df.rdd.getNumPartitions() == 4
    assert all(np.allclose(positions(r), pos[i]) and (r.time, r.units, r.box) == (2.0 * i, units or "angstrom", [7.0, 8.0, 9.0]) for (_, i), r in got.items())
    data = (tmp_path / "t.nc").read_bytes()
    (tmp_path / "t.nc").write_bytes(data[:-10])
    assert B.read_binary_frames(spark, str(tmp_path / "t.nc")).count() == 10


def test_kinds_together(spark, tmp_path):
    pos = np.random.default_rng(3).normal(size=(5, 12, 3)).astype("f4")
    T.write_dcd(str(tmp_path / "a.dcd"), pos)
    write_netcdf(tmp_path / "b.nc", pos, np.zeros(5))
    xtc = write_xtc(tmp_path / "c.xtc", 5, 12, 3)
    got = rows_of(B.read_binary_frames(spark, [f"file://{tmp_path}/{n}" for n in ("a.dcd", "b.nc", "c.xtc")], chunk=2))
    for name, want in (("a.dcd", pos), ("b.nc", pos), ("c.xtc", xtc)):
        assert all(np.allclose(positions(got[name, i]), want[i], atol=1e-6) for i in range(5))
    assert got["a.dcd", 0].box is None and got["a.dcd", 0].time is None and len(got) == 15
    with pytest.raises(ValueError, match="unknown format"):
        S.read_frames(spark, ["x"], "tng")


def test_representatives_as_structures(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(t, f, i, f"C{i}", "ALA" if i % 2 else None, "A", i // 2, *map(float, rng.normal(size=3) * 50)) for t in (0, 1) for f in range(4) for i in range(30)]
    rows += [(0, 1, 99, "X", "GLY", "B", 7, None, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "traj_id long, frame long, atom_id int, atom string, res_name string, chain string, res_id int, x double, y double, z double").repartition(5)
    chosen = spark.createDataFrame([(0, 1, 3, 1), (1, 2, 3, 2), (1, 0, 5, 1), (1, 0, 5, 1), (7, 7, 9, 1)], "traj_id long, frame long, state int, rank int")
    T.export_structures(atoms, chosen, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("structure=*")) == ["structure=state3_rank1", "structure=state3_rank2", "structure=state5_rank1"]
    for name, t, f in (("state3_rank1", 0, 1), ("state3_rank2", 1, 2), ("state5_rank1", 1, 0)):
        (file,) = (tmp_path / "out" / f"structure={name}").glob("*.txt")
        lines = file.read_text().splitlines()
        assert len(lines) == 31 and lines[-1] == "END" and [int(x[6:11]) for x in lines[:-1]] == list(range(30))
        got = {r.atom_id: r for r in T.read_pdb(spark, str(file)).collect()}
        want = {r[2]: r for r in rows if r[:2] == (t, f) and r[7] is not None}
        assert all((got[i].name, got[i].res_name or None, got[i].chain, got[i].res_id) == tuple(want[i][3:7]) and np.allclose([got[i].x, got[i].y, got[i].z], want[i][7:], atol=6e-4) for i in range(30))
