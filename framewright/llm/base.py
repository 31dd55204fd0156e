"""Shared folders, stored tables and batch helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list = []  # folders and broadcast variables
_marked: list = []


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) a temporary folder is made and set; on a
    cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared one; it is made by whoever writes to it."""
    uri = f"{shared_root(spark)}/framewright/{name}-{uuid.uuid4().hex}"
    _made.append(uri)
    return uri


def lasting_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder below the shared one that stays until the session's process ends."""
    uri = f"{shared_root(spark)}/framewright/{name}"
    atexit.register(delete_folder, uri)
    return uri


def broadcast(spark: SparkSession, value):
    """A broadcast variable that is destroyed with the folders made at its time."""
    shared = spark.sparkContext.broadcast(value)
    _made.append(shared)
    return shared


def discard(made) -> None:
    """Delete a folder or destroy a broadcast variable."""
    if isinstance(made, str):
        delete_folder(made)
    else:
        with contextlib.suppress(Exception):  # the session may have ended before
            made.destroy()


@contextlib.contextmanager
def scope():
    """What is made inside ends with it; its readers must be done by then."""
    at = len(_made)
    try:
        yield
    finally:
        while len(_made) > at:
            discard(_made.pop())


@contextlib.contextmanager
def marked():
    """Folders and variables made inside are those that ``release_marked`` deletes."""
    at = len(_made)
    try:
        yield
    finally:
        _marked.extend(_made[at:])
        del _made[at:]


def release_marked() -> None:
    """Delete what was made inside ``marked``; its readers must be done."""
    while _marked:
        discard(_marked.pop())


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, on any node."""
    if uri.startswith("file:"):
        uri = uri[5:]
        return pafs.LocalFileSystem(), "/" + uri.lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def delete_folder(uri: str) -> None:
    try:
        fs, path = filesystem(uri)
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)
    except OSError:
        pass


def release() -> None:
    """Delete every folder and broadcast variable that the operators have made so far.

    Call it only once the results that read them are written elsewhere.
    """
    while _made:
        discard(_made.pop())
    release_marked()


atexit.register(release)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: a lost executor costs no more than the tasks after this table.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def text_column(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_held: dict[tuple, object] = {}


def held(kind: str, key, make):
    """The worker's one large object: a tokenizer, automata or a lattice; another one replaces it."""
    if (kind, key) not in _held:
        forget()
        _held[kind, key] = make()
        trim()
    return _held[kind, key]


def forget() -> None:
    """Drop the worker's large object and give freed memory back to the system."""
    _held.clear()
    gc.collect()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, light: bool = False):
    """``run`` over a task's batches, with its memory given back at the end; a ``light`` one also drops the large object first."""

    def whole(batches):
        if light:
            forget()
        yield from run(batches)
        trim()

    return whole


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part holds about ``most_bytes`` of ``column`` and a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def group_minimum(rows: DataFrame, keys: list[str], value: str, salts: int = 32, pick=F.min) -> DataFrame:
    """Give each row the least ``value`` of its group as ``leader``, for groups of two rows or more.

    ``pick`` may be F.max for the largest. Rows alone in their group are left out. A hot group is
    spread over ``salts`` tasks: its minimum is found from one row a salt, and only those rows are
    joined to the group's rows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(pick(value).alias("_best"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy(*keys).agg(pick("_best").alias("leader"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    spread = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], salts: int = 32) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has one row a key, whatever share a key has of the rows.

    The table's row is copied once for each salt (a hash of the columns ``by``) that its key really has.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    spread = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")
