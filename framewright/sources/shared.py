"""Folders that the driver and all executors see, for what one step writes and another reads."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below ``spark.checkpoint.dir``; it is deleted when the driver ends.

    Only where that is unset and the master is local a temporary folder is set for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    uri = f"{root.rstrip('/')}/framewright/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, uri)
    return uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it again, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(uri: str) -> None:
    """Delete a folder if it is there."""
    with contextlib.suppress(OSError, ValueError):
        if uri.startswith("file:") or "://" not in uri:
            fs, path = pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
        else:
            fs, path = pafs.FileSystem.from_uri(uri)
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)
