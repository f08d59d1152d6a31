"""Folders and files that the driver and all tasks share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where no cluster names one (tests on one machine), below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-files-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_bytes(uri: str, data: bytes) -> None:
    """One whole file, or none if the task is lost meanwhile."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    begun = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(begun) as out:
        out.write(data)
    fs.move(begun, path)
