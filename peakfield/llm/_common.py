"""Helpers that the operators share: tables in the shared folder, free column names, bounded Arrow batches, hashes."""

from __future__ import annotations

import ctypes
import glob
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only where no cluster names one
    (tests on one machine) a temporary folder is taken and named in the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder (in folders by a column, if one is named) and reads it again: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).partitionBy(*[by] if by else []).parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows.select(*df.columns) if by else rows


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by bytes, as a few long documents may fill one that is bounded by rows alone. All operators take the same bound, so
    a query built later changes nothing for one that has not run yet."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slim(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under fixed names, so that no other column of the table can clash."""
    return df.select(*[df[c].alias(k) for k, c in cols.items()])


def chunks(texts: list[str], limit: int = 2 << 20):
    """(from, to) of runs of texts of about limit characters in total; a text is never cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64 on an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def is_held(id_col, modulus: int, rest: int):
    """Whether crc32 of the id as text has that remainder; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(0)) == rest


@lru_cache(1)
def one_thread() -> None:
    """Keeps numpy's matrix products in the calling thread: Spark runs a task on each core already, and threads that wait for each other burn the
    time of other tasks. Where numpy has another library than the one of its wheels, nothing is changed."""
    for lib in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        if limit := getattr(ctypes.CDLL(lib), "scipy_openblas_set_num_threads64_", None):
            limit(1)


def released() -> None:
    """Gives memory that this Python worker has freed back to the machine, called at a task's start and end: Spark takes idle workers in turn, also more of
    them than cores where a stage has two functions, and what each leaves adds up."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
