"""MRC files: stacks of images and volumes.

A reader's row is one section of a file, so a file of any depth never stands in one row. A writer makes stacks of a bounded number
of sections in each task, under names of their own, and a manifest (Parquet) says which image is which section of which file; files that no
manifest names, left by lost tasks, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_bytes

#: Fixed values of the MRC2014 format: types by mode, and the length of the header.
MODES = {0: "i1", 1: "<i2", 2: "<f4", 6: "<u2", 12: "<f2"}
HEADER = 1024
SECTION = "file string, z int, nx int, ny int, nz int, voxel float, values array<float>"


def header(shape: tuple[int, int, int], voxel: float, low: float, high: float, mean: float, rms: float) -> bytes:
    """The header of a float32 file of (sections, rows, columns)."""
    nz, ny, nx = shape
    out = np.zeros(HEADER // 4, "<i4")
    real = out.view("<f4")
    out[[0, 1, 2, 3, 7, 8, 9]] = nx, ny, nz, 2, nx, ny, nz
    real[[10, 11, 12, 13, 14, 15]] = nx * voxel, ny * voxel, nz * voxel, 90, 90, 90
    out[[16, 17, 18]] = 1, 2, 3
    real[[19, 20, 21, 54]] = low, high, mean, rms
    raw = bytearray(out.tobytes())
    raw[208:216] = b"MAP DD\x00\x00"
    return bytes(raw)


def encoded(values: np.ndarray, voxel: float) -> bytes:
    v = np.ascontiguousarray(values, "<f4")
    return header(v.shape, voxel, v.min(), v.max(), v.mean(dtype=np.float64), v.std(dtype=np.float64)) + v.tobytes()


def sections(name: str, data: bytes) -> Iterator[pd.DataFrame]:
    """The sections of a file, one row each. Values that are not finite are an error."""
    whole = np.frombuffer(data[:HEADER], "<i4")
    nx, ny, nz, mode = (int(x) for x in whole[:4])
    width, mx = whole.view("<f4")[10], int(whole[7])
    kind = np.dtype(MODES[mode])
    at = HEADER + int(whole[23])
    for z in range(nz):
        v = np.frombuffer(data, kind, nx * ny, at + z * nx * ny * kind.itemsize).astype(np.float32)
        if not np.isfinite(v).all():
            raise ValueError(f"values that are not finite in section {z + 1} of {name}")
        yield pd.DataFrame({"file": [name], "z": [z + 1], "nx": [nx], "ny": [ny], "nz": [nz], "voxel": [np.float32(width / mx if mx else 0)], "values": [v]})


def read_mrc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each section (z from 1) of the files below path."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                yield from sections(name.rsplit("/", 1)[-1], data)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mrc").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parse, SECTION)


def voxel_size(fallback: float | None = None) -> Column:
    """The voxel size that the file states, else the fallback, else an error."""
    own = F.when((F.col("voxel") > 0) & ~F.isnan("voxel") & (F.col("voxel") < float("inf")), F.col("voxel"))
    other = F.lit(fallback).cast("float") if fallback else F.raise_error(F.concat(F.lit("no voxel size in "), F.col("file"))).cast("float")
    return F.coalesce(own, other)


def search_images(found: DataFrame, section: int = 1) -> DataFrame:
    """That section of each file; another section than the first of a single image is an error."""
    if section == 1:
        return found.where("z = 1")
    wrong = F.when(F.col("nz") == 1, F.raise_error(F.concat(F.lit("one section only in "), F.col("file"))).cast("boolean"))
    return found.where(F.coalesce(wrong, F.col("z") == section))


def volumes(found: DataFrame) -> DataFrame:
    """The sections of cubic volumes; another shape is an error."""
    wrong = F.when((F.col("nx") != F.col("ny")) | (F.col("ny") != F.col("nz")), F.raise_error(F.concat(F.lit("not cubic: "), F.col("file"))).cast("boolean"))
    return found.where(F.coalesce(wrong, F.lit(True)))


def write_stacks(images: DataFrame, uri: str, key: str, values: str, shape: tuple[int, int], voxel: float, per_file: int = 512) -> DataFrame:
    """Writes images (flat arrays of a common shape) as stacks below uri and gives the manifest: key, file, z."""
    kind = images.schema[key].dataType.simpleString()

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), per_file):
                rows = part.iloc[a : a + per_file]
                name = f"{uuid.uuid4().hex}.mrc"
                write_bytes(f"{uri}/{name}", encoded(np.stack(rows["values"].to_list()).reshape(-1, *shape), voxel))
                yield pd.DataFrame({"key": rows["key"], "file": name, "z": np.arange(1, len(rows) + 1)})

    rows = images.select(images[key].alias("key"), images[values].alias("values")).where("values is not null")
    rows.mapInPandas(store, f"key {kind}, file string, z int").write.parquet(f"{uri}/manifest")
    return images.sparkSession.read.parquet(f"{uri}/manifest").withColumnRenamed("key", key)


def write_volumes(rows: DataFrame, uri: str, name: str, values: str, side: int, voxel: float) -> int:
    """Writes each row's flat array as a cubic volume in a file of its name below uri; how many there are."""

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for own, v in zip(part["name"], part["values"], strict=True):
                write_bytes(f"{uri}/{own}.mrc", encoded(np.asarray(v).reshape((side,) * 3), voxel))
            yield pd.DataFrame({"n": [len(part)]})

    made = rows.select(F.col(name).cast("string").alias("name"), F.col(values).alias("values")).mapInPandas(store, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def read_stacks(spark: SparkSession, uri: str, key: str) -> DataFrame:
    """The sections that the manifest names, with the key of each."""
    return spark.read.parquet(f"{uri}/manifest").withColumnRenamed("key", key).join(read_mrc(spark, uri), ["file", "z"])
