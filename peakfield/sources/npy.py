"""Arrays as NPY files, one for each row, and the comparison of two folders of them."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_bytes


def write_arrays(rows: DataFrame, uri: str, name: str, values: str) -> int:
    """Writes an array of each row to a file of its name below uri; how many there are. A task that is lost writes its files again."""

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for own, v in zip(part["name"], part["values"], strict=True):
                out = io.BytesIO()
                np.save(out, np.asarray(v), allow_pickle=False)
                write_bytes(f"{uri}/{own}.npy", out.getvalue())
            yield pd.DataFrame({"n": [len(part)]})

    made = rows.select(F.col(name).cast("string").alias("name"), F.col(values).alias("values")).mapInPandas(store, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def files(spark: SparkSession, uri: str) -> DataFrame:
    """name (the path below the folder, without suffix) and content of the files below a folder."""
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?", "", uri).rstrip("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(uri)
    return found.select(F.regexp_extract("path", re.escape(base).replace("/", "/+") + r"/+(.+)\.npy$", 1).alias("name"), "content")


def compared(reference: DataFrame, candidate: DataFrame, atol: float, rtol: float) -> DataFrame:
    """name, status (missing_reference, missing_candidate, shape, close or different) and, of arrays of one shape, max_abs, mean_abs, rmse and rel_l2."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, a, b in zip(part["name"], part["a"], part["b"], strict=True):
                if a is None or b is None:
                    out.append((name, "missing_reference" if a is None else "missing_candidate", None, None, None, None))
                    continue
                a, b = (np.load(io.BytesIO(x), allow_pickle=False).astype(float) for x in (a, b))
                if a.shape != b.shape:
                    out.append((name, "shape", None, None, None, None))
                    continue
                d = np.abs(b - a)
                size = max(1, d.size)
                close = bool((d <= atol + rtol * np.abs(a)).all())
                out.append((name, "close" if close else "different", float(d.max(initial=0)), float(d.sum() / size), float(np.sqrt((d * d).sum() / size)), float(np.sqrt((d * d).sum()) / max(np.sqrt((a * a).sum()), 1e-30))))
            yield pd.DataFrame(out, columns=["name", "status", "max_abs", "mean_abs", "rmse", "rel_l2"])

    both = reference.select("name", F.col("content").alias("a")).join(candidate.select("name", F.col("content").alias("b")), "name", "full_outer")
    return both.mapInPandas(run, "name string, status string, max_abs double, mean_abs double, rmse double, rel_l2 double")
