"""Commits of folders: a small file of JSON that is written after all else, so a folder without it holds no result."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "metadata.json"


def commit(spark: SparkSession, path: str, about: dict) -> None:
    """One file, moved into place whole by Spark's committer; a folder that has one already is an error."""
    text = json.dumps(about, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{path.rstrip('/')}/{NAME}")


def committed(spark: SparkSession, path: str) -> dict:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(f"{path.rstrip('/')}/{NAME}").first()
    except AnalysisException:
        row = None
    if row is None:
        raise ValueError(f"{path} holds no committed result")
    return json.loads(row.value)


def write_result(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict) -> dict:
    """Several tables as one result: each is written below path, and the commit, with their names, columns and numbers of rows, comes last. What is in the
    commit is also returned."""
    root, told = path.rstrip("/"), {}
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}")
        told[name] = {"columns": rows.columns, "rows": spark.read.parquet(f"{root}/{name}").count()}
    out = about | {"tables": told}
    commit(spark, path, out)
    return out


def read_result(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a committed result. A table whose rows are not as many as the commit says is an error when it is read first."""
    told = committed(spark, path)["tables"]
    if name not in told:
        raise ValueError(f"the result has no table {name}; it has {', '.join(sorted(told))}")
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def results(spark: SparkSession, root: str) -> DataFrame:
    """run (its folder) and about (JSON) of every committed result below a folder; runs without a commit do not show."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(root).select("value", F.col("_metadata.file_path").alias("file"))
    return files.where(F.col("file").contains(f"/{NAME}/")).select(F.regexp_extract("file", rf"([^/]+)/{NAME}/", 1).alias("run"), F.col("value").alias("about"))
