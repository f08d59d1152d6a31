"""Prepared inputs that are made once: named by the SHA-256 of what they are made from and by the settings they are made with.

Entries of all preparations stand in one folder, one folder below it for each preparation. What has an entry is not made again; a changed
content or setting has another name and is made anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(settings: dict) -> str:
    """Settings as text that does not depend on their order."""
    return json.dumps(settings, sort_keys=True)


def named(sources: DataFrame, content: str, settings: dict) -> DataFrame:
    """sources with sha256 of the content (null: of nothing) and entry, the name of what is made of it under these settings."""
    rows = sources.withColumn("sha256", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256))
    return rows.withColumn("entry", F.sha2(F.concat_ws("\n", "sha256", F.lit(signature(settings))), 256))


def entries(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def prepare(sources: DataFrame, content: str, settings: dict, make: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, int]:
    """sources with what was made of each, and how many entries were made now. make: of the distinct new sources (entry, sha256, content) to rows with entry
    and whatever it makes. Equal contents are made once, whatever they are called."""
    spark = sources.sparkSession
    own = named(sources, content, settings)
    wanted = own.groupBy("entry").agg(F.first("sha256").alias("sha256"), F.first(content).alias(content))
    before = entries(spark, path)
    new = wanted if before is None else wanted.join(before.select("entry"), "entry", "left_anti")
    folder = f"{path.rstrip('/')}/preparation={uuid.uuid4().hex}"
    make(new).write.parquet(folder)
    made = spark.read.parquet(folder).count()
    every = spark.read.parquet(path).drop("preparation")
    return own.join(every, "entry"), made
