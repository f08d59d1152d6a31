"""Paths that catalogs give, resolved against a listing of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path of every file below a folder, without its scheme; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/").alias("path"))


def normal(path: Column) -> Column:
    """Without empty parts and ".", and with ".." taken back; a path that begins with a slash stays absolute."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    back = lambda kept: (F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1) != "..")
    kept = F.aggregate(parts, none, lambda kept, p: F.when((p == "..") & back(kept), F.slice(kept, 1, F.size(kept) - 1)).when((p == "..") & path.startswith("/"), kept).otherwise(F.concat(kept, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def resolved(rows: DataFrame, column: str, files: DataFrame, roots: list[str], name: str = "resolved") -> DataFrame:
    """rows with the first of roots/path that is in files (path), or else the first of all; exists tells which. An absolute path stays as it is. Each distinct path is
    looked up once; null stays null."""
    own = rows.select(F.col(column).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    candidates = F.when(F.col("raw").startswith("/"), F.array(normal(F.col("raw")))).otherwise(F.array(*[normal(F.concat(F.lit(r.rstrip("/") + "/"), F.col("raw"))) for r in roots]))
    each = own.select("raw", F.posexplode(candidates).alias("at", "path"))
    found = each.join(files.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    order = F.struct(F.coalesce("there", F.lit(False)).cast("int").alias("there"), (-F.col("at")).alias("at"))
    best = found.groupBy("raw").agg(F.max_by(F.struct("path", F.coalesce("there", F.lit(False)).alias("there")), order).alias("x"))
    out = best.select(F.col("raw").alias("_raw"), F.col("x.path").alias(name), F.col("x.there").alias("exists"))
    return rows.join(out, rows[column] == out["_raw"], "left").drop("_raw")
