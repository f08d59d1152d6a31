"""Text files of a run: tables with tabs, histograms with white space, and the digests of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import shared_folder

#: A null is an empty field. Line breaks and back slashes in strings are written as escapes, so a row is a line; an empty string is one too.
TSV = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
EMPTY = "\\e"


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(c == "", EMPTY).otherwise(c)


def _restored(c: Column) -> Column:
    whole = F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(c == EMPTY, "").otherwise(F.array_join(whole, "\\"))


def _strings(rows: DataFrame, change) -> DataFrame:
    return rows.select(*[change(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in rows.schema])


def write_tsv(rows: DataFrame, name: str, *order: str) -> str:
    """Files in the given order, each with its header; rows are range-partitioned, so no task sorts all of them."""
    path = shared_folder(rows.sparkSession, name)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _strings(rows, _escaped).repartitionByRange(parts, *order).sortWithinPartitions(*order).write.options(**TSV).csv(path)
    return path


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return _strings(spark.read.schema(schema).options(**TSV, enforceSchema="false", multiLine="false").csv(path), _restored)


def _lines(rows: DataFrame, name: str, by: str, line, *ties: str) -> str:
    """Text files below folders by=value, lines in order: rows of a name go to one task, as a file is one. Rows of equal order go by the columns of ties."""
    path = shared_folder(rows.sparkSession, name)
    rows.repartition(by).sortWithinPartitions(by, "__order", *ties).select(by, line.alias("value")).write.partitionBy(by).text(path)
    return path


def write_columns(rows: DataFrame, by: str, order: str) -> str:
    """A file of white-space columns for each value of by: the order's column first, then all others, after a line of comment at the top.
    Lines of equal order go by the other columns, from the left."""
    other = [c for c in rows.columns if c not in (by, order)]
    body = F.concat_ws("  ", F.col(order).cast("string"), *[F.col(c).cast("string") for c in other])
    ties = [f"__tie{i}" for i in range(len(other))]
    own = rows.select(by, F.col(order).alias("__order"), body.alias("__line"), *[F.col(c).alias(t) for c, t in zip(other, ties, strict=True)])
    heads = rows.select(by).distinct().select(by, F.lit(None).cast(rows.schema[order].dataType).alias("__order"), F.lit("# columns").alias("__line"), *[F.lit(None).cast(rows.schema[c].dataType) for c in other])
    return _lines(own.union(heads), "columns", by, F.col("__line"), *ties)


def summaries(path: str, spark: SparkSession) -> DataFrame:
    """For each file its first data line's first two columns, and how many data lines it has. Lines are numbered by their place in the file."""
    rows = spark.read.text(path).select("event_type", F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    data = rows.where("trim(line) != '' and not ltrim(line) like '#%'").withColumn("f", F.split(F.trim("line"), r"\s+"))
    first = F.min_by("f", F.struct("file", "block", "at"))
    return data.groupBy("event_type").agg(F.count("*").alias("lines"), first.alias("f")).select("event_type", "lines", F.get("f", 0).cast("double").alias("first_snr"), F.get("f", 1).cast("long").alias("first_id"))


def write_lines(rows: DataFrame, by: str, value: str) -> str:
    return _lines(rows.withColumn("__order", F.col(value)), "lines", by, F.col(value).cast("string"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name (of the folder by=value) and SHA-256 of each file; a file is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"=([^/]*)/[^/]*$", 1).alias("name"), F.sha2("content", 256).alias("sha"))
