"""WARC archives: writing pages as transactions, reading records, and assembling each capture again.

A page becomes three records: the request and the metadata name the response in WARC-Concurrent-To. Records are lines of a text
file whose line end is the blank line that closes a record, so Spark's own writer and committer make the archives, and a task
that runs again leaves one file. The reader opens archives as streams in its tasks and parses whole records by their Content-Length, so a task holds a
batch of records and no archive, however large; an archive that ends inside a record is an error.

Cases: a null or empty payload has zero bytes. Null urls are empty. Of records with equal payloads (from a least size on) those with
the smallest page id are responses and the others revisit it; a null page id never is, unless all are null. Every row is a capture of its own, whose records
share a row number in their ids, so identical rows stay apart. Very long payloads are written and read whole. An empty table gives an empty archive. Of
the table only the id, the url and the payload are read, so no other column clashes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slim, small_batches, written

END = "\r\n\r\n"
#: Digits of base 32 as conv() gives them, and those of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, payload_digest string, block binary, payload_bytes long, payload_sha1 string"


def sha1_base32(data: Column) -> Column:
    h = F.sha1(data)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]), DIGITS, BASE32)


def record_id(kind: str, *parts: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """id, url, payload with digest, bytes and a row number, and for a revisit the id, url and row of its response. Rows are written once, with their numbers,
    so a lost executor changes none. Only digests that occur more than once are joined, without payloads; payloads move by row number alone, so many equal
    ones don't meet in a task."""
    rows = pages.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("url", F.coalesce("url", F.lit("")))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pages", "zstd")
    lean = rows.select("row", "id", "digest", "bytes").where(F.col("bytes") >= least)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url", "row")).alias("first")
    same = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(first, F.count("*").alias("n")).where("n > 1")
    found = lean.join(same, ["digest", "bytes"]).where(~F.col("id").eqNullSafe(F.col("first.id")))
    again = found.select("row", F.lit("revisit").alias("again"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.row").alias("first_row"))
    return rows.join(again, "row", "left").withColumn("kind", F.coalesce("again", F.lit("response"))).drop("again")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 3000) -> None:
    rows = classified(slim(pages, id=key, url=url, payload=html), least)
    rows = rows.withColumn("own", record_id("response", "id", "url", "digest", "row"))
    rows = rows.withColumn("target", record_id("response", "first_id", "first_url", "digest", "first_row"))
    uri = F.regexp_replace("url", r"[\r\n]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))

    def record(kind, own, body, *more) -> Column:
        lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), own), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), *more, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
        return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)

    beside = F.concat(F.lit("WARC-Concurrent-To: "), F.col("own"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    revisit = F.col("kind") == "revisit"
    path_of = F.coalesce(F.regexp_extract(uri, r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("/"))
    three = F.array(
        record(F.lit("request"), record_id("request", "id", "url", "digest", "row"), F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1\r\n\r\n")), beside),
        record(F.col("kind"), F.col("own"), F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))), digest, F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), F.col("target")))),
        record(F.lit("metadata"), record_id("metadata", "id", "url", "digest", "row"), F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")), beside),
    )
    rows.select(F.explode(three).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """An archive, plain or gzip (of one member or many), as a stream of its bytes. path: as Spark names files."""
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    fs, own = FileSystem.from_uri(quote(uri, safe="/:@"))
    with fs.open_input_stream(own, compression=None) as raw:
        yield io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 18)


def records(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive, one by one."""
    while first := stream.readline():
        if not first.strip():
            continue  # what closes a record
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        head = []
        while (line := stream.readline()).strip():
            head.append(line.decode("utf-8", "replace").rstrip("\r\n").split(":", 1))
        fields = {x[0].lower(): x[1].strip() for x in head if len(x) == 2}
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise EOFError(f"the archive ends inside the record {fields.get('warc-record-id')}")
        payload = block
        if fields["warc-type"] in ("response", "revisit"):
            _, found, rest = block.partition(b"\r\n\r\n")
            payload = rest if found else block
        yield {
            "record_id": fields.get("warc-record-id"), "type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "block": block, "payload_bytes": len(payload), "payload_sha1": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        }


def read_warc(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """One row for each record of the archives below path whose names match glob, plain or gzip; payload_bytes and payload_sha1 are measured on the bytes read."""
    small_batches(spark)

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part["path"]:
                own, size = [], 0
                with opened(name) as stream:
                    for r in records(stream):
                        own.append(r)
                        size += len(r["block"])
                        if size > 8 << 20:
                            yield pd.DataFrame(own)
                            own, size = [], 0
                if own:
                    yield pd.DataFrame(own)

    # only names are read here; Spark deals files to tasks by their sizes
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path").mapInPandas(parse, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: record_id, uri, date, response, request and metadata. Requests and metadata find
    their response by WARC-Concurrent-To; either may be missing (null). A record that stands twice counts once; of several requests of a
    response the one with the smallest id counts."""
    inner = [c for c in found.columns if c not in ("record_id", "uri", "date")]
    nest = lambda kind: found.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct("record_id", *inner), "record_id").alias(kind))
    main = found.where(F.col("type").isin("response", "revisit")).dropDuplicates(["record_id"]).select("record_id", "uri", "date", F.struct(*inner).alias("response"))
    return main.join(nest("request"), "record_id", "left").join(nest("metadata"), "record_id", "left")


def captures(found: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to, as the records read back tell. A revisit's payload is that
    of the response it refers to."""
    lean = found.withColumn("page_id", F.when(F.col("type") == "metadata", F.expr("try_cast(regexp_extract(cast(block as string), 'page-id: (-?[0-9]+)', 1) as bigint)"))).drop("block")
    own = assemble(written(lean, "records", "zstd"))  # parsed once
    row = own.select("record_id", F.col("metadata.page_id").alias("page_id"), *[F.col(f"response.{c}") for c in ("type", "refers_to", "payload_bytes", "payload_sha1")], F.col("request.record_id").alias("request_id"))
    target = row.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"), F.col("payload_bytes").alias("b"), F.col("payload_sha1").alias("d"))
    # a response refers to itself here, so that no null key sends all responses to one task
    joined = row.withColumn("refers_to", F.coalesce("refers_to", "record_id")).join(target, "refers_to", "left")
    return joined.select("page_id", F.coalesce("b", "payload_bytes").alias("payload_bytes"), F.coalesce("d", "payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("target")).alias("refers_to"), F.col("request_id").isNotNull().alias("has_request"))
