"""Queries of times and rates, with the same queries in SQL but for measured ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from .kernel import clean, table
from .operators import search, timing
from .sources import commits
from .sources.files import shared_folder

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("""SELECT event_type AS section, count(*) AS "count", round(sum(value), 4) + 0.0 AS total_seconds, round(avg(value), 6) + 0.0 AS mean_seconds, round(quantile_cont(value, 0.5), 6) + 0.0 AS median_seconds, round(quantile_cont(value, 0.9), 6) + 0.0 AS p90_seconds,
round(quantile_cont(value, 0.95), 6) + 0.0 AS p95_seconds, round(quantile_cont(value, 0.99), 6) + 0.0 AS p99_seconds, min(value) + 0.0 AS minimum_seconds, max(value) + 0.0 AS maximum_seconds FROM events WHERE value >= 0 AND value < 'Infinity'::DOUBLE GROUP BY event_type""")
def timed_sections(spark, d):
    rows = timing.sections(table(spark, d, "events").select(F.col("event_type").alias("section"), F.col("value").alias("seconds")))
    ends = ["minimum_seconds", "maximum_seconds"]
    rest = [c for c in rows.columns if c.endswith("_seconds") and c not in ["total_seconds", *ends]]
    return rows.select("section", "count", clean("total_seconds", 4).alias("total_seconds"), *[clean(c).alias(c) for c in rest], *ends)


@query("""WITH s AS (SELECT l_orderkey AS batch, concat(l_returnflag, l_linestatus) AS section, sum(l_quantity) AS own FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT avg(w) AS whole FROM (SELECT sum(own) AS w FROM s GROUP BY batch)),
n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT section, count(*) AS samples, round(avg(own), 6) + 0.0 AS mean_seconds, max(own) AS maximum_seconds, round(avg(own) * any_value(n), 4) + 0.0 AS estimated_seconds, round(avg(own) / any_value(whole), 8) + 0.0 AS fraction FROM s, b, n GROUP BY section
UNION ALL SELECT concat('wall ', l_returnflag), count(*), round(avg(l_quantity), 6) + 0.0, max(l_quantity), round(sum(l_quantity), 4) + 0.0, NULL FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY l_returnflag""")
def timing_report(spark, d):
    """A report written and read back. Orders are batches: those of even keys are the sampled ones, the lines of the others are times outside of batches."""
    lines = table(spark, d, "lineitem")
    even = F.col("l_orderkey") % 2 == 0
    samples = lines.select(F.when(even, F.col("l_orderkey")).alias("batch"), F.when(even, F.concat("l_returnflag", "l_linestatus")).otherwise(F.concat(F.lit("wall "), "l_returnflag")).alias("section"), F.col("l_quantity").alias("seconds"))
    batches = samples.where("batch is not null").groupBy("batch").agg(F.sum("seconds").alias("seconds"))
    path = shared_folder(spark, "timing")
    timing.write_report(spark, path, samples, batches, lines.select("l_orderkey").distinct().count(), 10.0, 1000, 64)
    out = commits.read_result(spark, path, "sections").select("section", "samples", clean("mean_seconds").alias("mean_seconds"), "maximum_seconds", clean("estimated_seconds", 4).alias("estimated_seconds"), clean("fraction", 8).alias("fraction"))
    whole = commits.read_result(spark, path, "wall_sections")
    return out.union(whole.select("section", "count", clean("mean_seconds"), "maximum_seconds", clean("total_seconds", 4), F.lit(None).cast("double")))


@query("""WITH u AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall, count(*) AS n, count(DISTINCT event_type) AS b FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN wall > 0 THEN round(n / wall, 9) END AS orientations_per_second, CASE WHEN wall > 0 THEN round(b / wall, 9) END AS batches_per_second, CASE WHEN wall > 0 AND user_id % 3 > 0 THEN round(n * (user_id % 3) / wall, 9) END AS ccf_pixels_per_second FROM u""")
def search_rates(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").groupBy("user_id").agg(((F.max(at) - F.min(at)) / 1e6).alias("wall"), F.count("*").alias("n"), F.count_distinct("event_type").alias("b"))
    own = rows.select("user_id", *timing.rates(F.col("wall"), F.col("n"), F.col("b"), F.col("user_id") % 3))
    return own.select("user_id", *[F.round(c, 9).alias(c) for c in own.columns[1:]])


@query(None)
def measured_search(spark, d):
    """A whole search, written, and the stages that it took; times differ from run to run, so there is no SQL."""
    images = table(spark, d, "embeddings")
    path = shared_folder(spark, "measured")
    _, rows = timing.measured(spark, lambda: search.maximum(search.scores(images, search.templates(images))).write.parquet(path))
    return rows
