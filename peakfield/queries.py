"""The queries of the library over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import arrays, catalog, histogram, peaks, search

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


SCORES = """WITH px AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
mean AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM px GROUP BY label, pos),
tpl AS (SELECT CAST(label AS BIGINT) AS task, list(v ORDER BY pos) AS template FROM mean GROUP BY label),
sc AS (SELECT vec_id, task, round(list_sum(list_transform(list_zip(embedding, template), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 9) AS score FROM embeddings CROSS JOIN tpl),
best AS (SELECT vec_id, CASE WHEN score > 0 THEN score ELSE 0.0 END AS mip, CASE WHEN score > 0 THEN task END AS task FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, task) AS r FROM sc) WHERE r = 1),
mom AS (SELECT vec_id, sum(score) AS s1, sum(score * score) AS s2, count(*) AS n FROM sc GROUP BY vec_id),
overall AS (SELECT count(*) AS counted, sum(s1) / sum(n) AS mean, sqrt(greatest(sum(s2) / sum(n) - (sum(s1) / sum(n)) ** 2, 1e-12)) AS std FROM mom WHERE s2 > 1e-4)
"""


def _scores(spark, d):
    images = table(spark, d, "embeddings")
    return search.scores(images, search.templates(images))


@query(SCORES + "SELECT vec_id, round(mip, 6) AS mip, task FROM best")
def mip_argmax(spark, d):
    return search.maximum(_scores(spark, d)).select("vec_id", F.round("mip", 6).alias("mip"), "task")


@query(SCORES + "SELECT vec_id, round(s1, 6) AS s1, round(s2, 6) AS s2, n FROM mom")
def moments(spark, d):
    return search.moments(_scores(spark, d)).select("vec_id", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "n")


@query(SCORES + "SELECT counted, round(mean, 6) AS mean, round(std, 6) AS std FROM overall")
def global_scale(spark, d):
    return search.global_scale(search.moments(_scores(spark, d))).select("counted", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    SCORES
    + """, z AS (SELECT vec_id, s2, (mip - mean) / std AS z, (s1 / n - mean) / std AS lm, (s2 / n - 2 * mean * s1 / n + mean * mean) / (std * std) AS sq FROM best JOIN mom USING (vec_id) CROSS JOIN overall),
l AS (SELECT *, sqrt(greatest(sq - lm * lm, 1e-12)) AS ls FROM z)
SELECT vec_id, round(z, 5) AS z, round(CASE WHEN s2 > 1e-4 AND ls > 1e-4 THEN (z - lm) / ls ELSE z END, 5) AS scaled FROM l"""
)
def flat_field(spark, d):
    return search.scaled_maps(search.reduced(_scores(spark, d))).select("vec_id", F.round("z", 5).alias("z"), F.round("scaled", 5).alias("scaled"))


@query(
    SCORES
    + """, partial AS (SELECT sum(s1) / sum(n) AS mean, sqrt(greatest(sum(s2) / sum(n) - (sum(s1) / sum(n)) ** 2, 1e-12)) AS std FROM mom WHERE s2 > 1e-4 AND vec_id % 5 <> 2),
z AS (SELECT vec_id, n, vec_id % 5 <> 2 AND s2 > 1e-4 AS counted, (mip - mean) / std AS z, (s1 - n * mean) / std AS s, (s2 - 2 * mean * s1 + n * mean * mean) / (std * std) AS q FROM best JOIN mom USING (vec_id) CROSS JOIN partial),
l AS (SELECT vec_id, z, counted, CASE WHEN counted THEN s ELSE 0 END AS s, CASE WHEN counted THEN q ELSE 0 END AS q, CASE WHEN counted THEN s / n ELSE 0 END AS lm, CASE WHEN counted THEN sqrt(greatest(q / n - (s / n) ** 2, 0)) ELSE 0 END AS ls FROM z)
SELECT vec_id, round(z, 5) + 0.0 AS z, round(lm, 5) + 0.0 AS local_mean, round(ls, 5) + 0.0 AS local_std, round(s, 4) + 0.0 AS sum, round(q, 4) + 0.0 AS squares, round(CASE WHEN counted AND ls > 1e-4 THEN (z - lm) / ls ELSE z END, 5) + 0.0 AS scaled, round(z, 5) + 0.0 AS not_flattened FROM l"""
)
def masked_scale(spark, d):
    """All scaled maps of a search whose statistics rest on four of five places, with flattening and without."""
    found = search.reduced(_scores(spark, d))
    valid = F.col("vec_id") % 5 != 2
    plain = search.scaled_maps(found, valid=valid, flatten=False).select("vec_id", (F.round("scaled", 5) + 0.0).alias("not_flattened"))
    digits = {"z": 5, "local_mean": 5, "local_std": 5, "sum": 4, "squares": 4, "scaled": 5}
    return search.scaled_maps(found, valid=valid).select("vec_id", *[(F.round(c, n) + 0.0).alias(c) for c, n in digits.items()]).join(plain, "vec_id")


@query(SCORES + "SELECT vec_id, round(mip, 6) AS mip, task, round(s1, 6) AS s1, round(s2, 6) AS s2, n FROM best JOIN mom USING (vec_id)")
def shard_merge(spark, d):
    s = _scores(spark, d)
    parts = [s.where(F.pmod("task", F.lit(3)) == i) for i in range(3)]
    own = search.merged(*[search.reduced(p, initial=-1e9) for p in parts])
    won = F.col("mip") > 0
    own = own.withColumn("task", F.when(won, F.col("task"))).withColumn("mip", F.when(won, F.col("mip")).otherwise(0.0))
    return own.select("vec_id", F.round("mip", 6).alias("mip"), "task", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "n")


@query("SELECT event_id, event_id % 121 AS orientation, (event_id // 121) % 7 AS defocus, (event_id // 121) // 7 AS pixel FROM events")
def winner_decode(spark, d):
    return search.decode(table(spark, d, "events").select("event_id"), 121, 7, "event_id")


Z = "(SELECT event_id, user_id, event_type, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) AS z FROM events)"
HIST = f"WITH e AS {Z}, h AS (SELECT CAST(floor((z + 12.5) / 0.068359375) AS INT) AS bin, count(*) AS n FROM e WHERE floor((z + 12.5) / 0.068359375) BETWEEN 0 AND 511 GROUP BY 1), dn AS (SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM range(512) t(b) LEFT JOIN h ON h.bin = b)"


def _z(spark, d):
    e = table(spark, d, "events")
    one = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.crossJoin(F.broadcast(one)).select("event_id", "user_id", "event_type", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


@query(HIST + " SELECT bin, n FROM h")
def hist_exact(spark, d):
    return histogram.histogram(_z(spark, d), "z")


@query(f"WITH e AS {Z}, w AS (SELECT count(*) / count(*) FILTER (event_id % 4 = 0) AS w FROM e) SELECT CAST(floor((z + 12.5) / 0.068359375) AS INT) AS bin, round(count(*) * any_value(w), 6) AS n FROM e CROSS JOIN w WHERE event_id % 4 = 0 AND floor((z + 12.5) / 0.068359375) BETWEEN 0 AND 511 GROUP BY 1")
def hist_sampled(spark, d):
    """The sampling operator itself: one of four tasks, weighted."""
    return histogram.sampled(_z(spark, d), "z", "event_id", 4).select("bin", F.round("n", 6).alias("n"))


@query(HIST + " SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS survival FROM dn")
def hist_survival(spark, d):
    return histogram.survival(histogram.histogram(_z(spark, d), "z"))


@query(
    HIST
    + """, s AS (SELECT bin, n, first_value(n) OVER w AS lo, last_value(n) OVER w AS hi, lag(n, 1) OVER o AS a1, lag(n, 2) OVER o AS a2, lead(n, 1) OVER o AS b1, lead(n, 2) OVER o AS b2 FROM dn
  WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o AS (ORDER BY bin))
SELECT bin, n, CAST(round_even(greatest((-3 * coalesce(a2, lo) + 12 * coalesce(a1, lo) + 17 * n + 12 * coalesce(b1, hi) - 3 * coalesce(b2, hi)) / 35.0, 0.0), 0) AS BIGINT) AS smooth FROM s"""
)
def hist_savgol(spark, d):
    return histogram.smoothed(histogram.histogram(_z(spark, d), "z"))


@query()
def greedy_nms(spark, d):
    """Peaks of eight grids of events: place from the event's number, score from its value."""
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("grid"), (F.col("event_id") % 64).alias("x"), F.expr("event_id div 64").alias("y"), F.col("value").alias("score"))
    return peaks.greedy(e, 1.0, 5.0, 1 << 30)


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INT) AS rank FROM lineitem WHERE l_extendedprice >= 1000) WHERE rank <= 50")
def topk_threshold(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return peaks.top(rows, 1000, 50, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")


@query(
    """WITH o AS (SELECT c_nationkey AS k, max_by(c_mktsegment, c_custkey) AS segment, max(c_custkey) AS last FROM customer GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('', '.', '?', 'None') THEN o_orderstatus ELSE segment END AS status, segment, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN o ON c_nationkey = k LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def optics_join_coalesce(spark, d):
    """Orders take the settings of their group (nation), of which the last row wins; a value of their own comes first."""
    c = table(spark, d, "customer")
    group = catalog.last_of(c.select("c_nationkey", "c_custkey", "c_mktsegment"), "c_nationkey", "c_custkey").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    rows = table(spark, d, "orders").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(group, F.col("c_nationkey") == F.col("k"), "left")
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", catalog.first_present(F.col("o_orderstatus"), F.col("segment")).alias("status"), "segment", "n_name")


@query("SELECT o_orderkey, CAST(r AS INT) AS row_index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r BETWEEN 100 AND 900")
def range_slice(spark, d):
    """The operator is a slice by rank: rows 100 to 900, both included."""
    return catalog.ranked_range(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 900).select("o_orderkey", "row_index")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size >= 25) AND p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 26) GROUP BY 1")
def chain_semi_anti(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_size")
    kept = p.join(p.where("p_size >= 25").select("p_brand").distinct(), "p_brand", "left_semi").join(p.groupBy("p_brand").agg(F.avg("p_size").alias("a")).where("a > 26"), "p_brand", "left_anti")
    return kept.groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, round(sum(coalesce(p_size, 0) * l_quantity) / nullif(sum(coalesce(p_size, 0)), 0), 6) AS center FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def mass_center(spark, d):
    m = F.coalesce("p_size", F.lit(0))
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    return rows.groupBy("l_suppkey").agg(F.round(F.try_divide(F.sum(m * F.col("l_quantity")), F.sum(m)), 6).alias("center"))


@query(
    """WITH a AS (SELECT p_partkey % 64 AS x, (p_partkey // 64) % 64 AS y, p_size AS w FROM part),
v AS (SELECT x, y, w, unnest(range(greatest(x - 2, 0), least(x + 2, 63))) AS vx FROM a), u AS (SELECT *, unnest(range(greatest(y - 2, 0), least(y + 2, 63))) AS vy FROM v)
SELECT vx, vy, CAST(sum(w * (3 - abs(vx - x)) * (3 - abs(vy - y))) AS BIGINT) AS density FROM u GROUP BY 1, 2"""
)
def raster_scatter(spark, d):
    """Parts as weighted atoms, rasterised with an integer kernel."""
    a = table(spark, d, "part").select((F.col("p_partkey") % 64).alias("x"), F.expr("(p_partkey div 64) % 64").alias("y"), F.col("p_size").cast("long").alias("w"))
    return arrays.scatter(a, 2, 64)


PX = "WITH f AS (SELECT vec_id, unnest(embedding) AS v0, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), px AS (SELECT vec_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(v0 AS DOUBLE) AS v FROM f)"


def _px(spark, d):
    return arrays.pixels(table(spark, d, "embeddings"), 8)


@query(PX + ", r AS (SELECT v * v AS p, sqrt((y - 4) ** 2 + (x - 4) ** 2) AS r FROM px), s AS (SELECT p, floor(r) AS lo, r - floor(r) AS f FROM r), t AS (SELECT CAST(lo AS BIGINT) AS bin, p, 1 - f AS w FROM s UNION ALL SELECT CAST(lo + 1 AS BIGINT), p, f FROM s) SELECT bin, round(sum(p * w) / sum(w), 8) AS power FROM t GROUP BY bin HAVING sum(w) > 0")
def radial_linear_bin(spark, d):
    return arrays.radial(_px(spark, d), 8).select("bin", F.round("power", 8).alias("power"))


@query(PX + " SELECT CAST(floor(sqrt((y - 4) ** 2 + (x - 4) ** 2) + 0.5) - 1 AS BIGINT) AS bin, round(avg(v * v), 8) AS power FROM px WHERE floor(sqrt((y - 4) ** 2 + (x - 4) ** 2) + 0.5) - 1 BETWEEN 0 AND 3 GROUP BY 1")
def radial_nearest_bin(spark, d):
    return arrays.radial_nearest(_px(spark, d), 8).select("bin", F.round("power", 8).alias("power"))


@query(PX + " SELECT vec_id, round(sum(v * v * CASE WHEN x IN (0, 7) THEN 1 ELSE 2 END), 6) AS energy FROM px GROUP BY 1")
def hermitian_energy(spark, d):
    return arrays.hermitian_energy(_px(spark, d), 8).select("vec_id", F.round("energy", 6).alias("energy"))


@query(PX + " SELECT vec_id, round(avg(v), 8) AS edge_mean, count(*) AS n FROM px WHERE x IN (0, 7) OR y IN (0, 7) GROUP BY 1")
def edge_mean(spark, d):
    return arrays.edge_mean(_px(spark, d), 8).select("vec_id", F.round("edge_mean", 8).alias("edge_mean"), "n")


@query(PX + ", m AS (SELECT vec_id, avg(v) AS m FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 GROUP BY 1) SELECT vec_id, y, x, round(CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN v ELSE m END, 8) AS v FROM px JOIN m USING (vec_id)")
def mean_fill(spark, d):
    return arrays.mean_fill(_px(spark, d), F.expr("x between 2 and 5 and y between 2 and 5")).select("vec_id", "y", "x", F.round("v", 8).alias("v"))


@query(PX + " SELECT vec_id, max(v) AS most, count(*) AS n FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 6 GROUP BY 1")
def roi_box(spark, d):
    return _px(spark, d).where("x between 1 and 6 and y between 2 and 6").groupBy("vec_id").agg(F.max("v").alias("most"), F.count("*").alias("n"))


@query(PX + ", t AS (SELECT CAST(unnest(range(-3, 11)) AS INT) AS k), m AS (SELECT k, CASE WHEN (k + 16) % 16 < 8 THEN (k + 16) % 16 ELSE 15 - (k + 16) % 16 END AS s FROM t) SELECT vec_id, a.k AS y, b.k AS x, v FROM px JOIN m a ON y = a.s JOIN m b ON x = b.s")
def mirror_pad(spark, d):
    return arrays.mirrored(_px(spark, d), 8, 3)


@query("SELECT event_id, round(CASE WHEN abs(value - m) > 2 * s THEN m ELSE value END, 8) AS value FROM events CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def outlier_replace(spark, d):
    return arrays.replace_outliers(table(spark, d, "events").select("event_id", "value"), "value", 2.0).select("event_id", F.round("value", 8).alias("value"))


@query("SELECT round(max(e), 6) AS max_abs, round(avg(e), 6) AS mean_abs, round(sqrt(avg(e * e)), 6) AS rmse, round(sqrt(sum(e * e)) / sqrt(sum(r * r)), 6) AS relative_l2, bool_and(e <= 1e-6 + 1e-5 * abs(r)) AS all_close FROM (SELECT l_extendedprice AS r, abs(l_extendedprice * (1 - l_discount) - l_extendedprice) AS e FROM lineitem)")
def error_metrics(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("r"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("c"))
    m = catalog.error_metrics(rows, "r", "c")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns[:4]], "all_close")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing_reference' WHEN l.doc_id IS NULL THEN 'missing_candidate' ELSE 'compared' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def file_diff_full_outer(spark, d):
    return catalog.compared(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'ok' ELSE 'failed' END AS status FROM documents")
def missing_anti_union(spark, d):
    return catalog.with_missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_tasks(spark, d):
    return catalog.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT c_nationkey AS k, 'only_customers' AS side FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'both' FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def key_except_intersect(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).withColumn("side", F.lit("only_customers")).union(c.intersect(s).withColumn("side", F.lit("both")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def percentile_report(spark, d):
    p = catalog.percentiles(table(spark, d, "events"), "value", "event_type")
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "mean")], "least", "most", "n")


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS groups FROM orders GROUP BY 1")
def manifest_rollup(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("groups"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, trim(substr(line, 31, 8)) AS x, trim(substr(line, 39, 8)) AS y, trim(substr(line, 47, 8)) AS z, trim(substr(line, 77, 2)) AS stated FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS line, substr(line, 1, 6) AS record, substr(line, 22, 1) AS chain, CASE WHEN stated <> '' THEN stated ELSE regexp_extract(substr(line, 13, 4), '[A-Za-z]', 0) END AS element,
  CASE WHEN regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(x AS DOUBLE) END AS x,
  CASE WHEN regexp_matches(y, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(y AS DOUBLE) END AS y,
  CASE WHEN regexp_matches(z, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(z AS DOUBLE) END AS z FROM f""")
def fixed_width_lines(spark, d):
    """Every line of every document as a record of fixed columns."""
    return catalog.fixed_lines(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query(f"WITH e AS {Z} SELECT user_id % 8 AS grid, count(*) AS observed, count(*) FILTER (z > 1) AS above, round(count(*) FILTER (z > 1) / (count(*) * 0.15865525393145707), 6) AS ratio, CAST(round_even(sqrt(count(*)), 0) AS BIGINT) * CAST(round_even(sqrt(count(*)), 0) AS BIGINT) AS nearest_square FROM e GROUP BY 1")
def trial_diagnosis(spark, d):
    """Counts above one deviation against those a normal distribution expects, by grid."""
    n = F.count("*")
    root = F.rint(F.sqrt(n.cast("double"))).cast("long")
    return _z(spark, d).groupBy((F.col("user_id") % 8).alias("grid")).agg(n.alias("observed"), F.count_if(F.col("z") > 1).alias("above"), F.round(F.count_if(F.col("z") > 1) / (n * 0.15865525393145707), 6).alias("ratio"), (root * root).alias("nearest_square"))
