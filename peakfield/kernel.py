"""Queries of the search kernel, result maps and run tables over the driver's tables, each with the same query in SQL.

Embeddings serve as images of 8 x 8, and the mean images of their labels as templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import arrays, maps, runs, search, spectral
from .sources import tables

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
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


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clean(c, digits: int = 6):
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def long_form(made: DataFrame, columns: dict[str, str], width: int, key: str = "vec_id") -> DataFrame:
    """One row for each place of the arrays of a row; width: places in a line."""
    names = list(columns)
    zipped = F.posexplode(F.arrays_zip(*[F.col(n) for n in names]))
    rows = made.select(key, zipped.alias("at", "e"))
    return rows.select(key, F.expr(f"cast(at div {width} as int)").alias("fy"), (F.col("at") % width).cast("int").alias("fx"), *[clean(F.col(f"e.{n}"), int(d)).alias(n) for n, d in columns.items()])


def px(spark, d: str) -> DataFrame:
    return arrays.pixels(table(spark, d, "embeddings"), 8)


PX = """WITH px AS (SELECT vec_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
freq AS (SELECT a.f AS fy, b.f AS fx, CASE WHEN a.f < 4 THEN a.f ELSE a.f - 8 END AS sy FROM (SELECT unnest(range(0, 8)) AS f) a, (SELECT unnest(range(0, 5)) AS f) b)
"""
DFT = """, dft AS (SELECT vec_id, fy, fx, sy, sum(v * cos(2 * pi() * (fy * y + fx * x) / 8)) / 64 AS re, -sum(v * sin(2 * pi() * (fy * y + fx * x) / 8)) / 64 AS im FROM {0} CROSS JOIN freq GROUP BY ALL)
"""
#: Points of the radial curve of an image of 8 x 8, and each frequency's share in the two beside it.
CURVE = """, spot AS (SELECT fy, fx, least(sqrt((sy / 8.0) ** 2 + (fx / 8.0) ** 2) / (0.5 * sqrt(2.0) / 7), 7.0) AS p, fx = 0 AND fy >= 5 AS mate FROM freq),
share AS (SELECT fy, fx, mate, CAST(floor(p) AS INT) AS bin, 1 - (p - floor(p)) AS w FROM spot UNION ALL SELECT fy, fx, mate, CAST(floor(p) AS INT) + 1, p - floor(p) FROM spot WHERE floor(p) < 7),
bins AS (SELECT unnest(range(0, 8)) AS bin),
power AS (SELECT vec_id, bin, sum((re * re + im * im) * w) / greatest(sum(w), 1e-12) AS power FROM {0} JOIN share USING (fy, fx) WHERE NOT mate GROUP BY vec_id, bin HAVING sum(w) > 0)
"""


@query(PX + DFT.format("px") + "SELECT vec_id, CAST(fy AS INT) AS fy, CAST(fx AS INT) AS fx, round(re, 8) + 0.0 AS re, round(im, 8) + 0.0 AS im FROM dft")
def rfft_forward(spark, d):
    made = spectral.by_image(table(spark, d, "embeddings"), 8, lambda v: spectral.parts(spectral.forward(v)))
    return long_form(made, {"re": 8, "im": 8}, 5)


@query(PX + DFT.format("px") + CURVE.format("dft") + "SELECT vec_id, CAST(bin AS INT) AS bin, round(coalesce(power, 0), 9) + 0.0 AS power FROM (SELECT DISTINCT vec_id FROM px) CROSS JOIN bins LEFT JOIN power USING (vec_id, bin)")
def radial_power(spark, d):
    """Power by radius, explicit Hermitian mates left out and the outermost radii clamped."""
    made = spectral.by_image(table(spark, d, "embeddings"), 8, lambda v: {"power": spectral.radial_power(spectral.forward(v))})
    rows = made.select("vec_id", F.posexplode("power").alias("bin", "p"))
    return rows.select("vec_id", F.col("bin").cast("int").alias("bin"), clean("p", 9).alias("power"))


FIRST = """, one AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM px GROUP BY vec_id),
cleaned AS (SELECT vec_id, y, x, CASE WHEN abs(v - m) > 5 * s THEN m ELSE v END AS v FROM px JOIN one USING (vec_id))"""
WHITE = """, dc AS (SELECT vec_id, fy, fx, CASE WHEN fy = 0 AND fx = 0 THEN 0.0 ELSE re END AS re, CASE WHEN fy = 0 AND fx = 0 THEN 0.0 ELSE im END AS im FROM dft)
"""
WHITER = """, w0 AS (SELECT vec_id, bin, CASE WHEN power > 0 THEN 1 / sqrt(power) ELSE 0 END AS w FROM power),
w1 AS (SELECT vec_id, bin, w / greatest(max(w) OVER (PARTITION BY vec_id), 1e-12) AS w FROM w0),
wf AS (SELECT vec_id, fy, fx, sum(w1.w * share.w) AS w FROM share JOIN w1 USING (bin) GROUP BY ALL),
sp AS (SELECT vec_id, fy, fx, re * w AS re, im * w AS im, CASE WHEN fx IN (0, 4) THEN 1.0 ELSE 2.0 END AS h FROM dc JOIN wf USING (vec_id, fy, fx)),
en AS (SELECT vec_id, sqrt(greatest(sum((re * re + im * im) * h), 1e-12)) AS e FROM sp GROUP BY vec_id),
grid AS (SELECT a.i AS gy, b.i AS gx FROM (SELECT unnest(range(0, 8)) AS i) a, (SELECT unnest(range(0, 8)) AS i) b)
SELECT vec_id, CAST(gy AS INT) AS fy, CAST(gx AS INT) AS fx, round(sum(h * (re * cos(2 * pi() * (fy * gy + fx * gx) / 8) - im * sin(2 * pi() * (fy * gy + fx * gx) / 8))) / any_value(e), 6) + 0.0 AS v
FROM sp JOIN en USING (vec_id) CROSS JOIN grid GROUP BY vec_id, gy, gx"""


@query(PX + FIRST + DFT.format("cleaned") + WHITE + CURVE.format("dc") + WHITER)
def first_pass(spark, d):
    """Outliers, whitening by the image's own radial curve, unit energy."""
    return long_form(spectral.by_image(table(spark, d, "embeddings"), 8, lambda v: {"v": spectral.first_pass(v)}), {"v": 6}, 8)


@query(
    PX + DFT.format("px") + """, dc AS (SELECT vec_id, fy, fx, CASE WHEN fy = 0 AND fx = 0 THEN 0.0 ELSE re * (1 - 2 * ((fy + fx) % 2)) END AS re, CASE WHEN fy = 0 AND fx = 0 THEN 0.0 ELSE im * (1 - 2 * ((fy + fx) % 2)) END AS im FROM dft),
en AS (SELECT vec_id, sqrt(greatest(sum((re * re + im * im) * CASE WHEN fx IN (0, 4) THEN 1.0 ELSE 2.0 END), 1e-12) / 36) AS e FROM dc GROUP BY vec_id)
SELECT vec_id, CAST(fy AS INT) AS fy, CAST(fx AS INT) AS fx, round(re / e, 6) + 0.0 AS re, round(im / e, 6) + 0.0 AS im FROM dc JOIN en USING (vec_id)"""
)
def second_pass(spark, d):
    """The spectrum about the middle, normalised to a footprint of 36 pixels."""
    return long_form(spectral.by_image(table(spark, d, "embeddings"), 8, lambda v: spectral.parts(spectral.second_pass(v, 36))), {"re": 6, "im": 6}, 5)


@query(
    PX + """, full8 AS (SELECT vec_id, a.f AS fy, b.f AS fx, sum(v * cos(2 * pi() * (a.f * y + b.f * x) / 8)) / 64 AS re, -sum(v * sin(2 * pi() * (a.f * y + b.f * x) / 8)) / 64 AS im
  FROM px, (SELECT unnest(range(-4, 4)) AS f) a, (SELECT unnest(range(-4, 4)) AS f) b GROUP BY ALL),
grid AS (SELECT a.i AS gy, b.i AS gx FROM (SELECT unnest(range(0, 12)) AS i) a, (SELECT unnest(range(0, 12)) AS i) b)
SELECT vec_id, CAST(gy AS INT) AS fy, CAST(gx AS INT) AS fx, round(sum(re * cos(2 * pi() * (fy * gy + fx * gx) / 12) - im * sin(2 * pi() * (fy * gy + fx * gx) / 12)), 6) + 0.0 AS v FROM full8 CROSS JOIN grid GROUP BY vec_id, gy, gx"""
)
def fourier_resize(spark, d):
    """Images of 8 x 8 in Fourier space to 12 x 12."""
    return long_form(spectral.by_image(table(spark, d, "embeddings"), 8, lambda v: {"v": spectral.resized(v, 12)}), {"v": 6}, 12)


@query(
    PX + """, tp AS (SELECT CAST(label AS BIGINT) AS task, y, x, avg(v) AS t FROM px JOIN embeddings USING (vec_id) GROUP BY label, y, x),
ccf AS (SELECT vec_id, task, (px.y - tp.y + 8) % 8 AS y, (px.x - tp.x + 8) % 8 AS x, round(sum(v * t) / 64, 9) AS score FROM px CROSS JOIN tp GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id, y, x ORDER BY score DESC, task) AS r FROM ccf),
mom AS (SELECT vec_id, y, x, sum(score) AS s1, sum(score * score) AS s2, count(*) AS n FROM ccf GROUP BY ALL)
SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN score > 0 THEN round(score, 9) ELSE 0.0 END AS mip, CASE WHEN score > 0 THEN task END AS task, round(s1, 9) + 0.0 AS s1, round(s2, 9) + 0.0 AS s2, n FROM best JOIN mom USING (vec_id, y, x) WHERE r = 1"""
)
def ccf_search(spark, d):
    """The search itself: every image against every template at every shift, by products of spectra."""
    images = table(spark, d, "embeddings")
    found = spectral.correlated(images, search.templates(images), 8)
    return found.select("vec_id", "y", "x", clean("mip", 9).alias("mip"), "task", clean("s1", 9).alias("s1"), clean("s2", 9).alias("s2"), "n")


COSINE = "CASE WHEN abs({0} - 32) <= {1} THEN 1.0 WHEN abs({0} - 32) < {1} + 7 THEN (1 + cos((abs({0} - 32) - {1}) * pi() / 7)) * 0.5 ELSE 0.0 END"


@query(f"SELECT event_id, {COSINE.format('(event_id // 64) % 64', 16.5)} * {COSINE.format('event_id % 64', 8.5)} >= 0.9 AS inside FROM events")
def cosine_mask(spark, d):
    """Events as pixels of maps of 64 x 64, inside a soft rectangle or not."""
    y, x = F.expr("event_id div 64 % 64"), F.col("event_id") % 64
    return table(spark, d, "events").select("event_id", maps.cosine_mask(y, x, (32, 32), (20, 12)).alias("inside"))


OFFSETS = "(VALUES " + ", ".join(str(o) for o in maps.nearest_offsets(2)) + ") AS o(d, i, dy, dx)"


@query(
    PX + f""", known AS (SELECT vec_id, y, x, v FROM px WHERE (y * 8 + x + vec_id) % 5 = 0),
near AS (SELECT vec_id, k.y - dy AS y, k.x - dx AS x, arg_min(v, d * 100 + i) AS v FROM known k, {OFFSETS} GROUP BY ALL)
SELECT vec_id, CAST(px.y AS INT) AS y, CAST(px.x AS INT) AS x, round(coalesce(known.v, near.v), 6) AS v FROM px LEFT JOIN known USING (vec_id, y, x) LEFT JOIN near USING (vec_id, y, x)"""
)
def nearest_fill(spark, d):
    """Images of which every fifth pixel is known, filled from the nearest."""
    sparse = px(spark, d).withColumn("v", F.when((F.col("y") * 8 + F.col("x") + F.col("vec_id")) % 5 == 0, F.col("v")))
    return maps.nearest_fill(sparse, 2).select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(PX + "SELECT vec_id, CAST(trunc((y - 4) * 2.5) AS INT) + 10 AS y, CAST(trunc((x - 4) * 2.5) AS INT) + 10 AS x, round(v, 6) AS v FROM px")
def label_scatter(spark, d):
    """Pixels of binned maps at their places in grids of 20 x 20."""
    return maps.scattered(px(spark, d), 2.5, 4, 10, 20).select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(PX + "SELECT vec_id, round(sum(v) FILTER (y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5), 6) AS s1, round(sum(v * v) FILTER (y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5), 6) AS s2, count(*) FILTER (y BETWEEN 2 AND 4 AND x BETWEEN 0 AND 7) AS counted, count(*) FILTER (y BETWEEN 2 AND 4 AND v > 0) AS above FROM px GROUP BY vec_id")
def two_masks(spark, d):
    found = maps.two_masks(px(spark, d), F.col("y").between(1, 6) & F.col("x").between(2, 5), F.col("y").between(2, 4) & F.col("x").between(0, 7))
    return found.select("vec_id", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "counted", "above")


@query(
    PX + """, one AS (SELECT vec_id, avg(v) FILTER ((y - 3.5) ** 2 + (x - 3.5) ** 2 <= 12.96) AS circle, avg(v) FILTER (y IN (0, 7) OR x IN (0, 7)) AS edge, avg(v) AS mean, avg(v * v) AS sq, sum(abs(v)) AS l1 FROM px GROUP BY vec_id)
SELECT vec_id, round(circle, 6) + 0.0 AS circle_mean, round(greatest((sq - 2 * edge * mean + edge * edge) * 0.25 - ((mean - edge) * 0.25) ** 2, 1e-12), 8) AS variance, greatest(-60.0, least(0.0, floor(log2(2.5 / greatest(l1, 1e-12))))) AS exponent FROM one"""
)
def projection_statistics(spark, d):
    found = maps.projection_statistics(px(spark, d), 8, 16, 3.6, 2.5)
    return found.select("vec_id", clean("circle_mean").alias("circle_mean"), F.round("variance", 8).alias("variance"), (F.col("exponent") + 0.0).alias("exponent"))


@query("SELECT count(*) FILTER (isfinite(value)) = count(*) AND sum(abs(value)) > 0 AS healthy, count(*) FILTER (isfinite(value)) AS finite_count, count(*) AS total_count, round(sum(abs(value)), 4) AS absolute_sum, max(abs(value)) AS maximum_absolute, count(*) - count(*) FILTER (isfinite(value)) AS nonfinite_count FROM events")
def health(spark, d):
    return maps.health(table(spark, d, "events"), "value").withColumn("absolute_sum", F.round("absolute_sum", 4))


@query(
    """SELECT p_partkey, CASE WHEN p_size >= 8.5 AND p_size < 30.25 THEN 1.0 WHEN p_size >= 30.25 AND p_size < 35.25 THEN round(0.5 * cos((p_size - 30.25) * pi() / 10) + 0.5, 9) WHEN p_size >= 3.5 AND p_size < 8.5 THEN round(0.5 * cos((8.5 - p_size) * pi() / 10) + 0.5, 9) ELSE 0.0 END AS image,
CASE WHEN p_size < 30.25 THEN 1.0 WHEN p_size < 35.25 THEN round(0.5 * cos((p_size - 30.25) * pi() / 10) + 0.5, 9) ELSE 0.0 END AS template FROM part"""
)
def cosine_bandpass(spark, d):
    """Parts as frequencies: the ring is the size."""
    ring = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(maps.bandpass(ring, 8.5, 30.25, 5.0), 9).alias("image"), F.round(maps.template_bandpass(ring, 30.25, 5.0), 9).alias("template"))


@query(
    """WITH f AS (SELECT p_partkey, sin(p_retailprice) AS c, p_size / 100.0 AS s FROM part), r AS (SELECT *, exp(greatest(-80.0, least(80.0, 4.5 * s * s - 2.5 * s + 0.75))) AS r FROM f)
SELECT p_partkey, round(sqrt((c * c + r) / greatest(4.0 * r + 3.0 * c * c, 1e-12)) * CASE WHEN s > 1 / 6.0::DOUBLE THEN exp(-100.0 * s * s) ELSE 1.0 END, 8) AS image, round(c / sqrt(greatest(4.0 * r + 3.0 * c * c, 1e-12)), 8) + 0.0 AS projection FROM r"""
)
def frequency_weights(spark, d):
    image, projection = maps.frequency_weights(F.sin("p_retailprice"), F.col("p_size") / F.lit(100.0), (4.5, -2.5, 0.75), 3.0)
    return table(spark, d, "part").select("p_partkey", F.round(image, 8).alias("image"), clean(projection, 8).alias("projection"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM supplier) SELECT s_suppkey, r_regionkey, n_nationkey, CAST((n_nationkey * 5 + r_regionkey) * n + s_suppkey AS BIGINT) AS task FROM supplier, region, nation, n"""
)
def task_table(spark, d):
    """Suppliers as orientations, regions as defoci, nations as pixel sizes."""
    o = table(spark, d, "supplier")
    p, f = table(spark, d, "nation").select(F.col("n_nationkey").alias("p")), table(spark, d, "region").select(F.col("r_regionkey").alias("d"))
    made = runs.tasks(p, f, o.select(F.col("s_suppkey").alias("o")), 5, o.count())
    return made.select(F.col("o").alias("s_suppkey"), F.col("d").alias("r_regionkey"), F.col("p").alias("n_nationkey"), F.col("task").cast("long").alias("task"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 11 AND 120")
def orientation_slice(spark, d):
    """The range operator itself: an inclusive slice."""
    return runs.sliced(table(spark, d, "customer"), "c_custkey", 11, 120).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def listed_tasks(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return runs.picked(table(spark, d, "customer"), "c_custkey", wanted).select("c_custkey", "c_name")


@query(
    """WITH j AS (SELECT o_orderkey, o_orderpriority, o_custkey % 40 AS chain, CASE WHEN o_custkey % 40 < 20 THEN 'out' || CAST(o_custkey % 30 AS VARCHAR) || o_orderpriority END AS path FROM orders),
bad AS (SELECT path FROM j WHERE path IS NOT NULL GROUP BY path HAVING count(DISTINCT chain) > 1)
SELECT o_orderpriority, chain, min(o_orderkey) AS first_job, count(*) AS jobs, coalesce(bool_or(path IN (SELECT path FROM bad)), false) AS conflict FROM j GROUP BY ALL"""
)
def template_cache(spark, d):
    """Orders as jobs whose template hangs on their priority and customer group; some name the file they want."""
    chain = (F.col("o_custkey") % 40).alias("chain")
    path = F.when(F.col("o_custkey") % 40 < 20, F.concat(F.lit("out"), (F.col("o_custkey") % 30).cast("string"), "o_orderpriority")).alias("path")
    return runs.templates(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", chain, path), ["o_orderpriority", "chain"], "o_orderkey", "path")


@query("SELECT o_orderkey, o_custkey % 3 AS shard, row_number() OVER (ORDER BY o_orderkey) - 1 AS stack_index FROM orders")
def stack_merge(spark, d):
    """Orders as records of three shards."""
    records = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("shard"))
    return runs.merged_stack(records, "o_orderkey").select("o_orderkey", "shard", F.col("stack_index").cast("long").alias("stack_index"))


@query("WITH n AS (SELECT greatest(7, CAST(ceil((count(*) - 5) / 200.0) AS BIGINT)) AS k FROM events) SELECT event_id, value FROM events, n WHERE event_id >= 5 AND (event_id - 5) % k = 0")
def sampled_batches(spark, d):
    """The sampling operator itself: batches after the warm-up that are timed."""
    e = table(spark, d, "events")
    return runs.sampled(e, "event_id", e.count(), 5, 7, 200).select("event_id", "value")


@query("SELECT event_id, round((value - lag(value) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 6) + 0.0 AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def recent_rate(spark, d):
    rows = runs.recent_rate(table(spark, d, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), F.col("value"), "event_id")
    return rows.select("event_id", clean("rate").alias("rate"))


@query("SELECT p_type, round(sum(p_retailprice), 2) AS total, count(*) AS calls FROM part GROUP BY p_type ORDER BY sum(p_retailprice) DESC, p_type LIMIT 20")
def longest_sections(spark, d):
    """The top-k report itself."""
    return runs.longest(table(spark, d, "part"), "p_type", "p_retailprice", 20).withColumn("total", F.round("total", 2))


MANIFEST = "SELECT o_orderkey AS \"index\", CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS threshold, CASE WHEN o_orderstatus = 'P' THEN 'tab\t and \"quote\"' END AS error FROM orders"


@query(MANIFEST)
def manifest_tsv(spark, d):
    """Orders as rows of a batch manifest, written as text and read back."""
    failed = F.col("o_orderstatus") == "P"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.when(failed, "failed").otherwise("ok").alias("status"), F.when(~failed, F.col("o_totalprice")).alias("threshold"), F.when(failed, 'tab\t and "quote"').alias("error"))
    return tables.read_tsv(spark, tables.write_tsv(rows, "manifest", "index"), rows.schema)


@query("SELECT event_type, CAST(floor((value + 12.5) / 0.068359375) AS INT) AS bin, count(*) AS n FROM events WHERE value >= -12.5 AND value < 22.5 GROUP BY ALL")
def histogram_tsv(spark, d):
    """Histograms of each type's values, written as text and read back."""
    e = table(spark, d, "events").where("value >= -12.5 and value < 22.5")
    rows = e.groupBy("event_type", F.floor((F.col("value") + 12.5) / 0.068359375).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return tables.read_tsv(spark, tables.write_tsv(rows, "histogram", "event_type", "bin"), rows.schema)


@query("SELECT event_type, count(*) AS lines, min(value) AS first_snr, arg_min(event_id, value) AS first_id FROM events GROUP BY event_type")
def histogram_summaries(spark, d):
    """Files of white-space columns, one for each type of event: the first line that isn't a comment tells."""
    e = table(spark, d, "events").select("event_type", "value", "event_id")
    return tables.summaries(tables.write_columns(e, "event_type", "value"), e.sparkSession)


@query("SELECT label AS name, sha256(string_agg(x, '' ORDER BY vec_id)) AS sha FROM (SELECT label, vec_id, CAST(vec_id AS VARCHAR) || chr(10) AS x FROM embeddings) GROUP BY label")
def file_digests(spark, d):
    """Digests of files, one for each label."""
    e = table(spark, d, "embeddings").select("label", "vec_id")
    return tables.digests(spark, tables.write_lines(e, "label", "vec_id")).select(F.col("name").cast("int").alias("name"), "sha")
