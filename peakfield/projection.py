"""Queries of volumes and their projections, of padding, of runs' configurations and of files of arrays, each with the same query in SQL.

Embeddings serve as volumes of 4 x 4 x 4, and the means of their labels as templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import normal, optics
from .kernel import CURVE, DFT, PX, WHITE, clean, long_form
from .operators import arrays, configs, filters, search, spectral, volumes
from .sources import mrc, npy
from .sources.files import shared_folder

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


def views(spark) -> DataFrame:
    """Six views that fall between the samples of a spectrum."""
    n = spark.range(6).select(F.col("id").cast("int").alias("view"))
    return n.select("view", (11.0 + 53 * F.col("view")).alias("phi"), (17.0 + 23 * F.col("view")).alias("theta"), (7.0 + 41 * F.col("view")).alias("psi"))


#: Label means as cubes about their middle, their spectra by direct sums, and planes through the origin between eight samples each.
SLICES = """WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
cube AS (SELECT CAST(label AS BIGINT) AS task, pos, avg(CAST(v AS DOUBLE)) AS v FROM e GROUP BY label, pos),
f AS (SELECT unnest(range(-2, 2)) AS f),
full3 AS (SELECT task, a.f AS fz, b.f AS fy, c.f AS fx, sum(v * cos(pi() / 2 * (a.f * (pos // 16 - 2) + b.f * (pos // 4 % 4 - 2) + c.f * (pos % 4 - 2)))) / 64 AS re,
  -sum(v * sin(pi() / 2 * (a.f * (pos // 16 - 2) + b.f * (pos // 4 % 4 - 2) + c.f * (pos % 4 - 2)))) / 64 AS im FROM cube, f a, f b, f c GROUP BY ALL),
w AS (SELECT CAST(i AS INT) AS view, radians(11.0 + 53 * i) AS p, radians(17.0 + 23 * i) AS t, radians(7.0 + 41 * i) AS s FROM (SELECT unnest(range(0, 6)) AS i)),
plane AS (SELECT view, gy, gx, CASE WHEN gy < 2 THEN gy ELSE gy - 4 END AS sy, p, t, s FROM w, (SELECT unnest(range(0, 4)) AS gy), (SELECT unnest(range(0, 3)) AS gx)),
spot AS (SELECT view, gy, gx, (cos(p) * cos(t) * cos(s) - sin(p) * sin(s)) * gx - (cos(p) * cos(t) * sin(s) + sin(p) * cos(s)) * sy AS x,
  (sin(p) * cos(t) * cos(s) + cos(p) * sin(s)) * gx - (sin(p) * cos(t) * sin(s) - cos(p) * cos(s)) * sy AS y, -sin(t) * cos(s) * gx + sin(t) * sin(s) * sy AS z FROM plane),
corner AS (SELECT view, gy, gx, CAST(floor(x) AS INT) + dx AS i, CAST(floor(y) AS INT) + dy AS j, CAST(floor(z) AS INT) + dz AS k,
  (1 - abs(x - floor(x) - dx)) * (1 - abs(y - floor(y) - dy)) * (1 - abs(z - floor(z) - dz)) AS w FROM spot, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz)
  WHERE (CASE WHEN x < 0 THEN floor(x) >= -2 ELSE floor(x) + 1 <= 2 END) AND floor(y) BETWEEN -2 AND 0 AND floor(z) BETWEEN -2 AND 0 AND (gy <> 0 OR gx <> 0)),
raw AS (SELECT task, view, gy, gx, sum(re * w) AS re, sum(im * w) AS im FROM corner JOIN full3 ON (i + 6) % 4 - 2 = fx AND (j + 6) % 4 - 2 = fy AND (k + 6) % 4 - 2 = fz GROUP BY ALL),
every AS (SELECT DISTINCT task, view, gy, gx FROM cube, plane),
filled AS (SELECT task, view, gy, gx, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM every LEFT JOIN raw USING (task, view, gy, gx)),
sl AS (SELECT a.task, a.view, a.gy, a.gx, CASE WHEN a.gx = 0 AND a.gy = 3 THEN b.re ELSE a.re END AS re, CASE WHEN a.gx = 0 AND a.gy = 3 THEN -b.im ELSE a.im END AS im
  FROM filled a LEFT JOIN filled b ON a.task = b.task AND a.view = b.view AND b.gx = 0 AND b.gy = 1)
"""
PROJECTED = """, pr0 AS (SELECT task, view, qy AS y, qx AS x, sum(CASE WHEN gx IN (0, 2) THEN 1 ELSE 2 END * (re * cos(pi() / 2 * (gy * (qy - 2) + gx * (qx - 2))) - im * sin(pi() / 2 * (gy * (qy - 2) + gx * (qx - 2))))) AS v
  FROM sl, (SELECT unnest(range(0, 4)) AS qy), (SELECT unnest(range(0, 4)) AS qx) GROUP BY ALL),
pr1 AS (SELECT *, v - avg(v) FILTER (y IN (0, 3) OR x IN (0, 3)) OVER (PARTITION BY task, view) AS u FROM pr0),
pr AS (SELECT task, view, y, x, u / sqrt(greatest(avg(u * u) OVER p * 0.25 - (avg(u) OVER p * 0.25) ** 2, 1e-12)) AS v FROM pr1 WINDOW p AS (PARTITION BY task, view))
"""


@query(SLICES + "SELECT task, view, CAST(gy AS INT) AS fy, CAST(gx AS INT) AS fx, round(re, 7) + 0.0 AS re, round(im, 7) + 0.0 AS im FROM sl")
def central_slices(spark, d):
    """Planes through the spectra of label means."""
    made = volumes.slices(search.templates(table(spark, d, "embeddings")), views(spark), 4)
    return long_form(made.withColumn("key", F.struct("task", "view")), {"re": 7, "im": 7}, 3, "key").select("key.*", "fy", "fx", "re", "im")


@query(SLICES + PROJECTED + "SELECT task, view, CAST(y AS INT) AS fy, CAST(x AS INT) AS fx, round(v, 5) + 0.0 AS v FROM pr")
def projections(spark, d):
    """Projections of label means, normalised for a box of 8 x 8."""
    made = volumes.projections(search.templates(table(spark, d, "embeddings")), views(spark), 4, 8)
    return long_form(made.withColumn("key", F.struct("task", "view")), {"v": 5}, 4, "key").select("key.*", "fy", "fx", "v")


@query(
    SLICES + PROJECTED + """, px AS (SELECT vec_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id IS NOT NULL)),
ccf AS (SELECT vec_id, (px.y - pr.y + 2 + 8) % 8 AS y, (px.x - pr.x + 2 + 8) % 8 AS x, task * 6 + view AS task, round(sum(px.v * pr.v) / 64, 6) AS score FROM px, pr GROUP BY ALL)
SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(greatest(max(score), 0), 6) + 0.0 AS mip, round(sum(score), 6) + 0.0 AS s1, count(*) AS n FROM ccf GROUP BY vec_id, y, x"""
)
def projection_search(spark, d):
    """The whole search: label means cut and projected in every view, and every image correlated with all projections."""
    images = table(spark, d, "embeddings")
    made = volumes.projections(search.templates(images), views(spark), 4, 8)
    tasks = made.select((F.col("task") * 6 + F.col("view")).alias("task"), volumes.embedded(F.col("v"), 4, 8).alias("template"))
    found = spectral.correlated(images, tasks, 8, digits=6)
    return found.select("vec_id", "y", "x", clean("mip", 6).alias("mip"), clean("s1", 6).alias("s1"), "n")


#: A condition for each label: the whitening curve of its mean image, and a defocus; filters of 8 x 8 sampled for slices of 4 x 4 at half as many places.
FILTERS = """, px AS (SELECT task AS vec_id, pos // 8 AS y, pos % 8 AS x, v FROM cube), freq AS (SELECT a.f AS fy, b.f AS fx, CASE WHEN a.f < 4 THEN a.f ELSE a.f - 8 END AS sy FROM (SELECT unnest(range(0, 8)) AS f) a, (SELECT unnest(range(0, 5)) AS f) b)
""" + DFT.format("px") + WHITE + CURVE.format("dc").replace("spot", "ring") + """, w0 AS (SELECT vec_id, bin, CASE WHEN power > 0 THEN 1 / sqrt(power) ELSE 0 END AS w FROM power),
w1 AS (SELECT vec_id, bin, w / greatest(max(w) OVER (PARTITION BY vec_id), 1e-12) AS w FROM w0),
wf AS (SELECT vec_id, fy, fx, sum(w1.w * share.w) AS w FROM share JOIN w1 USING (bin) GROUP BY ALL),
opt AS (SELECT 12.2639 / sqrt(300000.0 * (1 + 300000.0 * 0.97845e-6)) / 1.5 AS wave, 2.7 * 1e7 / 1.5 AS cs, atan(0.07 / sqrt(1 - 0.07 * 0.07)) AS amp),
phase AS (SELECT vec_id, fy, fx, sy, wave * pi() * ((fx / 8.0) ** 2 + (sy / 8.0) ** 2) * ((8000.0 + 900 * vec_id + 7000.0 + 900 * vec_id + cos((atan2(sy / 8.0, fx / 8.0) - radians(25)) * 2) * 1000.0) / 2 / 1.5 - wave * wave * ((fx / 8.0) ** 2 + (sy / 8.0) ** 2) * cs / 2) + amp AS p FROM (SELECT DISTINCT vec_id FROM px), freq, opt),
filt AS (SELECT vec_id AS condition, p.sy, fx, CASE WHEN sy = 0 AND fx = 0 THEN 0 ELSE -sin(p.p) * w * exp(-2.0 * ((fx / 8.0) ** 2 + (sy / 8.0) ** 2)) END AS v FROM phase p JOIN wf USING (vec_id, fy, fx)),
take AS (SELECT gy, gx, gx * 1.5 AS u, CASE WHEN gy < 2 THEN gy ELSE gy - 4 END * 1.5 AS q FROM (SELECT unnest(range(0, 4)) AS gy), (SELECT unnest(range(0, 3)) AS gx)),
smp AS (SELECT condition, gy, gx, sum(CASE WHEN floor(u) + 1 <= 4 AND floor(q) >= -4 AND floor(q) + 1 <= 3 AND (gy <> 0 OR gx <> 0) THEN v * (1 - abs(u - fx)) * (1 - abs(q - sy)) ELSE 0 END) AS w FROM take, filt WHERE fx BETWEEN floor(u) AND floor(u) + 1 AND sy BETWEEN floor(q) AND floor(q) + 1 GROUP BY ALL),
thru AS (SELECT task * 100 + condition AS task, view, gy, gx, re * w AS re, im * w AS im FROM sl JOIN smp USING (gy, gx))
"""


#: Slices over the root of their own mean power in rings.
WHITENED = """, rung AS (SELECT *, CAST(floor(sqrt(least(gy, 4 - gy) ** 2 + gx ** 2) + 0.5) AS INT) - 1 AS r FROM sl),
wh AS (SELECT task, view, gy, gx, CASE WHEN r BETWEEN 0 AND 1 THEN re / sqrt(greatest(p, 1e-12)) ELSE 0 END AS re, CASE WHEN r BETWEEN 0 AND 1 THEN im / sqrt(greatest(p, 1e-12)) ELSE 0 END AS im
  FROM (SELECT *, avg(re * re + im * im) OVER (PARTITION BY task, view, r) AS p FROM rung))
"""
CONDITIONS = "SELECT task // 100 AS task, CAST(task % 100 AS INT) AS condition, view, CAST(y AS INT) AS fy, CAST(x AS INT) AS fx, round(v, 4) + 0.0 AS v FROM pr"


def _conditions(means: DataFrame) -> DataFrame:
    """A filter for each label: contrast transfer, whitening by its mean image, and a fall-off given by the user."""
    curves = spectral.by_image(means, 8, lambda v: {"curve": spectral.whitening(spectral.without_origin(spectral.forward(v)))}, "task", "template")
    n = lambda x: F.lit(float(x))
    defocus = 8000.0 + 900 * F.col("task")
    transfer = lambda fx, fy: optics.transfer(fx, fy, n(1.5), n(300), n(2.7), n(0.07), defocus, defocus - 1000, n(25), n(0))
    own = filters.condition_filter(8, transfer, F.col("curve"), [lambda fx, fy: F.exp((fx * fx + fy * fy) * -2.0)])
    return curves.select(F.col("task").cast("int").alias("condition"), filters.sampled(own, 8, 4, 1.5).alias("filter"))


@query(SLICES + FILTERS + PROJECTED.replace("FROM sl,", "FROM thru,") + CONDITIONS)
def filtered_projections(spark, d):
    """Label means projected in every view through the filter of every label."""
    means = search.templates(table(spark, d, "embeddings"))
    made = volumes.filtered_projections(means, views(spark), _conditions(means), 4, 8)
    return long_form(made.withColumn("key", F.struct("task", "condition", "view")), {"v": 4}, 4, "key").select("key.*", "fy", "fx", "v")


@query(SLICES + WHITENED + FILTERS.replace("FROM sl JOIN smp", "FROM wh JOIN smp") + PROJECTED.replace("FROM sl,", "FROM thru,") + CONDITIONS)
def whitened_projections(spark, d):
    """The same, each slice first whitened by its own curve."""
    means = search.templates(table(spark, d, "embeddings"))
    made = volumes.filtered_projections(means, views(spark), _conditions(means), 4, 8, whiten=True)
    return long_form(made.withColumn("key", F.struct("task", "condition", "view")), {"v": 4}, 4, "key").select("key.*", "fy", "fx", "v")


@query("SELECT vec_id, round(avg(CAST(v AS DOUBLE)), 6) + 0.0 AS mean FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) WHERE (pos // 16 - 1.5) ** 2 + (pos // 4 % 4 - 1.5) ** 2 + (pos % 4 - 1.5) ** 2 <= 3.24 GROUP BY vec_id")
def sphere_mean(spark, d):
    return volumes.sphere_mean(table(spark, d, "embeddings"), 4, 1.8).select("vec_id", clean("mean").alias("mean"))


@query("SELECT label || '.mrc' AS file, CAST(pos // 16 + 1 AS INT) AS z, round(sum(v), 4) + 0.0 AS total FROM (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label, pos // 16")
def mrc_volumes(spark, d):
    """Label means as cubic volumes, written and read again."""
    path = shared_folder(spark, "volumes")
    mrc.write_volumes(search.templates(table(spark, d, "embeddings")), path, "task", "template", 4, 1.5)
    found = mrc.volumes(mrc.read_mrc(spark, path))
    return found.select("file", "z", clean(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(
    PX + """, edge AS (SELECT vec_id, avg(v) AS m FROM px WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY vec_id), g AS (SELECT a.i AS y, b.i AS x FROM (SELECT unnest(range(0, 11)) AS i) a, (SELECT unnest(range(0, 11)) AS i) b)
SELECT edge.vec_id, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, round(coalesce(px.v, m), 6) + 0.0 AS v, px.v IS NOT NULL AS copied
FROM edge CROSS JOIN g LEFT JOIN px ON px.vec_id = edge.vec_id AND px.y + 1 = g.y AND px.x + 1 = g.x"""
)
def edge_pad(spark, d):
    """Images of 8 x 8 in squares of 11 x 11, around them their edge mean."""
    return arrays.padded(table(spark, d, "embeddings"), 8, 11, "edge").withColumn("v", clean("v"))


#: What a run's configuration may say: type and default.
KEYS = {"pixel_size": ("double", 1.5), "angular_step": ("double", 3.0), "padding": ("string", "noise"), "maximum_peaks": ("int", 1000)}


@query(
    """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['typo'] ELSE [] END AS unknown, CASE WHEN p_size > 45 THEN 2.0 WHEN p_size % 4 = 0 THEN 1.5 ELSE CAST(p_size - 5 AS DOUBLE) END AS pixel_size, 3.0::DOUBLE AS angular_step,
  CASE WHEN p_size % 5 = 0 THEN 'odd' ELSE 'zero' END AS padding, CAST(p_size - 20 AS INT) AS maximum_peaks FROM part)
SELECT p_partkey, array_to_string(unknown, ',') AS unknown, pixel_size, angular_step, padding, maximum_peaks,
  array_to_string(list_filter([CASE WHEN padding NOT IN ('noise', 'zero', 'edge', 'replicate') THEN 'padding' END, CASE WHEN maximum_peaks < 0 THEN 'peaks' END, CASE WHEN pixel_size <= 0 THEN 'pixel' END], lambda x: x IS NOT NULL), ',') AS broken FROM c"""
)
def run_configs(spark, d):
    """Parts as configurations in JSON, some with a key that no run knows, some overridden."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    said = F.struct(F.when(size % 4 != 0, size - 5).alias("pixel_size"), F.when(size % 5 == 0, "odd").otherwise("zero").alias("padding"), (size - 20).alias("maximum_peaks"), F.when(size % 3 == 0, 1).alias("typo"))
    rows = configs.resolved(p.select("p_partkey", "p_size", F.to_json(said).alias("json")), "json", KEYS, {"pixel_size": F.when(size > 45, 2.0)})
    rules = {"padding": F.col("padding").isin("noise", "zero", "edge", "replicate"), "peaks": F.col("maximum_peaks") >= 0, "pixel": F.col("pixel_size") > 0}
    return rows.select("p_partkey", F.array_join("unknown", ",").alias("unknown"), *KEYS, F.array_join(configs.broken(rules), ",").alias("broken"))


@query(
    r"""WITH s AS (SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS left_ FROM pages)
SELECT page_id, CASE WHEN coalesce(left_, '') = '' THEN 'micrograph_' || lpad(CAST(page_id AS VARCHAR), 6, '0') ELSE regexp_replace(left_, '([^/])\.[^./]+$', '\1') END AS stem FROM s"""
)
def job_paths(spark, d):
    """Addresses of pages as names of images: where a job's results go."""
    return table(spark, d, "pages").select("page_id", configs.stem(F.col("url"), F.col("page_id")).alias("stem"))


@query("SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) - 1 AS INT) AS piece FROM customer")
def contiguous_pieces(spark, d):
    """Customers as tasks in seven contiguous pieces; their numbers run from 0 without gaps."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", configs.piece(F.col("c_custkey"), c.count(), 7).alias("piece"))


@query(
    """WITH n AS (SELECT (SELECT count(*) FROM supplier) * 5 * 25 AS t) SELECT p_partkey, CAST(t AS BIGINT) AS tasks, CAST(p_size * 64 * t AS BIGINT) AS trials, round(CAST(p_size * 64 * t AS DOUBLE) * 0.5, 3) AS independent, CAST(p_size * 64 * 4 AS BIGINT) AS map_bytes FROM part, n"""
)
def search_plans(spark, d):
    """Parts as images: what a search of each would do."""
    made = configs.plan(table(spark, d, "supplier").count(), 5, 25, F.col("p_size").cast("long") * 64, 0.5)
    return table(spark, d, "part").select("p_partkey", *[v.alias(k) for k, v in made.items()]).withColumn("independent", F.round("independent", 3))


@query(
    """WITH n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier), r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 7 % (n * 6) END AS task, n FROM orders, n),
l AS (SELECT *, task // n AS c FROM r)
SELECT o_orderkey, coalesce(s_acctbal, 0.0) AS phi, coalesce(s_acctbal / 2, 0.0) AS theta, coalesce(s_acctbal / 4, 0.0) AS psi, coalesce([-100.0, 0.0, 100.0][c % 3 + 1], 0.0)::DOUBLE AS defocus, coalesce([-0.1, 0.1][c // 3 + 1], 0.0)::DOUBLE AS pixel_size
FROM l LEFT JOIN supplier ON s_suppkey = task % n"""
)
def winner_labels(spark, d):
    """Orders as places of a map whose winner is a task of three defoci and two pixel sizes, or none; suppliers as orientations."""
    s = table(spark, d, "supplier")
    n = s.agg(F.max("s_suppkey")).first()[0] + 1
    own = s.select(F.col("s_suppkey").cast("long").alias("orientation"), F.col("s_acctbal").alias("phi"), (F.col("s_acctbal") / 2).alias("theta"), (F.col("s_acctbal") / 4).alias("psi"))
    found = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("long") * 7 % (n * 6)).alias("task"))
    return configs.labels(found, own, n, [-100, 0, 100], [-0.1, 0.1]).drop("task")


@query(
    """WITH m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS a FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos),
r AS (SELECT label, a, CASE WHEN label % 2 = 0 THEN a ELSE a * 1.25 END AS b FROM m),
g AS (SELECT label, max(abs(b - a)) AS x, avg(abs(b - a)) AS y, sqrt(avg((b - a) ** 2)) AS z, sqrt(sum((b - a) ** 2)) / greatest(sqrt(sum(a * a)), 1e-30) AS l, bool_and(abs(b - a) <= 1e-6 + 1e-5 * abs(a)) AS ok FROM r GROUP BY label)
SELECT CAST(label AS VARCHAR) AS name, CASE WHEN label % 7 = 3 THEN 'missing_candidate' WHEN label % 7 = 5 THEN 'missing_reference' WHEN ok THEN 'close' ELSE 'different' END AS status,
  CASE WHEN label % 7 NOT IN (3, 5) THEN round(x, 7) END AS max_abs, CASE WHEN label % 7 NOT IN (3, 5) THEN round(y, 7) END AS mean_abs, CASE WHEN label % 7 NOT IN (3, 5) THEN round(z, 7) END AS rmse, CASE WHEN label % 7 NOT IN (3, 5) THEN round(l, 7) END AS rel_l2 FROM g"""
)
def npy_compare(spark, d):
    """Label means as files in two folders, some of them changed, some missing on one side."""
    t = search.templates(table(spark, d, "embeddings"))
    a, b = shared_folder(spark, "reference"), shared_folder(spark, "candidate")
    npy.write_arrays(t.where("task % 7 != 5"), a, "task", "template")
    changed = t.withColumn("template", F.when(F.col("task") % 2 == 0, F.col("template")).otherwise(F.transform("template", lambda x: x * 1.25)))
    npy.write_arrays(changed.where("task % 7 != 3"), b, "task", "template")
    found = npy.compared(npy.files(spark, a), npy.files(spark, b), 1e-6, 1e-5)
    return found.select("name", "status", *[F.round(c, 7).alias(c) for c in ("max_abs", "mean_abs", "rmse", "rel_l2")])


@query("SELECT s_suppkey, count(*) AS searched, round(CAST(1024 AS DOUBLE) * count(*) * 0.8 / 3, 6) AS trials FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def independent_trials(spark, d):
    """Suppliers as images of 1,024 pixels, their lines as tasks of three defoci that count once."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("searched"))
    rows = n.join(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    return rows.select("s_suppkey", "searched", F.round(normal.independent_trials(F.lit(1024), F.col("searched"), 0.8, 3, True), 6).alias("trials"))
