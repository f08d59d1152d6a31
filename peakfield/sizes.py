"""Queries of sizes and of what changes sizes: plans of searches, images before a search, result maps after it, fills. Each has the same query in SQL.

Shapes and settings come from `part`, images and maps of 8 x 8 from `embeddings`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import PX, clean, table
from .operators import maps, resizing, sizing

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        _Q[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def shapes(spark, d: str) -> DataFrame:
    """A search for each part: sides, a template's side, pixel size and resolution limit."""
    own = table(spark, d, "part")
    k = F.col("p_partkey")
    return own.select("p_partkey", (200 + (F.col("p_size") % 10) * 173).cast("int").alias("height"), (200 + (k % 6) * 211).cast("int").alias("width"), (48 + (k % 3) * 17).cast("int").alias("template"), (0.8 + (k % 3) * 0.37).alias("pixel_size"), (1.5 + (k % 4) * 1.9).alias("resolution"))


#: The same in SQL; of a size n: the next even sizes without a prime factor over a limit, and the first that is less than a tenth larger.
SMOOTH = """smooth AS (SELECT CAST(CAST(a AS DOUBLE) * b * c * e * f * g AS BIGINT) AS v, CASE WHEN g > 1 THEN 13 WHEN f > 1 THEN 11 WHEN e > 1 THEN 7 WHEN c > 1 THEN 5 WHEN b > 1 THEN 3 ELSE 2 END AS p FROM
  (SELECT CAST(2 ** unnest(range(1, 18)) AS BIGINT) AS a), (SELECT CAST(3 ** unnest(range(0, 11)) AS BIGINT) AS b), (SELECT CAST(5 ** unnest(range(0, 8)) AS BIGINT) AS c), (SELECT CAST(7 ** unnest(range(0, 7)) AS BIGINT) AS e), (SELECT CAST(11 ** unnest(range(0, 5)) AS BIGINT) AS f), (SELECT CAST(13 ** unnest(range(0, 5)) AS BIGINT) AS g) WHERE CAST(a AS DOUBLE) * b * c * e * f * g <= 131072),
nice AS (SELECT n, coalesce(min_by(v, i) FILTER (WHERE v - n < n * 0.1), max_by(v, i)) AS v FROM (SELECT n, i, min(v) AS v FROM {0} JOIN (SELECT unnest([2, 3, 5, 7, 9, 13]) AS lim, unnest([1, 2, 3, 4, 5, 6]) AS i) ON true JOIN smooth ON p <= lim AND v >= greatest(n, 2) GROUP BY n, i) GROUP BY n)
"""
BINNED = "CAST(trunc(CAST({0} AS FLOAT) / {1} + CAST(0.5 AS FLOAT)) AS INT)"
PLAN_SQL = f"""WITH own AS (SELECT DISTINCT CAST(200 + (p_size % 10) * 173 AS INT) AS h, CAST(200 + (p_partkey % 6) * 211 AS INT) AS w, CAST(48 + (p_partkey % 3) * 17 AS INT) AS t, CAST(0.8 + (p_partkey % 3) * CAST(0.37 AS DOUBLE) AS FLOAT) AS pix, CAST(1.5 + (p_partkey % 4) * CAST(1.9 AS DOUBLE) AS FLOAT) AS wanted FROM part),
lim AS (SELECT *, CAST(2 AS FLOAT) * pix AS ny, h > 1024 OR w > 1024 AS large, greatest(h, w) AS square FROM own),
res AS (SELECT *, CASE WHEN large THEN greatest(ny * (CAST(w AS FLOAT) / CAST(1024 AS FLOAT)), ny * (CAST(h AS FLOAT) / CAST(1024 AS FLOAT))) ELSE greatest(wanted, ny) END AS res FROM lim),
tgt AS (SELECT *, abs(CAST(res AS DOUBLE) - ny) > greatest(1e-6 * greatest(res, ny), 1e-6) AS rs, res / pix / CAST(2 AS FLOAT) AS target FROM res),
k0 AS (SELECT h, w, t, pix, wanted, square, target, dir, unnest(range(0, CASE WHEN dir = 1 THEN greatest(0, CAST(ceil(CAST(target AS DOUBLE) * 4102) AS INT) - square) ELSE square - 2 END + 1)) AS k FROM tgt, (SELECT unnest([1, -1]) AS dir) WHERE rs),
k1 AS (SELECT *, square + dir * k AS n, greatest(2, {BINNED.format("(square + dir * k)", "target")}) AS near FROM k0),
k2 AS (SELECT *, CAST(n AS FLOAT) / CAST(near + near % 2 AS FLOAT) AS factor FROM k1),
k3 AS (SELECT *, {BINNED.format("n", "factor")} AS size, abs(CAST(target AS DOUBLE) - CAST(factor AS DOUBLE)) AS err FROM k2),
k4 AS (SELECT *, min(k) FILTER (WHERE err * CAST(pix AS DOUBLE) < 0.00005 OR size > 4096) OVER (PARTITION BY h, w, t, pix, wanted, dir) AS stop FROM k3),
best AS (SELECT h, w, t, pix, wanted, dir, any_value(stop) AS stop, arg_min(factor, (err, k)) AS factor, arg_min(size, (err, k)) AS size, min(err) AS err FROM k4 WHERE k <= stop GROUP BY ALL),
scan AS (SELECT tgt.*, CASE WHEN u.size <= tgt.h AND u.size <= tgt.w THEN u.factor ELSE d.factor END AS bf, CASE WHEN u.size <= tgt.h AND u.size <= tgt.w THEN u.size ELSE d.size END AS bs, CASE WHEN u.size <= tgt.h AND u.size <= tgt.w THEN u.stop ELSE -d.stop END AS bo, CASE WHEN u.size <= tgt.h AND u.size <= tgt.w THEN u.err ELSE d.err END AS be
  FROM tgt LEFT JOIN best u ON u.dir = 1 AND (u.h, u.w, u.t, u.pix, u.wanted) = (tgt.h, tgt.w, tgt.t, tgt.pix, tgt.wanted) LEFT JOIN best d ON d.dir = -1 AND (d.h, d.w, d.t, d.pix, d.wanted) = (tgt.h, tgt.w, tgt.t, tgt.pix, tgt.wanted)),
p0 AS (SELECT *, CASE WHEN rs THEN bf ELSE CAST(1 AS FLOAT) END AS binning, CASE WHEN rs THEN bo ELSE 0 END AS bin_offset, CASE WHEN rs THEN be ELSE abs(CAST(target AS DOUBLE) - 1) END AS ferr, CASE WHEN rs THEN square + bo ELSE h END AS pre_h, CASE WHEN rs THEN square + bo ELSE w END AS pre_w, CASE WHEN rs THEN bs ELSE h END AS crop_h, CASE WHEN rs THEN bs ELSE w END AS crop_w FROM scan),
ask AS (SELECT DISTINCT crop_h AS n FROM p0 UNION SELECT DISTINCT crop_w FROM p0),
{SMOOTH.format("ask")},
p1 AS (SELECT p0.*, CAST(a.v AS INT) AS search_h, CAST(b.v AS INT) AS search_w FROM p0 JOIN nice a ON a.n = crop_h JOIN nice b ON b.n = crop_w),
p2 AS (SELECT *, CASE WHEN rs THEN pre_h - h ELSE search_h - crop_h END AS th, CASE WHEN rs THEN pre_w - w ELSE search_w - crop_w END AS tw FROM p1),
p3 AS (SELECT *, CAST(floor(th / 2.0) AS INT) + CASE WHEN h % 2 = 0 THEN 0 ELSE abs(th % 2) END AS fbh, CAST(floor(th / 2.0) AS INT) + CASE WHEN h % 2 = 0 THEN abs(th % 2) ELSE 0 END AS fah, CAST(floor(tw / 2.0) AS INT) + CASE WHEN w % 2 = 0 THEN 0 ELSE abs(tw % 2) END AS fbw, CAST(floor(tw / 2.0) AS INT) + CASE WHEN w % 2 = 0 THEN abs(tw % 2) ELSE 0 END AS faw FROM p2),
p4 AS (SELECT *, CASE WHEN rs THEN (search_h - crop_h) // 2 ELSE fbh END AS gbh, CASE WHEN rs THEN (search_h - crop_h) // 2 ELSE fah END AS gah, CASE WHEN rs THEN (search_w - crop_w) // 2 ELSE fbw END AS gbw, CASE WHEN rs THEN (search_w - crop_w) // 2 ELSE faw END AS gaw FROM p3),
p5 AS (SELECT *, CASE WHEN rs THEN CAST(ceil(CAST(fbh AS DOUBLE) / binning) AS INT) + gbh ELSE fbh END AS before_h, CASE WHEN rs THEN CAST(ceil(CAST(fah AS DOUBLE) / binning) AS INT) + gah ELSE fah END AS after_h, CASE WHEN rs THEN CAST(ceil(CAST(fbw AS DOUBLE) / binning) AS INT) + gbw ELSE fbw END AS before_w, CASE WHEN rs THEN CAST(ceil(CAST(faw AS DOUBLE) / binning) AS INT) + gaw ELSE faw END AS after_w, {BINNED.format("t", "binning")} AS tc FROM p4)
SELECT h AS height, w AS width, t AS template, round(CAST(pix AS DOUBLE), 6) AS pixel_size, round(CAST(wanted AS DOUBLE), 6) AS resolution, round(CAST(res AS DOUBLE), 5) AS used_resolution, large AS max_search_size_applied, rs AS resampled, NOT rs AND (search_h <> h OR search_w <> w) AS resized, round(CAST(binning AS DOUBLE), 6) AS binning, CAST(bin_offset AS INT) AS bin_offset, pre_h, pre_w, crop_h, crop_w, search_h, search_w,
  before_h, before_w, after_h, after_w, gbh AS fft_before_h, gaw AS fft_after_w, before_h AS lower_h, search_w - 1 - after_w AS upper_w, CAST(search_h - after_h - before_h AS INT) AS roi_h, CAST(search_w - after_w - before_w AS INT) AS roi_w, CAST(search_h - after_h - before_h AS BIGINT) * (search_w - after_w - before_w) AS valid_pixels,
  CAST(search_h - after_h - before_h - gbh - gah AS BIGINT) * (search_w - after_w - before_w - gbw - gaw) AS statistics_pixels, round(CAST(CAST(ferr * pix AS FLOAT) AS DOUBLE), 7) AS binning_error, round(CAST(pix * binning AS DOUBLE), 5) AS search_pixel_size, CAST(tc AS INT) AS template_crop, CAST((SELECT min(v) FROM smooth WHERE p <= 5 AND v >= greatest(tc, 2)) AS INT) AS template_search,
  CASE WHEN search_h - after_h - before_h <= 0 OR search_w - after_w - before_w <= 0 THEN 'sizing leaves no valid area' WHEN search_h - after_h - before_h - gbh - gah <= 0 OR search_w - after_w - before_w - gbw - gaw <= 0 THEN 'statistics have no area' END AS error FROM p5"""


@query(PLAN_SQL)
def search_sizes(spark, d):
    """The plan of each distinct shape and setting."""
    rows = sizing.planned(shapes(spark, d).drop("p_partkey").distinct(), statistics="precompiled", threshold="statistics")
    p = lambda c: F.col(f"plan.{c}")
    num = lambda c, digits: F.round(c.cast("float").cast("double"), digits)
    plain = ["max_search_size_applied", "resampled", "resized", "bin_offset", "pre_h", "pre_w", "crop_h", "crop_w", "search_h", "search_w", "before_h", "before_w", "after_h", "after_w", "fft_before_h", "fft_after_w", "lower_h", "upper_w", "roi_h", "roi_w", "valid_pixels", "statistics_pixels", "template_crop", "template_search", "error"]
    return rows.select("height", "width", "template", num(F.col("pixel_size"), 6).alias("pixel_size"), num(F.col("resolution"), 6).alias("resolution"), num(p("resolution"), 5).alias("used_resolution"), num(p("binning"), 6).alias("binning"), num(p("binning_error"), 7).alias("binning_error"), num(p("search_pixel_size"), 5).alias("search_pixel_size"), *[p(c).alias(c) for c in plain])


FFT_SQL = f"""WITH ask AS (SELECT DISTINCT n_chars AS n FROM documents WHERE n_chars > 0), {SMOOTH.format("ask").replace("131072", "1048576").replace("range(1, 18)", "range(1, 21)").replace("range(0, 11)", "range(0, 13)").replace("range(0, 8)", "range(0, 9)").replace("range(0, 7)", "range(0, 8)").replace("range(0, 5)", "range(0, 6)")}
SELECT n, CAST(v AS BIGINT) AS nice, CAST(2 ** ceil(log2(n)) AS BIGINT) AS power FROM nice"""


@query(FFT_SQL)
def fft_sizes(spark, d):
    """For the lengths of documents, the next size that transforms fast and the next power of two."""
    n = table(spark, d, "documents").where("n_chars > 0").select(F.col("n_chars").alias("n")).distinct()
    return n.select("n", sizing.nice_size(F.col("n")).cast("long").alias("nice"), sizing.power_of_two(F.col("n")).cast("long").alias("power"))


#: A plan as `sizing` makes it: images of 12 x 12, binned by 1.5 to 8 x 8, of which the outermost line does not count.
UP = {"original_h": 12, "original_w": 12, "pre_h": 12, "pre_w": 12, "crop_h": 8, "crop_w": 8, "search_h": 8, "search_w": 8, "lower_h": 1, "lower_w": 1, "upper_h": 6, "upper_w": 6, "before_h": 1, "before_w": 1, "binning": 1.5, "resampled": True, "resized": False, "rotated": False}
DOWN = UP | {"original_h": 8, "original_w": 8, "crop_h": 6, "crop_w": 6, "binning": 2.0}


def fixed(plan: dict):
    return F.struct(F.lit(None).cast("string").alias("error"), *[F.lit(v).alias(k) for k, v in plan.items()])


def placed(made: DataFrame, *more: str) -> DataFrame:
    rows = made.select("vec_id", *more, "width", F.posexplode(F.arrays_zip("values", "inside")).alias("at", "e"))
    return rows.select("vec_id", *more, F.expr("cast(at div width as int)").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), clean("e.values").alias("v"), F.col("e.inside").alias("inside"))


GRID = "{0} AS (SELECT a.i AS y, b.i AS x FROM (SELECT CAST(unnest(range(0, {1})) AS INT) AS i) a, (SELECT CAST(unnest(range(0, {1})) AS INT) AS i) b)"
DOWN_SQL = PX + f""", {GRID.format("g12", 12)}, {GRID.format("g6", 6)}, {GRID.format("g8", 8)},
big AS (SELECT vec_id, g12.y, g12.x, v FROM g12 JOIN px ON px.y = CASE WHEN (g12.y + 14) % 16 < 8 THEN (g12.y + 14) % 16 ELSE 15 - (g12.y + 14) % 16 END AND px.x = CASE WHEN (g12.x + 14) % 16 < 8 THEN (g12.x + 14) % 16 ELSE 15 - (g12.x + 14) % 16 END),
f AS (SELECT vec_id, a.f AS fy, b.f AS fx, sum(v * cos(2 * pi() * (a.f * y + b.f * x) / 12)) / 144 AS re, -sum(v * sin(2 * pi() * (a.f * y + b.f * x) / 12)) / 144 AS im FROM big, (SELECT unnest(range(-3, 3)) AS f) a, (SELECT unnest(range(-3, 3)) AS f) b GROUP BY ALL),
small AS (SELECT vec_id, y, x, sum(re * cos(2 * pi() * (fy * y + fx * x) / 6) - im * sin(2 * pi() * (fy * y + fx * x) / 6)) AS v FROM f CROSS JOIN g6 GROUP BY ALL),
unit AS (SELECT vec_id, y, x, (v - avg(v) OVER (PARTITION BY vec_id)) / sqrt(greatest(var_pop(v) OVER (PARTITION BY vec_id), 1e-12)) AS v FROM small)
SELECT vec_id, g8.y, g8.x, round(v, 6) + 0.0 AS v, g8.y BETWEEN 1 AND 6 AND g8.x BETWEEN 1 AND 6 AS inside FROM g8 JOIN unit u ON u.y = CASE WHEN (g8.y + 11) % 12 < 6 THEN (g8.y + 11) % 12 ELSE 11 - (g8.y + 11) % 12 END AND u.x = CASE WHEN (g8.x + 11) % 12 < 6 THEN (g8.x + 11) % 12 ELSE 11 - (g8.x + 11) % 12 END"""


@query(DOWN_SQL)
def pre_search(spark, d):
    """Images of 8 x 8 mirrored into squares of 12, binned by two, normalised, and mirrored into the search's 8 x 8."""
    images = table(spark, d, "embeddings").withColumn("plan", fixed(DOWN))
    return placed(resizing.to_search(images, "vec_id", "embedding", mode="replicate"))


MAP_NAMES = ["mip", "correlation_sum", "psi", "winner_task_index"]
UP_SQL = PX + f""", {GRID.format("g12", 12)}, {GRID.format("g8", 8)},
off AS (SELECT dy, dx, dy * dy + dx * dx AS d, row_number() OVER (ORDER BY abs(dy), dy, dx) AS i FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy <> 0 OR dx <> 0),
area AS (SELECT y, x, abs(y - 6) <= 2 AND abs(x - 6) <= 2 AS inside FROM g12),
sym AS (SELECT vec_id, g8.y, g8.x, v FROM g8 JOIN px ON px.y = 1 + CASE WHEN (g8.y + 11) % 12 < 6 THEN (g8.y + 11) % 12 ELSE 11 - (g8.y + 11) % 12 END AND px.x = 1 + CASE WHEN (g8.x + 11) % 12 < 6 THEN (g8.x + 11) % 12 ELSE 11 - (g8.x + 11) % 12 END),
f AS (SELECT vec_id, a.f AS fy, b.f AS fx, sum(v * cos(2 * pi() * (a.f * y + b.f * x) / 8)) / 64 AS re, -sum(v * sin(2 * pi() * (a.f * y + b.f * x) / 8)) / 64 AS im FROM sym, (SELECT unnest(range(-4, 4)) AS f) a, (SELECT unnest(range(-4, 4)) AS f) b GROUP BY ALL),
up AS (SELECT vec_id, y, x, inside, sum(re * cos(2 * pi() * (fy * y + fx * x) / 12) - im * sin(2 * pi() * (fy * y + fx * x) / 12)) AS v FROM f CROSS JOIN area GROUP BY ALL),
label AS (SELECT vec_id, CAST(trunc((y - 4) * 1.5) AS INT) + 6 AS y, CAST(trunc((x - 4) * 1.5) AS INT) + 6 AS x, floor(v * 1000) AS v FROM sym WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6),
ids AS (SELECT DISTINCT vec_id FROM px),
need AS (SELECT vec_id, a.y, a.x, l.v FROM ids CROSS JOIN area a LEFT JOIN label l USING (vec_id, y, x) WHERE inside),
fill AS (SELECT n.vec_id, n.y, n.x, any_value(n.v) AS own, arg_min(l.v, (off.d, off.i)) AS near FROM need n CROSS JOIN off LEFT JOIN label l ON l.vec_id = n.vec_id AND l.y = n.y + dy AND l.x = n.x + dx WHERE n.v IS NOT NULL OR l.v IS NOT NULL GROUP BY ALL),
lab AS (SELECT vec_id, y, x, coalesce(own, near) AS v FROM fill),
means AS (SELECT vec_id, avg(v) AS m FROM lab GROUP BY vec_id)
SELECT vec_id, 'mip' AS name, y, x, round(CASE WHEN inside THEN v ELSE avg(v) FILTER (WHERE inside) OVER (PARTITION BY vec_id) END, 6) + 0.0 AS v, inside FROM up
UNION ALL SELECT vec_id, 'correlation_sum', y, x, round(CASE WHEN inside THEN v ELSE 0 END, 6) + 0.0, inside FROM up
UNION ALL SELECT vec_id, 'psi', y, x, round(CASE WHEN inside THEN lab.v ELSE m END, 6) + 0.0, inside FROM means CROSS JOIN area LEFT JOIN lab USING (vec_id, y, x)
UNION ALL SELECT vec_id, 'winner_task_index', y, x, CASE WHEN inside THEN lab.v ELSE -1.0 END + 0.0, inside FROM means CROSS JOIN area LEFT JOIN lab USING (vec_id, y, x)"""


@query(UP_SQL)
def post_search(spark, d):
    """Result maps of 8 x 8 at their images' 12 x 12: two of continuous values, two of labels."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1000).cast("double"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (v if n in resizing.CONTINUOUS else whole).alias("v")) for n in MAP_NAMES])).alias("m")
    rows = table(spark, d, "embeddings").select("vec_id", each).select("vec_id", "m.name", "m.v", fixed(UP).alias("plan"))
    return placed(resizing.from_search(rows, "vec_id", "name", "v"), "name")


FLOOD_SQL = PX + """, known AS (SELECT vec_id, y, x, CASE WHEN v >= 0.25 THEN v END AS v FROM px),
k0 AS (SELECT *, CASE WHEN v IS NOT NULL THEN 0 END AS r FROM known)""" + "".join(
    f""", n{i} AS (SELECT a.vec_id, a.y, a.x, arg_min(b.v, CASE WHEN b.x < a.x THEN 0 WHEN b.x > a.x THEN 1 WHEN b.y < a.y THEN 2 ELSE 3 END) AS v FROM k{i} a JOIN k{i} b ON a.vec_id = b.vec_id AND a.v IS NULL AND b.v IS NOT NULL AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
k{i + 1} AS (SELECT vec_id, y, x, coalesce(k{i}.v, n{i}.v) AS v FROM k{i} LEFT JOIN n{i} USING (vec_id, y, x))"""
    for i in range(14)
) + " SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) + 0.0 AS v FROM k14"


@query(FLOOD_SQL)
def flood_fill(spark, d):
    """Maps of which few places are known, filled to the last place; those without any known place stay empty."""
    px = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "e"))
    rows = px.select("vec_id", F.expr("cast(at div 8 as int)").alias("y"), F.expr("cast(at % 8 as int)").alias("x"), F.col("e").cast("double").alias("v"))
    return maps.flooded(rows.withColumn("v", F.when(F.col("v") >= 0.25, F.col("v")))).withColumn("v", clean("v"))
