"""Queries over files and optics: each derives its files from the driver's tables with Spark and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import normal, optics
from .operators import arrays, grids
from .sources import mrc, pdb, star
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


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT vec_id, CAST(8 AS INT) AS nx, CAST(8 AS INT) AS ny, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 6) AS total, list_max(embedding) AS most, list_min(embedding) AS least FROM embeddings")
def mrc_stacks(spark, d):
    """Embeddings as stacks of 8 x 8 images, written and read again."""
    path = shared_folder(spark, "stacks")
    mrc.write_stacks(table(spark, d, "embeddings"), path, "vec_id", "embedding", (8, 8), 1.5)
    v = F.col("values")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return mrc.read_stacks(spark, path, "vec_id").select("vec_id", "nx", "ny", F.round(total, 6).alias("total"), F.array_max(v).alias("most"), F.array_min(v).alias("least"))


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 8 AS VARCHAR) AS optics_group, CAST(CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 300 END AS DOUBLE) AS voltage, CAST(1.0 + (o_orderkey % 8) / 8.0 AS DOUBLE) AS pixel_size,
o_totalprice AS defocus_u, o_totalprice / 2 AS defocus_v, CAST(2.7 AS DOUBLE) AS spherical_aberration, CAST(CASE WHEN o_custkey % 2 = 0 THEN 0.1 ELSE 0.07 END AS DOUBLE) AS amplitude_contrast FROM orders"""
)
def star_micrographs(spark, d):
    """Orders as STAR catalogs of at most 4,096 micrographs and eight optics groups each, which stand twice; the later row counts."""
    o, path = table(spark, d, "orders"), shared_folder(spark, "star")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    of = F.expr("o_orderkey div 4096").alias("file")
    names = lambda *n: F.array(*[F.lit(x) for x in n]).alias("columns")
    rows = o.select(
        of, F.lit("micrographs").alias("block"), names("_rlnMicrographName", "_rlnOpticsGroup", "_rlnDefocusU", "_rlnDefocusV", "_rlnVoltage", "_rlnAmplitudeContrast"),
        F.array(F.concat(F.lit("image "), text("o_orderkey")), text(F.col("o_orderkey") % 8), text("o_totalprice"), text(F.col("o_totalprice") / 2), F.when(F.col("o_orderstatus") == "F", "200").otherwise("."), F.when(F.col("o_custkey") % 2 == 0, "0.1").otherwise("?")).alias("values"),
        F.col("o_orderkey").alias("place"),
    )
    files = o.select(of).distinct()
    group = files.select("file", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("place")).withColumn("g", F.col("place") % 8)
    size = F.when(F.col("place") < 8, F.lit(9.0)).otherwise(1 + F.col("g") / 8)
    groups = group.select("file", F.lit("optics").alias("block"), names("_rlnOpticsGroup", "_rlnVoltage", "_rlnImagePixelSize"), F.array(text("g"), F.lit("300"), text(size)).alias("values"), F.col("place").cast("long").alias("place"))
    star.write_star(rows.union(groups), path)
    found = star.micrographs(star.read_star(spark, path), {"spherical_aberration": 2.7, "amplitude_contrast": 0.07})
    key = F.regexp_extract("micrograph", r"image (\d+)", 1).cast("long").alias("o_orderkey")
    return found.select(key, "optics_group", "voltage", "pixel_size", "defocus_u", "defocus_v", "spherical_aberration", "amplitude_contrast")


ATOMS = """WITH a AS (SELECT ['C', 'N', 'O', 'S', 'H', 'X'][p_partkey % 6 + 1] AS element, chr(CAST(65 + p_size % 20 AS INT)) AS chain, CAST(CAST(round(p_size / 2.0, 3) AS FLOAT) AS DOUBLE) AS x, CAST(CAST((p_partkey % 320) / 8.0 - 20 AS FLOAT) AS DOUBLE) AS y, CAST(CAST((p_partkey % 97) / 4.0 - 12 AS FLOAT) AS DOUBLE) AS z FROM part),
e AS (SELECT * FROM (VALUES ('H', 1.0, 1.00794), ('C', 6.0, 12.0107), ('N', 7.0, 14.00674), ('O', 8.0, 15.9994), ('S', 16.0, 32.066)) t(element, n, m))"""


def _atoms(spark, d):
    path = shared_folder(spark, "atoms")
    names = F.array(*[F.lit(x) for x in "CNOSHX"])
    p = table(spark, d, "part").select("p_partkey", "p_size")
    pdb.write_pdb(p.select(F.lit("ATOM").alias("record"), F.chr(65 + F.col("p_size") % 20).alias("chain"), F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("element"), (F.col("p_size") / 2).alias("x"), ((F.col("p_partkey") % 320) / 8 - 20).alias("y"), ((F.col("p_partkey") % 97) / 4 - 12).alias("z")), path)
    return pdb.read_pdb(spark, path)


@query(ATOMS + " SELECT chain, count(*) AS atoms, round(sum(coalesce(m, 0) * x) / sum(coalesce(m, 0)), 6) AS x, round(sum(coalesce(m, 0) * y) / sum(coalesce(m, 0)), 6) AS y, round(sum(coalesce(m, 0) * z) / sum(coalesce(m, 0)), 6) AS z FROM a LEFT JOIN e USING (element) WHERE chain <> 'B' GROUP BY 1")
def pdb_centers(spark, d):
    """Parts as atoms in PDB text; centre of mass of each chain but one."""
    found = pdb.center(pdb.of_chains(_atoms(spark, d), exclude=["B"]), "chain")
    return found.select("chain", "atoms", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(
    ATOMS
    + """, q AS (SELECT n, x / 4 + 12 AS x, y / 4 + 12 AS y, z / 4 + 12 AS z FROM a JOIN e USING (element)),
s AS (SELECT *, unnest(range(greatest(CAST(round_even(z - 4, 0) AS BIGINT), 0), least(CAST(round_even(z + 4, 0) AS BIGINT), 23))) AS vz FROM q), t AS (SELECT *, unnest(range(greatest(CAST(round_even(y - 4, 0) AS BIGINT), 0), least(CAST(round_even(y + 4, 0) AS BIGINT), 23))) AS vy FROM s),
u AS (SELECT *, unnest(range(greatest(CAST(round_even(x - 4, 0) AS BIGINT), 0), least(CAST(round_even(x + 4, 0) AS BIGINT), 23))) AS vx FROM t), k AS (SELECT (pi() / (5.0 / 4)) ** 2 AS f)
SELECT CAST(vz AS INT) AS z, CAST(vy AS INT) AS y, CAST(vx AS INT) AS x, round(sum(n * (f / pi()) ** 1.5 * exp(-f * sqrt((vx - x) ** 2 + (vy - y) ** 2 + (vz - z) ** 2))), 5) AS density FROM u, k GROUP BY 1, 2, 3"""
)
def pdb_density(spark, d):
    return pdb.density(_atoms(spark, d), 24, 4.0, 5.0).select("z", "y", "x", F.round("density", 5).alias("density"))


@query(
    """WITH a AS (SELECT o_orderkey, (o_orderkey % 5) / 8.0 AS fx, (o_orderkey // 5 % 8 - 4) / 8.0 AS fy, 1.0 + (o_orderkey % 8) / 8.0 AS px, CASE WHEN o_orderstatus = 'F' THEN 200000.0 ELSE 300000.0 END AS v, CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE o_totalprice / 10 END AS d FROM orders),
b AS (SELECT *, fx * fx + fy * fy AS g, 12.2639 / sqrt(v * (1 + 0.97845e-6 * v)) / px AS w FROM a), c AS (SELECT *, 0.5 * (1.9 * d / px + cos(2 * (atan2(fy, fx) - radians(30.0))) * 0.1 * d / px) AS f FROM b)
SELECT o_orderkey, round(CASE WHEN d = 0 THEN -0.7 ELSE -sin(pi() * w * g * (f - 0.5 * w * w * g * 2.7e7 / px) + radians(15.0) + atan(0.07 / sqrt(1 - 0.07 * 0.07))) END, 5) AS transfer FROM c"""
)
def contrast_transfer(spark, d):
    """Transfer of each order's settings at a frequency of its own."""
    k, lit = F.col("o_orderkey"), lambda x: F.lit(float(x))
    one = F.when(F.col("o_custkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice") / 10)
    volts = F.when(F.col("o_orderstatus") == "F", 200.0).otherwise(300.0)
    value = optics.transfer((k % 5) / 8, (F.expr("o_orderkey div 5") % 8 - 4) / 8, 1 + (k % 8) / 8, volts, lit(2.7), lit(0.07), one, one * 0.9, lit(30), lit(15))
    return table(spark, d, "orders").select("o_orderkey", F.round(value, 5).alias("transfer"))


@query(
    """WITH a AS (SELECT event_id, radians(event_id % 360) AS a, radians(event_id // 360 % 181) AS b, radians(user_id % 360) AS c FROM events)
SELECT event_id, round(cos(a) * cos(b) * cos(c) - sin(a) * sin(c), 7) + 0.0 AS m00, round(-cos(a) * cos(b) * sin(c) - sin(a) * cos(c), 7) + 0.0 AS m01, round(sin(b) * sin(a), 7) + 0.0 AS m12, round(-sin(b) * cos(c), 7) + 0.0 AS m20, round(cos(b), 7) + 0.0 AS m22 FROM a"""
)
def rotations(spark, d):
    m = grids.rotation(F.col("event_id") % 360, F.expr("event_id div 360") % 181, F.col("user_id") % 360)
    rows = table(spark, d, "events").select("event_id", m.alias("m"))
    return rows.select("event_id", *[(F.round(F.col("m")[3 * i + j], 7) + 0.0).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (1, 2), (2, 0), (2, 2))])


@query()
def winner_orientations(spark, d):
    """Tasks of events decoded to views of a grid; only the bounded grid is broadcast."""
    grid = grids.orientations(spark, "C4", 15.0, 30.0)
    n = len(grids.views("C4", 15.0)) * 13
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % n).alias("orientation_index"))
    return e.join(F.broadcast(grid), "orientation_index", "left").select("event_id", "grid_index", "phi", "theta", "psi")


@query()
def search_grids(spark, d):
    """The grids that searches take whose settings follow from parts: some without a radius or steps, some of a single view, some of no known symmetry."""
    k, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(*[F.lit(n) for n in ("C1", "c 4", "D2", "T", "O", "I", "X9")])
    rows = table(spark, d, "part").select(
        "p_partkey", F.element_at(names, (k % 7 + 1).cast("int")).alias("symmetry"), (size / 10 + 3).alias("resolution"), (size % 5 / 4 + 1).alias("pixel"), ((size % 7) * 30 - 29.5).alias("radius"),
        F.when(k % 3 == 0, size % 9 + 4.0).when(k % 3 == 1, 0.0).alias("angular_step"), F.when(k % 5 == 0, size % 4 * 1.5).alias("psi_step"), (k % 10 == 9).alias("one"),
    )
    return grids.planned(rows)


@query("SELECT p_partkey, unnest(list_transform(range(-CAST(floor(p_size / 7.0 + 0.5) AS BIGINT), CAST(floor(p_size / 7.0 + 0.5) AS BIGINT) + 1), lambda i: CAST(i * 7.0 AS DOUBLE))) AS shift FROM part")
def search_offsets(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(grids.offsets(F.col("p_size").cast("double"), F.lit(7.0))).alias("shift"))


@query()
def noise_threshold(spark, d):
    """Events above the score that 20 false positives in as many trials ask for, with the tail probability of each."""
    e = table(spark, d, "events").select("event_id", "value")
    one = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n")).withColumn("least", normal.threshold(F.lit(20), F.col("n")))
    rows = e.crossJoin(F.broadcast(one)).withColumn("z", (F.col("value") - F.col("m")) / F.col("s")).where("z >= least")
    return rows.select("event_id", F.round("z", 6).alias("z"), F.round("least", 6).alias("threshold"), F.round(normal.survival("z"), 9).alias("tail"))


PX = "WITH f AS (SELECT vec_id, unnest(embedding) AS v0, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), px AS (SELECT vec_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(v0 AS DOUBLE) AS v FROM f)"


@query(PX + ", b AS (SELECT CAST(floor(sqrt((y - 4) ** 2 + (x - 4) ** 2) + 0.5) - 1 AS BIGINT) AS bin, avg(v * v) AS p FROM px WHERE floor(sqrt((y - 4) ** 2 + (x - 4) ** 2) + 0.5) - 1 BETWEEN 0 AND 3 GROUP BY 1), w AS (SELECT bin, 1 / sqrt(p) AS w FROM b WHERE p > 0) SELECT bin, round(w / max(w) OVER (), 7) AS weight FROM w")
def whitening(spark, d):
    return arrays.whitening(arrays.radial_nearest(arrays.pixels(table(spark, d, "embeddings"), 8), 8)).select("bin", F.round("weight", 7).alias("weight"))


@query(PX + ", g AS (SELECT y, x FROM range(12) a(y), range(12) b(x)) SELECT k.vec_id, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, coalesce(px.v, 0.0) AS v FROM embeddings k CROSS JOIN g LEFT JOIN px ON px.vec_id = k.vec_id AND px.y = g.y - 2 AND px.x = g.x - 2")
def center_pad(spark, d):
    """Images of 8 x 8 in the middle of 12 x 12 zeros."""
    return arrays.centered(table(spark, d, "embeddings"), 8, 12, 0.0)


@query(PX + " SELECT vec_id, y, x, coalesce(lag(v, 2) OVER (PARTITION BY vec_id, y ORDER BY x), 0.0) AS v FROM px")
def shift_without_wrap(spark, d):
    return arrays.shifted(_px(spark, d), 8, 0, 2, 0.0)


def _px(spark, d):
    return arrays.pixels(table(spark, d, "embeddings"), 8)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
