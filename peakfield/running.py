"""Queries of configurations, batches of jobs, correlation stacks and sinks of runs, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .kernel import clean, table
from .operators import batch, histogram, paths, peaks, schema, search, stages
from .queries import HIST, _z
from .sources import commits, prepared, stacks
from .sources.files import shared_folder

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


#: A configuration for each part; many of them are wrong in one way or another. The same text in either dialect.
TEXT = """CASE p_partkey % 10
 WHEN 0 THEN concat('{"input_mrc":"a.mrc","template_mrc":"t.mrc","search":{"pixel_size_angstrom":', CAST(p_size AS STRING), '.5,"padding_mode":"edge"}}')
 WHEN 1 THEN concat('{"input_mrc":"', p_brand, '"')
 WHEN 2 THEN concat('{"search":{"pixel_size":1.5,"maximum_peaks":', CAST(p_size - 25 AS STRING), '},"extra":1}')
 WHEN 3 THEN concat('{"search":{"pixel_size_angstrom":"abc"},"batch":{"first_micrograph":', CAST(p_size AS STRING), ',"last_micrograph":20}}')
 WHEN 4 THEN concat('{"microscope":{"amplitude_contrast":', CAST(p_size / 40.0 AS STRING), '},"template":{"source":"pdb","box_size":', CAST(p_size AS STRING), '}}')
 WHEN 5 THEN '{"search":5,"timing":{"mode":"often"}}'
 WHEN 6 THEN '[1, 2]'
 WHEN 7 THEN concat('{"template":{"include_chains":["A","', substr(p_brand, 7, 1), '"],"exclude_chains":["1","3","5"]}}')
 WHEN 8 THEN concat('{"debug":{"level":', CAST(p_size AS STRING), ',"single_orientation_phi_deg":10,"stop_after_stage":', CAST(p_size AS STRING), '}}')
 ELSE '{}' END"""


def _duck_rules() -> str:
    """The rules over values that are read from the text, as a list of SQL expressions."""
    import re

    known = schema.sections()
    parts = []
    for r in schema.rules():
        def value(m, r=r):
            path = m.group(0)
            s, k = path.split(".") if "." in path else ("-", path)
            kind, default = known[s][k]
            at = f"j->'$.{path}'" if s == "-" else f"j->'$.{s}.{k}'"
            if kind == "string":
                own = f"CASE WHEN json_type({at}) = 'VARCHAR' THEN j->>'$.{path}' END"
                absent = "NULL" if default == "null" else "'" + default.strip('"') + "'"
            elif kind.startswith("array"):
                own, absent = f"CAST({at} AS VARCHAR[])", "CAST([] AS VARCHAR[])"
            else:
                own = f"CASE WHEN json_type({at}) IN ({dict(boolean=repr('BOOLEAN')).get(kind, repr('UBIGINT') + ', ' + repr('BIGINT') + ('' if kind == 'int' else ', ' + repr('DOUBLE')))}) THEN CAST({at} AS {kind.upper()}) END"
                absent = default
            return f"coalesce({own}, {absent})"

        names = "|".join([*[rf"{s}\.\w+" for s in known if s != "-"], *known["-"]])
        sql = re.sub(rf"(?<![\w.'])({names})\b(?!')", value, r).replace("arrays_overlap", "list_has_any")
        parts.append(f"CASE WHEN NOT coalesce({sql}, false) THEN 'not {r.replace(chr(39), chr(39) * 2)}' END")
    return ", ".join(parts)


def _duck_types() -> str:
    """Errors of types and of unknown keys, as SQL expressions that give lists."""
    known, parts = schema.sections(), []
    ok = {"double": ["UBIGINT", "BIGINT", "DOUBLE"], "int": ["UBIGINT", "BIGINT"], "boolean": ["BOOLEAN"], "string": ["VARCHAR"], "array<string>": ["ARRAY"]}
    names = lambda keys: "[" + ", ".join(f"'{k}'" for k in keys) + "]"
    parts.append(f"list_transform(list_filter(json_keys(j), lambda k: NOT list_contains({names([*known['-'], *[s for s in known if s != '-']])}, k)), lambda k: 'unknown key ' || k)")
    for s, keys in known.items():
        if s != "-":
            parts.append(f"CASE WHEN json_type(j->'$.{s}') <> 'OBJECT' THEN ['{s} is no object'] END")
            parts.append(f"list_transform(list_filter(json_keys(j->'$.{s}'), lambda k: NOT list_contains({names(keys)}, k)), lambda k: 'unknown key {s}.' || k)")
        for k, (kind, _) in keys.items():
            path = k if s == "-" else f"{s}.{k}"
            parts.append(f"CASE WHEN json_type(j->'$.{path}') NOT IN ({', '.join(repr(t) for t in ok[kind])}) THEN ['{path} is no {kind}'] END")
    return ", ".join(f"coalesce({p}, CAST([] AS VARCHAR[]))" for p in parts)


CONFIG_SQL = f"""WITH t AS (SELECT p_partkey, {TEXT.replace("AS STRING", "AS VARCHAR")} AS t FROM part),
v AS (SELECT p_partkey, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t ELSE '{{}}' END) = 'OBJECT' THEN t END AS t FROM t),
p AS (SELECT p_partkey, t IS NULL AS bad, CAST(coalesce(t, '{{}}') AS JSON) AS j FROM v),
e AS (SELECT p_partkey, bad, j, flatten([{_duck_types()}]) AS types, list_filter([{_duck_rules()}], lambda x: x IS NOT NULL) AS broken FROM p)
SELECT p_partkey, array_to_string(list_sort(list_concat(CASE WHEN bad THEN ['no JSON object'] ELSE CAST([] AS VARCHAR[]) END, list_concat(types, broken))), '; ') AS errors,
  CASE WHEN json_type(j->'$.search.pixel_size_angstrom') = 'DOUBLE' THEN CAST(j->'$.search.pixel_size_angstrom' AS DOUBLE) ELSE 1.0 END AS pixel_size, coalesce(j->>'$.search.padding_mode', 'noise') AS padding, coalesce(CAST(j->'$.template.include_chains' AS VARCHAR[]), CAST([] AS VARCHAR[])) AS chains FROM e"""


@query(CONFIG_SQL)
def configurations(spark, d):
    """A nested configuration for each part, read by the whole schema, with all errors of each."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(TEXT).alias("text"))
    c = lambda k: F.col(f"config.{k}")
    return schema.read(rows, "text").select("p_partkey", F.array_join("errors", "; ").alias("errors"), c("search.pixel_size_angstrom").alias("pixel_size"), c("search.padding_mode").alias("padding"), c("template.include_chains").alias("chains"))


@query("SELECT vec_id AS stack_index, label AS task_index, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) + 0.0 AS total, (SELECT count(*) FROM embeddings) AS written FROM embeddings WHERE vec_id BETWEEN 100 AND 399")
def ccf_stack(spark, d):
    """Maps in a stack of shards, of which a range is read back, and how many maps its index has."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("stack_index"), F.col("label").alias("task_index"), F.col("embedding").alias("values"))
    path = shared_folder(spark, "stack")
    stacks.write_stack(e, path, e.agg(F.max("stack_index")).first()[0] + 1, (8, 8), 64)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double"))
    found = stacks.read_stack(spark, path, 100, 399).select("stack_index", "task_index", clean(total, 5).alias("total"))
    return found.withColumn("written", F.lit(stacks.read_index(spark, path).count()).cast("long"))


RESULT_SQL = HIST + """, s AS (SELECT bin, n, first_value(n) OVER w AS lo, last_value(n) OVER w AS hi, lag(n, 1) OVER o AS a1, lag(n, 2) OVER o AS a2, lead(n, 1) OVER o AS b1, lead(n, 2) OVER o AS b2 FROM dn
  WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o AS (ORDER BY bin)),
sm AS (SELECT bin, n, CAST(round_even(greatest((-3 * coalesce(a2, lo) + 12 * coalesce(a1, lo) + 17 * n + 12 * coalesce(b1, hi) - 3 * coalesce(b2, hi)) / 35.0, 0.0), 0) AS BIGINT) AS smooth FROM s),
hr AS (SELECT bin, round(bin * 0.068359375 - 12.4658203125, 8) AS mid, round((bin * 0.068359375 - 12.4658203125 - 0.5) / 2, 8) AS scaled, n, smooth, sum(smooth) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS surv FROM sm),
pk AS (SELECT user_id % 4 AS grid, event_id, value, row_number() OVER (PARTITION BY user_id % 4 ORDER BY value DESC, event_id // 64, event_id % 64) AS r FROM events WHERE value >= 1.0)
SELECT 'histogram' AS part, CAST(bin AS BIGINT) AS a, n AS b, CAST(smooth AS DOUBLE) AS c, CAST(surv AS DOUBLE) AS e, mid AS f, scaled AS g FROM hr
UNION ALL SELECT 'peaks', grid, r, round(value, 6), round((event_id % 64) * 1.5, 6), round((event_id // 64) * 1.5, 6), round(CAST(event_id % 360 + event_id % 180 + event_id % 90 AS DOUBLE), 6) FROM pk WHERE r <= 100
UNION ALL SELECT 'map', user_id % 4, event_id, round(value, 6), CAST(event_id % 64 AS DOUBLE), CAST(event_id // 64 AS DOUBLE), 0.0 FROM events"""


@query(RESULT_SQL)
def run_result(spark, d):
    """A run's maps, peaks and histogram in one commit, and what is read back of it: peaks without a radius, the histogram of scores, and the maps themselves."""
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("grid"), F.col("event_id"), (F.col("event_id") % 64).alias("x"), F.expr("event_id div 64").alias("y"), F.col("value").alias("score"))
    n = lambda k: (F.col("event_id") % k).cast("double")
    labels = e.select("grid", "x", "y", F.col("score").alias("mip_zscore"), n(360).alias("phi_deg"), n(180).alias("theta_deg"), n(90).alias("psi_deg"), F.lit(0.0).alias("defocus_offset_angstrom"), F.lit(0.0).alias("pixel_size_offset_angstrom"))
    found = peaks.described(peaks.greedy(e, 1.0, 0.0, 100), labels, 1.5)
    path = shared_folder(spark, "result")
    commits.write_result(spark, path, {"maps": e, "peaks": found, "histogram": histogram.report(histogram.histogram(_z(spark, d), "z"), F.lit(1000.0), 0.5, 2.0)}, {"threshold": 1.0})
    h, p, m = (commits.read_result(spark, path, k) for k in ("histogram", "peaks", "maps"))
    num = lambda c, digits=6: clean(F.col(c).cast("double"), digits)
    out = h.select(F.lit("histogram").alias("part"), F.col("bin").cast("long").alias("a"), F.col("raw_count").alias("b"), num("smoothed_count").alias("c"), num("observed_survival").alias("e"), num("snr_midpoint", 8).alias("f"), num("source_curve_x_scaled", 8).alias("g"))
    out = out.union(p.select(F.lit("peaks"), "grid", F.col("rank").cast("long"), num("score"), num("x_angstrom"), num("y_angstrom"), clean(F.col("phi_deg") + F.col("theta_deg") + F.col("psi_deg"))))
    return out.union(m.select(F.lit("map"), "grid", "event_id", num("score"), num("x"), num("y"), F.lit(0.0)))


@query("SELECT c_custkey AS \"index\", 'ok' AS status, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS attempt, round(abs(c_acctbal) / 2, 4) + 0.0 AS threshold, c_nationkey + 1 AS number_of_peaks, c_acctbal < 0 AS failed_first FROM customer")
def batch_manifest(spark, d):
    """A job for each customer. Those in debt fail in the first attempt and leave their error; the second runs them alone."""
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("index"), "c_acctbal", "c_nationkey")
    path = shared_folder(spark, "batch")
    made = "threshold double, number_of_peaks int"

    def strict(job):
        if job["c_acctbal"] < 0:
            raise ValueError(f"the balance is {job['c_acctbal']}")
        return {"threshold": job["c_acctbal"] / 2, "number_of_peaks": job["c_nationkey"] + 1}

    first = batch.run(jobs, strict, made, path).where("status = 'failed' and error like 'ValueError: the balance is -%' and traceback is not null").select("index", F.lit(True).alias("failed_first"))
    done = batch.run(jobs, lambda job: strict(job | {"c_acctbal": abs(job["c_acctbal"])}), made, path)
    return done.join(first, "index", "left").select("index", "status", F.col("attempt").cast("int").alias("attempt"), clean("threshold", 4).alias("threshold"), "number_of_peaks", F.coalesce("failed_first", F.lit(False)).alias("failed_first"))


@query("""WITH c AS (SELECT page_id, sha256(coalesce(html, '')) AS sha256, length(coalesce(html, '')) AS n FROM pages)
SELECT page_id, sha256, CAST(n AS INT) AS n, (SELECT count(DISTINCT sha256) FROM c) AS made_first, 0 AS made_again, (SELECT count(DISTINCT sha256) FROM c) AS made_changed FROM c""")
def prepared_pages(spark, d):
    """Something made of each page once: equal pages share an entry, a second preparation makes nothing, another setting makes all anew."""
    pages = table(spark, d, "pages").select("page_id", "html")
    path = shared_folder(spark, "prepared")
    make = lambda rows: rows.select("entry", F.length(F.coalesce("html", F.lit(""))).alias("n"))
    _, first = prepared.prepare(pages, "html", {"box": 8, "chains": ["A"]}, make, path)
    found, again = prepared.prepare(pages, "html", {"chains": ["A"], "box": 8}, make, path)
    rows = found.select("page_id", "sha256", "n")
    _, changed = prepared.prepare(pages, "html", {"box": 9, "chains": ["A"]}, make, path)
    return rows.withColumns({"made_first": F.lit(first).cast("long"), "made_again": F.lit(again), "made_changed": F.lit(changed).cast("long")})


@query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/data/' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') AS raw FROM pages),
n AS (SELECT page_id, raw, starts_with(raw, '/') AS abs, array_to_string(list_filter(string_split(raw, '/'), lambda p: p NOT IN ('', '.')), '/') AS p FROM r),
f AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN '/one/' WHEN 1 THEN '/data/star/' WHEN 2 THEN '/' ELSE '/two/' END || p AS path FROM n WHERE page_id % 5 < 4),
c AS (SELECT page_id, raw, abs, '/one/' || p AS a, '/data/star/' || p AS b, '/' || p AS d FROM n)
SELECT page_id, CASE WHEN abs THEN d WHEN a IN (SELECT path FROM f) THEN a WHEN b IN (SELECT path FROM f) THEN b ELSE a END AS resolved, CASE WHEN abs THEN d IN (SELECT path FROM f) ELSE a IN (SELECT path FROM f) OR b IN (SELECT path FROM f) END AS "exists" FROM c""")
def resolved_paths(spark, d):
    """A path for each page, relative but for some, against a listing in which most of them stand below one of several roots."""
    raw = F.concat(F.when(F.col("page_id") % 7 == 0, "/data/").otherwise(""), F.regexp_replace("url", "^[a-z]+://", ""))
    rows = table(spark, d, "pages").select("page_id", raw.alias("raw"))
    root = F.when(F.col("page_id") % 5 == 0, "/one/").when(F.col("page_id") % 5 == 1, "/data/star/").when(F.col("page_id") % 5 == 2, "/").otherwise("/two/")
    files = rows.where("page_id % 5 < 4").select(paths.normal(F.concat(root, "raw")).alias("path"))
    return paths.resolved(rows, "raw", files, ["/one", "/data/star/"]).select("page_id", "resolved", "exists")


@query("""WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), t AS (SELECT CAST(label AS BIGINT) AS task, pos, avg(CAST(v AS DOUBLE)) AS v FROM e GROUP BY ALL),
s AS (SELECT vec_id, task, round(list_sum(list_transform(list_zip(embedding, template), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 9) AS score FROM embeddings CROSS JOIN (SELECT task, list(v ORDER BY pos) AS template FROM t GROUP BY task))
SELECT vec_id, CASE WHEN max(score) > 0 THEN round(max(score), 6) ELSE 0.0 END AS mip, CASE WHEN max(score) > 0 THEN min_by(task, (-score, task)) END AS task, 2 AS stopped_after FROM s GROUP BY vec_id""")
def staged_search(spark, d):
    """A search in three stages that stops after the second and goes on from what that has left."""
    images = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    path = shared_folder(spark, "stages")
    steps = [("images", lambda rows: rows), ("scores", lambda rows: search.scores(rows, search.templates(rows))), ("maxima", search.maximum)]
    stages.run(images, steps, path, stop_after=2)
    stopped = stages.done(spark, path, steps).where("committed").count()
    return stages.run(images.where("false"), steps, path).select("vec_id", clean("mip").alias("mip"), "task").withColumn("stopped_after", F.lit(stopped))
