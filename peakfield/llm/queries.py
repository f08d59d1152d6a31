"""The queries of these operators over the tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, linededup, lm, neardup, negatives, rules, segment, sharding, tokens, urls, warc, whitening
from ._common import is_held, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.captures(warc.read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, path, "ids_crc32 long", tokens.crc32).withColumnRenamed("id", "doc_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    names = F.array_join(F.array_sort(F.transform(c["items"], lambda x: x.cast("string"))), ",")
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", c["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size(c["spans"]) > 0).alias("contaminated"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards_by_bytes(table(spark, sf_dir, "documents"), 16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = segment.with_segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    docs = docs.withColumn("decoded", segment.decoded(F.col("segmentations"), path))
    s = F.col("segmentations")
    each = F.transform(s, lambda x: F.struct(F.size(x["ids"]).alias("n_pieces"), F.xxhash64(x["ids"]).alias("ids_hash"), F.round(x["log_p"], 6).alias("log_p"), F.round(x["perturbed"], 6).alias("perturbed"), x["inclusion"].alias("inclusion"), F.round(x["log_inclusion"], 6).alias("log_inclusion")))
    return docs.select("doc_id", F.size(s).alias("n_samples"), each.alias("samples"), F.forall("decoded", lambda t: t == F.col("text")).alias("round_trip"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), lambda c: ~is_held(c, 5, 1)).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.fit(rules.labelled(docs, table(spark, sf_dir, "labels"), 20_000))
    rows, stats = rules.features(docs)
    failed, rule = rules.base_failed(stats), learned.verdict(stats)
    return rows.select("doc_id", *[stats[k].alias(k) for k in rules.COUNTS], failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.LanguageFilters.fit(docs.where(~is_held(F.col("doc_id"), 4, 2)))
    found = language.with_language(docs.drop("lang"), model)
    return found.select("doc_id", is_held(F.col("doc_id"), 4, 2).alias("held_out"), F.col("language.lang_pred"), F.col("language.score"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(urls.fetch_times(pages), urls.listed(pages))
    return judged.select(F.col("id").alias("page_id"), "url", F.col("fetched").cast("string").alias("fetched"), "verdict", "list", "key", F.col("since").cast("string").alias("since"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0, label)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def queries() -> dict:
    import corpus_pipeline

    own = {f.__name__: f for f in (op1_neardup, op2_warc, op3_tokens, op4_decontaminate, op5_shards, op6_segmentations, op7_lm, op8_quality, op9_language, op10_urls, op11_negatives, op12_lines, op13_whitening)}
    return own | {"pipeline": corpus_pipeline.run}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h FROM p),
e AS (SELECT page_id, n, list_aggregate(list_transform(range(0, 8), lambda g: (
  list_aggregate(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(h, CAST(1 + 5 * g AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31 AS INT), 1)), 'string_agg', ''))), 'string_agg', '') AS b FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY n, b) AS first FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""

CONTAMINATION_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, spot.n, i, item_id FROM spot JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

URL_SQL = """
WITH p AS (SELECT page_id, url, DATE '2023-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7) AS BIGINT) % 730 AS INT) AS fetched,
  lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS seg,
  list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/'), lambda x: x <> '') AS segs FROM pages),
l0 AS (SELECT DISTINCT 'hosts' AS list, 'domain' AS kind, host AS key, 'block' AS verdict, 8 AS o, 3 AS k FROM p UNION SELECT DISTINCT 'paths', 'prefix', host || '/' || seg, 'allow', 4, 1 FROM p),
l AS (SELECT * FROM (SELECT *, CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) AS n FROM l0) WHERE n % o < k),
c AS (SELECT list, kind, key, verdict, 'add' AS action, (n // 8) % 300 AS day FROM l UNION SELECT list, kind, key, verdict, 'remove', (n // 8) % 300 + 30 + (n // 64) % 200 FROM l UNION SELECT list, kind, key, verdict, 'add', (n // 8) % 300 + 300 + (n // 512) % 300 FROM l),
d AS (SELECT list, kind, key, verdict, day, max(action) AS action FROM c GROUP BY ALL),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, key, verdict ORDER BY day) AS until FROM d),
v AS (SELECT list, kind, key, verdict, DATE '2023-01-01' + CAST(day AS INT) AS since, DATE '2023-01-01' + CAST(until AS INT) AS until FROM i WHERE action = 'add'),
k AS (SELECT DISTINCT page_id, url, fetched, 'domain' AS kind, array_to_string(string_split(host, '.')[j:], '.') AS key FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS j FROM p)
  UNION SELECT DISTINCT page_id, url, fetched, 'prefix', host || '/' || array_to_string(segs[1:j], '/') FROM (SELECT *, unnest(range(0, len(segs) + 1)) AS j FROM p)),
h AS (SELECT k.page_id, k.url, k.fetched, v.*, row_number() OVER (PARTITION BY page_id, k.url, fetched ORDER BY length(v.key) DESC, v.kind DESC, (verdict = 'block') DESC, since DESC, list DESC) AS r FROM k JOIN v ON k.kind = v.kind AND k.key = v.key AND since <= fetched AND (until IS NULL OR fetched < until))
SELECT DISTINCT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(h.verdict, 'keep') AS verdict, h.list, h.key, CAST(h.since AS VARCHAR) AS since FROM p LEFT JOIN h ON p.page_id = h.page_id AND p.url = h.url AND h.r = 1
"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b AS positive, s.b AS negative, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, positive AS positive_id, CAST(r AS INT) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5
"""

LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, l, list_transform(l, lambda x: translate(trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM d),
e AS (SELECT doc_id, unnest(l) AS l, unnest(k) AS k, unnest(range(len(l))) AS i FROM k),
r AS (SELECT k, max(doc_id) AS keep FROM e WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
s AS (SELECT e.doc_id, l, i, r.k IS NOT NULL AND e.doc_id <> keep AS gone FROM e LEFT JOIN r ON e.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM s GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op4_decontaminate": CONTAMINATION_SQL, "op10_urls": URL_SQL, "op11_negatives": NEGATIVES_SQL, "op12_lines": LINES_SQL}
