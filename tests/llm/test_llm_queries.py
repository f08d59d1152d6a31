"""The registered queries themselves, with production parameters, against SQL or brute force over the smallest tables."""

import glob
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_llm import brute_counts, components

from peakfield.llm import queries
from peakfield.llm._common import is_held
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_neardup_classes(spark, texts):
    got = {r.doc_id: r.class_id for r in queries.op1_neardup(spark, DATA).collect()}
    assert got == components(sorted(texts.items()))


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want, start = [], 0
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_tokens(spark, DATA).collect()) == want


def test_shards(spark, texts):
    got = queries.op5_shards(spark, DATA).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, size[i], zlib.crc32((t or "").encode())) for i, t in texts.items()}
    total, before, places = sum(size.values()), 0, {}
    for i in sorted(texts):
        shard = min(15, (2 * before + size[i]) * 16 // (2 * total))
        places.setdefault(shard, []).append(i)
        before += size[i]
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(i, s, k) for s, own in places.items() for k, i in enumerate(own)}


def test_segmentations(spark, texts):
    for r in queries.op6_segmentations(spark, DATA).collect():
        assert r.round_trip is (None if texts[r.doc_id] is None else True)
        assert texts[r.doc_id] is None or r.n_samples == 2


def test_quality(spark, texts):
    got = queries.op8_quality(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        own = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = queries.op9_language(spark, DATA).join(docs, "doc_id")
    assert found.where(found["held_out"] != is_held(F.col("doc_id"), 4, 2)).count() == 0
    out = found.where("held_out and lang is not null and lang_pred != 'und'")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count() > 0


def test_pipeline(spark, texts):
    got = queries.queries()["pipeline"](spark, DATA).collect()
    kept = {r.doc_id for r in got}
    assert len(kept) == len(got) and kept < set(texts)
    group = components(sorted((i, texts[i]) for i in kept))
    assert all(group[i] == i for i in kept) and all(len(r.segmentations) == 2 for r in got)


def test_labels_with_the_lowest_hashes(spark):
    from pyspark.sql import functions as F

    from peakfield.llm import rules

    # a third of the rows have one id, and one row has none
    rows = spark.createDataFrame([(None if i == 5 else 7 if i % 3 == 0 else i, i % 2 == 0) for i in range(3000)], "k long, bad boolean").repartition(9)
    for bound in (1, 40, 1500, 2999, 5000):
        want = rows.orderBy(F.xxhash64("k"), "k", "bad").limit(bound)
        assert sorted(map(str, rules.lowest(rows, "k", bound).collect())) == sorted(map(str, want.collect()))
    assert rules.lowest(rows.where("false"), "k", 10).count() == 0
