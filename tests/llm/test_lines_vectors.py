"""Line dedup, whitening and hard negatives on small fixtures against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from peakfield.llm import linededup, negatives, queries, whitening
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
LINE = "A line that is long enough to count as a passage, number "


def text_rows():
    shared = [LINE + str(i) for i in range(8)]
    out = [(i, "\n".join([f"own {i}", *shared[: i % 9], "", "  \t" + shared[0].upper() + "\r"])) for i in range(20)]
    out += [(20, None), (21, ""), (22, "\n\n"), (23, "\n".join([shared[1]] * 6)), (24, "\n".join([shared[7], shared[7], "x"])), (25, "\n".join(f"{LINE}{k} of a very long text" for k in range(30_000)) + "\n" + shared[2])]
    out += [(30 + i, "é" * 39 + "\n" + "é" * 40 + " end\n" + "y" * 40 + "\x85") for i in range(5)] + [(30 + i, "y" * 40) for i in (7, 8, 9, 10)]
    return out


def brute_lines(rows, docs=5, chars=40):
    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower().decode()
    held, own = defaultdict(list), [(i, (t or "").split("\n")) for i, t in rows]
    for i, lines in own:
        for k in {key(x) for x in lines}:
            held[k].append(-math.inf if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= chars and len(v) >= docs}
    out = []
    for i, lines in own:
        stay = [x for x in lines if gone.get(key(x), n := -math.inf if i is None else i) == n]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("more", [[], [(3, None), (None, LINE + "1"), (None, LINE + "1\nx"), (5, "\n".join([LINE + "0"] * 2))]])
def test_lines(spark, more):
    rows = [*text_rows(), *more]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, raw string, kept string, `lines` int").repartition(7)
    got = [(r.id, r.n_lines, r.n_dropped, r.kept) for r in linededup.without_repeated_lines(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows)))
    assert linededup.without_repeated_lines(df.where("false")).count() == 0
    alone = linededup.without_repeated_lines(spark.createDataFrame([(LINE + str(k % 2), None, k) for k in range(9)], "t string, id string, k long"), "k", "t")
    assert {(r.id, r.kept) for r in alone.collect()} == {(k, LINE + str(k % 2) if k % 2 or k == 8 else "") for k in range(9)}


def test_a_full_filter_only_costs_more(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MOST_CELLS", 1 << 16)
    monkeypatch.setattr(linededup, "HELD", 50)
    monkeypatch.setattr(linededup, "BROADCAST", -1)
    rows = [*text_rows(), *[(100 + i, "\n".join(f"{LINE}{i} {k}" for k in range(3000))) for i in range(20)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.id, r.n_lines, r.n_dropped, r.kept) for r in linededup.without_repeated_lines(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows)))


def vector_rows(n=120, d=6, seed=3, scale=0.3):
    r = np.random.default_rng(seed)
    out = [(i, (r.normal(size=d) * scale * np.arange(1, d + 1)).tolist(), int(i % 3)) for i in range(n)]
    out += [(n, None, 1), (n + 1, [1.0] * (d - 1) + [None], 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] + [0.0] * (d - 1), 1), (n + 4, out[0][1], None), (n + 5, [0.5, -0.5], 2), (None, out[1][1], 1)]
    out += [(n + 10 + i, out[5][1], 0) for i in range(40)] + [out[7], out[7]]
    return out


VECTORS = "vec_id long, embedding array<double>, label int"


def clean(rows):
    d = max(len(v) for _, v, _ in rows if v)
    ok = [(i, v, k) for i, v, k in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(256 * c) for c in v] + [0] * (d - len(v)), k) for i, v, k in ok]


def brute_whitened(rows):
    own = clean(rows)
    fit = [list(v) for v in sorted({tuple(v) for _, v, _ in own})]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    return [(i, sum((n * a - b) ** 2 for a, b in zip(v, s)), [(np.array([n * a - b for a, b in zip(v, s)], float) / n) @ u[:, k] / math.sqrt(e[k]) for k in range(4)]) for i, v, _ in own], n, e / np.trace(y.T @ y / n)


def check_whitened(got, rows):
    want, n, share = brute_whitened(rows)
    by = defaultdict(list)
    for r in got:
        by[r.id if "id" in r else r.vec_id].append(r)
    sign = {}
    assert len(got) == 4 * len(want)
    for i, far, w in want:
        for k in range(4):
            own = [r for r in by[i] if r.component == k + 1]
            assert own and all(r.n == n and abs(r.explained / share[k] - 1) < 1e-6 and r.identity_error < 1e-9 for r in own)
            assert any(r.deviation == far for r in own)
            if abs(w[k]) > 1e-3:
                sign.setdefault(k, round(own[0].whitened / w[k]))
            assert any(abs(r.whitened - sign.get(k, 1) * w[k]) < 1e-6 for r in own)


def test_whitened(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], VECTORS + ", x int, w0 string").repartition(5)
    check_whitened(whitening.whitened(df).collect(), rows)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    assert whitening.whitened(one).count() == 0 and whitening.whitened(df.where("false")).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 0) for k in range(9)], VECTORS)
    got = whitening.whitened(line).collect()
    assert len(got) == 9 and all(r.component == 1 and abs(r.explained - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    far = spark.createDataFrame([(k, [1e9 + k % 5, 1e9 - k % 3, 7.0 + k % 2, -1e9 + k, 3.0], 0) for k in range(90)], VECTORS)
    check_whitened(whitening.whitened(far).collect(), [(k, [1e9 + k % 5, 1e9 - k % 3, 7.0 + k % 2, -1e9 + k, 3.0], 0) for k in range(90)])


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_whitened(queries.op13_whitening(spark, DATA).collect(), rows)


def test_spectra(spark):
    r = np.random.default_rng(5)
    for values in ([1.0] * 12, [5, 5, 5, 1, 1, 1, 1, 0.5], [3, 2, 1e-3, 1e-9, 1e-15], [1.0], [7, 7 - 1e-9, 7 - 2e-9, 1, 1 - 1e-7, 0.2, 0.1]):
        turn = np.linalg.qr(r.normal(size=(len(values), len(values))))[0]
        v = turn @ np.diag(values) @ turn.T
        v = (v + v.T) / 2
        value, vectors = whitening.leading(spark, v, 4)
        assert len(value) == min(4, sum(x > 1e-13 * sum(values) for x in values)) and np.allclose(value, sorted(values)[::-1][: len(value)], rtol=1e-9, atol=1e-14)
        assert np.allclose(vectors.T @ vectors, np.eye(len(value)), atol=1e-12) and np.abs(v @ vectors - vectors * value).max() < 1e-12 * sum(values)
        for shift in r.uniform(0, 2, 5):
            assert whitening.above(v, shift) == (np.linalg.eigvalsh(v) > shift).sum()


def brute_negatives(rows, every):
    own = [(i, v, (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in clean([r for r in rows if r[0] is not None and r[2] is not None])]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, k in {(i, tuple(v), k) for i, v, k in own if i % every == 0}:
        positives = sorted((-dot(v, w), j) for j, w, m in own if m == k and j != i)[:5]
        for p, j in positives:
            found = sorted((-dot(v, w), q) for q, w, m in own if m != k and 80 * -p <= 100 * dot(v, w) <= 100 * -p)[:5]
            out += [(i, j, r + 1, q, -p, -s) for r, (s, q) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 3e5])
def test_negatives(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 11)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "TILE", 3)
    rows = vector_rows(scale=scale)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS + ", id int, x int").repartition(6)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, lambda c: c % 10 == 0, label)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30
    assert negatives.hard_negatives(df.where("false"), lambda c: c % 10 == 0, label).count() == 0
    assert negatives.hard_negatives(df.where("label = 0"), lambda c: c % 10 == 0, label).count() >= 0


@pytest.mark.parametrize("lo, hi, d", [(-256, 256, 64), (-3, 0, 5), (0, 0, 2), (-(1 << 20), 1 << 20, 64), (-(1 << 30), 1 << 30, 3)])
def test_packing(lo, hi, d):
    r = np.random.default_rng(1)
    a, x = r.integers(lo, hi + 1, (7, d)), r.integers(lo, hi + 1, (13, d))
    p = negatives.Packing(d, lo, hi)
    kind = object if p.kind is object else np.int64
    assert (p.scores(a, p.packed(x), x.astype(kind).sum(1)) == a.astype(object) @ x.astype(object).T).all()
    assert hi == 0 or p.fields >= 1
    assert (lo, hi, d) != (-256, 256, 64) or p.fields == 2


def test_digests(spark):
    got = queries.op12_lines(spark, DATA).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_lines(rows))


def test_few_pairs_are_left_of_a_group_of_edited_copies(spark, monkeypatch):
    import itertools
    import random

    from peakfield.llm import neardup

    counts, own = [], neardup.rare_pairs

    def counted(*args):
        out = own(*args)
        counts.append(out.distinct().count())
        return out

    monkeypatch.setattr(neardup, "rare_pairs", counted)
    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(200):
        t = list(base)
        for _ in range(r.randrange(13 if i % 4 == 0 else 7)):
            t[r.randrange(300)] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    got = {x.id: x.class_id for x in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, up = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in rows], list(range(200))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(200), 2):
        n = len(sets[a] & sets[b])
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in range(200)} and sum(counts) < 400


def test_most_frequent_words(spark):
    from peakfield.llm import lm

    once = spark.range(30_000).selectExpr("cast(concat('w', id) as binary) as word", "1L as n")
    assert 9_000 < lm.most_frequent(once, 10_000).count() <= 10_000
    some = once.union(spark.range(50).selectExpr("cast(concat('f', id) as binary)", "1000 + id")).repartition(3)
    got = lm.most_frequent(some, 60).collect()
    assert 50 <= len(got) <= 60 and sum(r.n >= 1000 for r in got) == 50
    assert lm.most_frequent(some, 40_000).count() == 30_050 and lm.most_frequent(once.where("false"), 5).count() == 0
    top = lm.most_frequent(some.where("n >= 1000"), 10).collect()
    assert 5 <= len(top) <= 10 and min(r.n for r in top) >= 1030
    docs = spark.createDataFrame([(i, f"only{i} here{i}") for i in range(300)], "doc_id long, text string")
    model, _ = lm.started(docs.select("text"), 200)
    assert 150 < len(model.words) <= 200 and model.n[0] == 300 and set(model.n[1:]) == {1}


def test_urls_with_a_full_filter_and_long_urls(spark, monkeypatch):
    from peakfield.llm import urls

    pages = spark.createDataFrame([(i, f"https://h{i % 40}.example.com/s{i % 7}/p{i}/" + "x" * (200_000 if i == 3 else 3), "c", 1) for i in range(400)], "page_id long, url string, list string, key int")
    own = pages.select("page_id", "url")
    plain = sorted(map(str, urls.judge(urls.fetch_times(own), urls.listed(own)).collect()))
    assert len(plain) == 400 and sum("block" in x for x in plain) > 5
    monkeypatch.setattr(urls, "LEAST_CELLS", 2)
    monkeypatch.setattr(urls, "MOST_CELLS", 2)
    assert sorted(map(str, urls.judge(urls.fetch_times(own), urls.listed(own)).collect())) == plain
    assert all("'keep'" in str(r) for r in urls.judge(urls.fetch_times(own), urls.listed(own).where("false")).collect())
