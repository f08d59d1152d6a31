"""Small fixtures with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest

from peakfield.llm import decontaminate, language, lm, neardup, rules, segment, sharding, tokens, urls, warc
from peakfield.llm._common import is_held, scratch
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, stats string, language string, `near_id` long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def rows():
    near = BASE * 3
    edit = [*near[:30], "changed", *near[31:]]
    texts = [" ".join(near), " ".join(near), " ".join(edit), None, "", "   \n\t", "a", "a", "!!! ???", LONG, LONG + " end", "Bonjour le monde é", "x " * 40, "\n".join(["same line here"] * 5)]
    out = [(i, t, None if i == 3 else "en", "s", None, "st", "la", 5) for i, t in enumerate(texts)]
    return [*out, out[0], (None, " ".join(near), "en", None, 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def components(texts):
    sets = {}
    for i, t in texts:
        w = neardup.words(t or "")
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i, _ in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i, _ in texts}


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicate_classes(docs).collect()
    want = components([(r[0], r[1]) for r in rows() if r[0] is not None])
    assert len(got) == len(rows())
    assert all(r.class_id == want[r.id] for r in got if r.id is not None)
    assert sorted((r.class_id is None) for r in got if r.id is None) == [False, True]
    assert neardup.near_duplicate_classes(none).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*want.values(), None}


def test_near_duplicates_find_all_links_of_a_group(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    made = []
    for i in range(60):
        w = list(base)
        for j in rng.choice(120, 4, replace=False):
            w[j] = f"e{rng.integers(3)}"
        made.append((i, " ".join(w)))
    got = {r.id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == components(made)


def test_near_duplicates_with_a_repeated_line(spark):
    """Equal shingle sets but for a line that one text repeats: Jaccard 0.8 and more, however often it repeats."""
    made = []
    for i in range(40):
        base, line = [f"b{i}x{j}" for j in range(150)], [f"l{i}x{j}" for j in range(25)]
        made += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + line * 200))]
    got = {r.id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    want = components(made)
    assert len(set(want.values())) == 40 and got == want


def test_near_duplicates_of_null_and_shared_ids(spark):
    a, b = [f"a{j}" for j in range(100)], [f"b{j}" for j in range(100)]
    made = [(7, " ".join(a)), (7, " ".join(b)), (9, " ".join([*a, "end"])), (8, " ".join([*b, "end"])), (None, " ".join([*b, "other"]))]
    got = neardup.near_duplicate_classes(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.class_id) for r in got) == [(0, 7), (7, 7), (7, 7), (8, 7), (9, 7)]
    lone = spark.createDataFrame([(3, " ".join(a)), (None, " ".join([*a, "end"]))], "doc_id long, text string")
    assert {r.class_id for r in neardup.near_duplicate_classes(lone).collect()} == {3}


def test_signatures_estimate_probability_jaccard():
    a, b = {1: 3.0, 2: 1.0, 3: 1.0}, {1: 1.0, 2: 1.0, 4: 2.0}
    n = 4000
    sig = [neardup.signatures(np.zeros(len(x), np.int64), np.array(list(x), np.uint64) * np.uint64(7919), np.array(list(x.values())), 1, n)[0] for x in (a, b)]
    want = sum(1 / sum(max(a.get(d, 0) / a[i], b.get(d, 0) / b[i]) for d in {*a, *b}) for i in {*a} & {*b})
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_warc_round_trip(spark):
    made = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nInjected: y", ""), (5, "http://d/", "é\r\n\r\nWARC/1.1\r\n\r\n" * 50), (5, "http://d/", "é\r\n\r\nWARC/1.1\r\n\r\n" * 50), (None, "http://e/", "<p>x</p>"), (6, "http://f/", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in made], "page_id long, url string, html string, digest int")
    path = scratch(spark, "w")
    warc.write_warc(pages, path)
    rows = warc.captures(warc.read_warc(spark, path)).collect()
    got = {r.page_id: r for r in rows}
    assert sorted(str(r.page_id) for r in rows) == sorted(str(i) for i, *_ in made) and all(r.has_request for r in rows)
    names = [r.record_id for r in warc.read_warc(spark, path).select("record_id").collect()]
    assert len(names) == 3 * len(made) == len(set(names))
    for i, _, h in made:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), None: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 6: ("response", None)}
    path = scratch(spark, "w")
    warc.write_warc(pages.limit(0), path)
    assert warc.captures(warc.read_warc(spark, path)).count() == 0


def test_archives_of_others(spark, tmp_path):
    import gzip

    def record(kind, name, body, end=b"\r\n\r\n"):
        return f"WARC/1.0\r\nwarc-type:{kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + end

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    bodies = {"a": http + b"x" * 5_000_000, "b": http + b"WARC/1.0\r\n\r\n", "c": b"no head", "d": http}
    made = [record("response", n, b) for n, b in bodies.items()]
    (tmp_path / "members é %41.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    (tmp_path / "plain.warc").write_bytes(b"".join(made))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(made)[:-4]))
    got = sorted((r.record_id, r.payload_bytes, r.payload_sha1) for r in warc.read_warc(spark, f"file://{tmp_path}", "*.warc*").collect())
    payload = {n: b.removeprefix(http) for n, b in bodies.items()}
    assert got == sorted(3 * [(f"<{n}>", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for n, p in payload.items()])
    for wrong in (made[1][:-8], b"odd\r\n" + made[1]):
        folder = tmp_path / f"wrong{len(wrong)}"
        folder.mkdir()
        (folder / "x.warc").write_bytes(wrong)
        with pytest.raises(Exception, match="ends inside|no record"):
            warc.read_warc(spark, f"file://{folder}", "*.warc").count()


def test_tokens_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path, uri = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "t")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tokens.write_tokens(docs, uri, path)
    got = tokens.read_tokens(spark, uri).orderBy("start").collect()
    own = [r.id for r in got]
    assert own == sorted(own, key=lambda x: (x is not None, x or 0)) and len(got) == len(rows())
    place = 0
    for r in got:
        assert r.start == place and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        place += r.n_tokens
    want = sorted((tok.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in rows()))
    assert sorted(list(r.ids) for r in got) == want
    uri = scratch(spark, "t")
    tokens.write_tokens(none, uri, path)
    assert tokens.read_tokens(spark, uri).count() == 0


@pytest.mark.parametrize("text", ["a  b", "\n x", "x \n y  ", " <|endoftext|> hi", "it's 12 3é ü's  q", "\t a  b", "日本 語 ", "a\r\n\r\n b", " ", "a  b  c"])
def test_pieces_encode_like_the_whole(text):
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode([text], 0)[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_full_store_keeps_pieces_met_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 40)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = lambda t: [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]
    for text in (" ".join(f"often, often {i}y{i};" for i in range(25)), "x\nonce: 3y3;\n\n again,"):
        assert encoder.encode([text, ""], 0)[0].tolist() == [*whole(text), 0]
    assert "often," in encoder.known and "7y7;" not in encoder.known


def brute_hits(text, items, n=10):
    w = decontaminate.WORD.findall((text or "").translate(decontaminate.LOWER))
    hit, names = set(), set()
    for i, t in items:
        x = decontaminate.WORD.findall((t or "").translate(decontaminate.LOWER))
        for k in range(max(1, len(x) - n + 1) if x else 0):
            win = x[k : k + n]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit.update(range(a, a + len(win)))
                    names.add(i)
    return len(w), hit, sorted(names)


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(BASE[3:15])), (2, "Bonjour LE monde"), (3, None), (4, "???"), (5, " ".join(BASE[3:15])), (6, "w5x5 w6x6"), (7, "a a"), (None, "a")]
    bench = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, doc_id string")
    for block in (1 << 20, 100):
        got = decontaminate.with_contamination(docs, bench, block_bytes=block).collect()
        assert len(got) == len(rows())
        for r in got:
            n, hit, names = brute_hits(r.text, [x for x in items if x[0] is not None])
            c = r.contamination
            assert (c.n_words, {k for s in c.spans for k in range(s.start, s.end)}, list(c["items"])) == (n, hit, names)
    clean = decontaminate.with_contamination(docs, bench).select("doc_id", decontaminate.without_spans(F.col("text"), F.col("contamination.spans")).alias("t")).collect()
    assert all(not brute_hits(r.t, items[:1])[1] for r in clean)
    assert decontaminate.with_contamination(none, bench).count() == 0
    assert all(not r.contamination.spans for r in decontaminate.with_contamination(docs, bench.limit(0)).collect())


def test_index_finds_every_place():
    rng = np.random.default_rng(0)
    text = np.concatenate([[0], rng.integers(1, 4, 300), [0], rng.integers(1, 4, 200), [0]])
    index = decontaminate.FMIndex(text, 3)
    for size in (1, 2, 4):
        for p in itertools.product((1, 2, 3), repeat=size):
            one = decontaminate.Phrases(np.zeros(0), np.array([[0] * (5 - size) + list(p)]), np.array([size]), np.array([0, 0]), np.zeros(0))
            _, lo, hi = index.search(one)
            found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(lo) else []
            assert found == [i for i in range(len(text) - size + 1) if tuple(text[i : i + size]) == p]


def test_shards(spark, docs, none):
    got = sharding.shards_by_bytes(docs, 4).collect()
    assert len(got) == len(rows())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.id for r in order] == sorted([r.id for r in got], key=lambda x: (x is not None, x or 0))
    assert sharding.shards_by_bytes(none).count() == 0
    even = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 7 as int)) as text")
    size = [r.b for r in sharding.shards_by_bytes(even, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    # borders are within half a row of their targets, so a shard is within one largest row (7) of an equal share
    assert len(size) == 16 and all(abs(x - sum(size) / 16) <= 7 for x in size)


def test_segmentations(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(90, " lead  ▁ 日ü\x00😀\n")], "doc_id long, text string"))
    got = segment.with_segmentations(more, path, k=3).withColumn("back", segment.decoded(F.col("segmentations"), path)).collect()
    assert len(got) == len(rows()) + 1
    for r in got:
        if r.text is None:
            assert r.segmentations is None and r.back is None
        else:
            assert 1 <= len(r.segmentations) <= 3 and set(r.back) == {r.text}
            assert len({tuple(s.ids) for s in r.segmentations}) == len(r.segmentations)
            assert all(0 <= s.inclusion <= 1 for s in r.segmentations)
            assert [s.perturbed for s in r.segmentations] == sorted([s.perturbed for s in r.segmentations], reverse=True)
    assert segment.with_segmentations(none, path).count() == 0


def test_segmentations_with_a_small_lattice(monkeypatch):
    model = segment.pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.5)
    texts, keys = ["one two", "three 日ü😀 two\n", "one", " two  ▁ one"], np.arange(4, dtype=np.uint64)
    segment.Lattice.kept.clear()
    want = segment.sample(texts, keys, model, 3)
    monkeypatch.setattr(segment, "KEEP", 12)
    for _ in range(2):
        for i in (3, 0, 1, 2):
            got = segment.sample(texts[i : i + 1], keys[i : i + 1], model, 3)[0]
            assert [(a.tolist(), *x) for a, *x in got] == [(a.tolist(), *x) for a, *x in want[i]]
    grid = segment.Lattice.of(model)
    assert len(grid.at) < 6 and len(grid.rest) == len(grid.src)


def test_tasks_leave_no_lattice(spark):
    """A worker that waits for its next task holds the model alone."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = spark.createDataFrame([(i, f"one two {i}") for i in range(50)], "doc_id long, text string").repartition(2)
    segment.with_segmentations(own, path).write.format("noop").mode("overwrite").save()
    held = spark.range(8, numPartitions=4).mapInPandas(lambda parts: (p.assign(id=len(segment.Lattice.kept)) for p in parts), "id long")
    assert {r["id"] for r in held.collect()} == {0}


def test_decoding_of_bytes_that_are_no_text(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = segment.pieces(path, 1.5)
    space, odd, a = (int(model.byte[x]) for x in (32, 0xFF, 97))
    rows = [(1, [{"ids": [space, odd, a]}, {"ids": [space]}, {"ids": []}]), (2, None), (3, [])]
    got = spark.createDataFrame(rows, "i long, s array<struct<ids:array<int>>>").select("i", segment.decoded(F.col("s"), path).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [["\ufffda", "", ""], None, []]


def test_segmentations_are_a_sample_without_replacement():
    model = segment.pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.5)
    n = 8000
    drawn = segment.sample(["hea cat"] * n, np.arange(n, dtype=np.uint64), model, 2)
    p = {tuple(s[0].tolist()): np.exp(s[1]) for x in drawn for s in x}
    assert abs(sum(p.values()) - 1) < 1e-6
    for k, v in p.items():
        first = np.mean([tuple(x[0][0].tolist()) == k for x in drawn])
        second = np.mean([tuple(x[1][0].tolist()) == k for x in drawn])
        assert abs(first - v) < 0.02
        assert abs(second - sum(q * v / (1 - q) for j, q in p.items() if j != k)) < 0.03
    assert abs(np.mean([sum(np.exp(s[1]) / s[3] for s in x) for x in drawn]) - 1) < 0.05


def test_segmentations_use_pieces_of_several_spaces():
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = pb.ModelProto()
    with open(path, "rb") as f:
        own.ParseFromString(f.read())
    model = segment.pieces(path, 1.5)
    normal = {p.piece: i for i, p in enumerate(own.pieces) if p.type == 1}
    assert all(any(u == p for u in segment.UNITS.findall(p)) for p in normal if "\n" not in p)
    runs = {i: p for p, i in normal.items() if segment.MARK in p[1:]}
    assert len(runs) > 10
    text = "if a:\n        b  =   1" + " " * 40 + "\n  c" + " " * 16
    drawn = segment.sample([text] * 400, np.arange(400, dtype=np.uint64), model, 2)
    assert {int(i) for x in drawn for s in x for i in s[0]} & runs.keys()
    spelled = segment.spellings(path)
    assert all(b"".join(spelled[i] for i in s[0])[1:].decode() == text for x in drawn for s in x)
    # all ways through two marks and a letter, weighed by hand
    w = {p: (10 - own.pieces[i].score) ** -1.5 for p, i in normal.items()}
    ways = [[x for x in way] for way in (["▁", "▁", "a"], ["▁▁", "a"], ["▁", "▁a"], ["▁▁a"]) if all(x in w for x in way)]
    want = {tuple(normal[x] for x in way): np.prod([w[x] for x in way]) for way in ways}
    got = {tuple(s[0].tolist()): np.exp(s[1]) for s in segment.sample([" a"], np.zeros(1, np.uint64), model, 9)[0]}
    assert got.keys() == want.keys() and all(abs(got[k] - v / sum(want.values())) < 1e-9 for k, v in want.items())


def test_lm_gradients_are_those_of_the_loss():
    import pandas as pd

    m = lm.Model.start(pd.DataFrame({"word": [b"w%d" % i for i in range(40)], "n": range(80, 40, -1)}), np.ones(lm.SPELLINGS), np.ones(lm.SPELLINGS), 100, 50)
    r = np.random.default_rng(0)
    m.weights = {k: (v + r.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in m.weights.items()}
    x, y, h = r.integers(0, 40, (5, 3)), r.integers(0, 40, (5, 3)), r.normal(0, 0.3, (3, lm.HIDDEN))
    x[2, 1] = y[1, 1] = m.begin
    y[3, 2] = m.base + 3
    g, _, _ = lm.gradients(m, x, y, h)
    rows = dict(zip(g["x"][0].tolist(), g["x"][1], strict=True))
    assert set(rows) == set(x.ravel().tolist())
    for k, at in (("x", (int(x[0, 0]), 3)), ("x", (m.begin, 40)), ("h", (2, 5)), ("c", (1, 1)), ("c", (lm.HIDDEN, 1)), ("w", (0, 3, 2)), ("w", (0, lm.HIDDEN, 4))):
        old, own = m.weights[k][at], rows[at[0]][at[1]] if k == "x" else g[k][at]
        m.weights[k][at] = old + 1e-4
        hi = lm.gradients(m, x, y, h)[2]
        m.weights[k][at] = old - 1e-4
        lo = lm.gradients(m, x, y, h)[2]
        m.weights[k][at] = old
        assert abs((hi - lo) / 2e-4 - own) < 1e-4


def plain_score(m, counts, text):
    """log10 probability of a text, word by word, from the weights."""
    h, last, out, w = np.zeros(lm.HIDDEN), m.begin, 0.0, {k: v.astype(float) for k, v in m.weights.items()}
    place, sig = {x: i for i, x in enumerate(m.words)}, lambda v: 1 / (1 + np.exp(-v))
    for word in lm.words(text):
        a, b = w["x"][last], h @ w["h"]
        z, r = np.split(sig(a[: 2 * lm.HIDDEN] + b[: 2 * lm.HIDDEN]), 2)
        n = np.tanh(a[2 * lm.HIDDEN :] + r * b[2 * lm.HIDDEN :])
        h = (1 - z) * n + z * h
        logits = np.append(h, 1) @ w["c"]
        at = place.get(word, m.head)
        s = zlib.crc32(word[-2:]) % lm.SPELLINGS
        last = at if at < m.head else m.base + s
        c = last // lm.PER_CLASS if last < m.base else m.heads + s
        out += logits[c] - np.log(np.exp(logits).sum())
        if last < m.base:
            own = np.append(h, 1) @ w["w"][c]
            out += own[last % lm.PER_CLASS] - np.log(np.exp(own).sum())
        else:
            out += np.log((counts.get(word, 0) + 0.5) / (m.class_n[s] + 0.5 * (m.class_v[s] + 1)))
    return out / np.log(10)


def test_lm_scores(spark, none):
    """The query's own settings: base and score of every text against word-by-word sums, and held-out texts above the base."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.createDataFrame(rows(), DOC).select("doc_id", "text", "lang", "source", "n_chars"))
    train = lambda c: ~is_held(c, 5, 1)
    got = lm.scored(docs, train).collect()
    all_rows = docs.collect()
    assert len(got) == len(all_rows)
    n = {}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for r in all_rows:
        if not held(r.doc_id):
            for w in lm.words(r.text):
                n[w] = n.get(w, 0) + 1
    total, v = sum(n.values()), len(n)
    base = {(r.doc_id, round(sum(np.log10((n.get(w, 0) + 0.5) / (total + 0.5 * (v + 1))) for w in lm.words(r.text)), 4)) for r in all_rows}
    assert {(r.id, round(r.base_score, 4)) for r in got} == base
    assert {r.train_tokens for r in got} == {total}
    assert {(r.id, r.n_tokens, r.n_known) for r in got} == {(r.doc_id, len(lm.words(r.text)), sum(w in n for w in lm.words(r.text))) for r in all_rows}
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [r for r in lm.scored(real, train).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert np.mean([r.score > r.base_score for r in out]) > 0.8
    assert lm.scored(none, train).count() == 0


def test_lm_score_is_the_models_probability(spark):
    made = [(i, t) for i, t in enumerate(["a b c a b", "a a zz", "", None, "q " * 300, "b c a"])] + [(9, "never seen"), (None, "a b")]
    docs = spark.createDataFrame(made, "id long, text string")
    m, table = lm.started(docs.where("id is null or id < 6"))
    m = lm.trained(m, lm.encoded(docs, m))
    n = {bytes(r.word): r.n for r in table.collect()}
    m.words, m.n = m.words[:3], m.n[:3]  # so that some words are known by their count alone
    left = [w for w in n if w not in m.words]
    m.class_n, m.class_v = (np.bincount(lm.spelling(left), x, lm.SPELLINGS) for x in ([n[w] for w in left], [1] * len(left)))
    for r in lm.score(lm.encoded(docs, m), m, table).collect():
        text = next(t for i, t in made if i == r.id)
        assert abs(r.score - plain_score(m, n, text)) < 1e-3 * (1 + abs(r.score))


def test_lm_scores_do_not_hang_on_partitions(spark, monkeypatch):
    """Many copies and rounds on 1, 5 and 16 partitions: the same scores; and every text in one copy of one round."""
    monkeypatch.setattr(lm, "COPY", 1_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    train = lambda c: ~is_held(c, 5, 1)
    rounds, copies = lm.schedule(docs.where(train(F.col("doc_id"))).select(F.sum(F.size(F.split("text", r"[ \t-\r]+")))).first()[0])
    assert rounds > lm.LEAST_ROUNDS and copies > 2
    out = [sorted((r.id, r.score) for r in lm.scored(docs.repartition(n), train).collect()) for n in (1, 5, 16)]
    for other in out[1:]:
        assert [i for i, _ in other] == [i for i, _ in out[0]]
        assert np.allclose([s for _, s in other], [s for _, s in out[0]], rtol=1e-4)
    assert lm.schedule(0) == (lm.LEAST_ROUNDS, 1)
    assert all(lm.schedule(t)[0] * lm.schedule(t)[1] * lm.COPY >= t for t in (1, 999, 1_001, 10**6, 10**12))


def test_lm_trains_on_every_document(spark):
    """Each document alone changes the weights, whatever slice its id falls into."""
    for i in range(4):
        one = spark.createDataFrame([(i, f"v{i} one two three four five")], "id long, text string")
        m, _ = lm.started(one)
        assert not np.abs(m.weights["c"][: lm.HIDDEN]).max()
        m = lm.trained(m, lm.encoded(one, m))
        assert np.abs(m.weights["c"][: lm.HIDDEN]).max() > 0


def test_lm_head_grows_with_the_counts():
    import pandas as pd

    table = pd.DataFrame({"word": [b"w%d" % i for i in range(9000)], "n": range(9000, 0, -1)})
    m = lm.Model.start(table, np.ones(lm.SPELLINGS), np.ones(lm.SPELLINGS), 10**8, 10**7)
    assert m.head == 6272 and m.weights["x"].shape[0] == 6272 + lm.SPELLINGS + 1


def brute_counts(t):
    import re

    w = [x for x in re.split("[ \t-\r]+", t or "") if x]
    seen, cover = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(k for i in at for k in range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if re.search("[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, docs, none):
    made, stats = rules.features(docs)
    got = made.select("text", *[stats[k].alias(k) for k in rules.COUNTS]).collect()
    assert sorted((r.text or "", *r[1:]) for r in got) == sorted((t or "", *brute_counts(t)) for _, t, *_ in rows())
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made, stats = rules.features(real)
    for r in made.select("text", *[stats[k].alias(k) for k in rules.COUNTS]).collect():
        assert tuple(r[1:]) == brute_counts(r.text)
    assert rules.features(none)[0].count() == 0


def test_quality_counts_of_windows_with_near_hashes(spark):
    """Two windows whose hashes agree in their upper 40 bits, one of them twice."""
    a, b = "u69862 a b c d", "u5341617 a b c d"
    text = f"{a} x1 x2 x3 x4 x5 {b} y1 y2 y3 y4 y5 {a}"
    many = " ".join([a, *[f"f{i}" for i in range(70_000)], a])
    made, stats = rules.features(spark.createDataFrame([(text, 1), (many, 2)], "text string, q_n_words int"))
    got = made.select("text", "q_n_words", *[stats[k].alias(k) for k in rules.COUNTS]).collect()
    assert all(tuple(r[2:]) == brute_counts(r.text) for r in got) and {r.n_repeat_words for r in got} == {10} and {r.q_n_words for r in got} == {1, 2}


def test_quality_rules_on_labels_not_seen(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learned = rules.fit(rules.labelled(docs, labels.where("doc_id % 2 = 0"), 20_000))
    made, stats = rules.features(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"))
    r = made.where(~rules.base_failed(stats)).groupBy("quality").agg(F.avg((learned.verdict(stats) > 0).cast("int")).alias("out")).collect()
    out = {x.quality: x.out for x in r}
    assert out[0] > 0.8 and out[1] < 0.02


def test_quality_rules_without_labels(spark, docs, none):
    labels = spark.createDataFrame([(0, None), (None, 1), (1, 1), (1, 1)], "doc_id long, quality int")
    assert rules.fit(rules.labelled(docs, labels, 10)).rules == []
    assert rules.fit(rules.labelled(none, labels, 10)).rules == []


def test_language(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = is_held(F.col("doc_id"), 4, 2)
    model = language.LanguageFilters.fit(real.where(~held))
    found = language.with_language(real.where(held), model)
    assert found.where("lang = language.lang_pred").count() > 0.97 * found.count()
    got = {r.doc_id: r.language_ for r in language.with_language(docs, model).where("doc_id is not null").collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 8}
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language.LanguageFilters.fit(none)
    assert {r.language_.lang_pred for r in language.with_language(docs, empty).collect()} == {"und"}
    assert language.with_language(none, model).count() == 0


def test_language_of_one_training_row(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    held = is_held(F.col("doc_id"), 4, 2)
    for name in [r.lang for r in real.select("lang").distinct().orderBy("lang").collect()]:
        few = real.where(~held & (F.col("lang") == name) & (F.length("text") > 200)).orderBy("doc_id").limit(1)
        model = language.LanguageFilters.fit(real.where(~held & (F.col("lang") != name)).union(few))
        found = language.with_language(real.where(held & (F.length("text") > 200)), model).withColumn("good", F.col("lang") == F.col("language.lang_pred")).select("lang", "good", "language.coverage").toPandas()
        assert found.groupby("lang")["good"].mean().min() > 0.9 and found["coverage"].min() > 0.1


def test_language_filters_hold_all_their_grams():
    g, _ = language.grams(["hello wonderful world"])
    slots = np.zeros((1, 64 * 64), np.uint64)
    for at in language.LanguageFilters.positions(g, slots.shape[1], 4):
        slots[0, at] |= np.uint64(2)
    m = language.LanguageFilters(["a", "b"], slots, 4, np.zeros(2), 0)
    r = m.predict(["hello world", None, "123"])
    assert r["lang_pred"].tolist() == ["b", "und", "und"] and r["coverage"][0] == 1


def test_urls(spark):
    from datetime import date

    d = lambda m, x=1: date(2024, m, x)
    changes = [("l", "domain", "bad.com", "block", "add", d(1)), ("l", "domain", "bad.com", "block", "remove", d(3)), ("l", "domain", "bad.com", "block", "add", d(6)), ("l", "domain", "bad.com", "block", "add", d(6)), ("m", "prefix", "www.bad.com/ok", "allow", "add", d(2)), ("m", "domain", "tie.org", "block", "add", d(5)), ("m", "domain", "tie.org", "block", "remove", d(5)), ("m", "domain", None, "block", "add", d(1))]
    caps = [(1, "http://www.bad.com/x", d(2)), (2, "http://www.bad.com/x", d(3)), (3, "http://bad.com", d(7)), (4, "https://www.bad.com/ok/page?q#f", d(2, 9)), (5, "http://notbad.com/", d(2)), (6, None, d(2)), (7, "http://bad.com/", None), (8, "http://tie.org/", d(6)), (1, "http://www.bad.com/x", d(2)), (9, "nonsense", d(2)), (10, "http://www.bad.com/ok", d(1, 9))]
    cols = "list string, kind string, key string, verdict string, action string, at date"
    got = urls.judge(spark.createDataFrame(caps, "id long, url string, fetched date"), spark.createDataFrame(changes, cols)).collect()
    want = {1: "block", 2: "keep", 3: "block", 4: "allow", 5: "keep", 6: "keep", 7: "keep", 8: "keep", 9: "keep", 10: "block"}
    assert len(got) == 10 and {r.id: r.verdict for r in got} == want
    none = spark.createDataFrame([], cols)
    assert {r.verdict for r in urls.judge(spark.createDataFrame(caps, "id long, url string, fetched date"), none).collect()} == {"keep"}
    assert urls.judge(spark.createDataFrame([], "id long, url string, fetched date"), spark.createDataFrame(changes, cols)).count() == 0


def test_pipeline_stages(spark, none):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{d}/documents.parquet")
    docs = real.union(spark.createDataFrame(rows(), DOC).select(*real.columns))
    for name, stage in p.STAGES:
        empty = stage(spark, docs.limit(0), d)
        out = p.written(stage(spark, docs, d), "stage")
        assert empty.count() == 0
        if name != p.STAGES[-1][0]:
            assert out.columns == real.columns
            docs = out
    assert 100 < out.count() <= docs.count()
