"""Findings of CHECK_r03.txt: what would have failed before the change."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa

from peakfield.llm import lm, neardup, segment


def test_rare_rounds_read_prefixes_once(spark, monkeypatch):
    """The self-join of a round read and joined the prefixes for each of its sides (finding 1): the driver keeps account of every one."""
    plans = []

    def seen(df, name, *a, real=neardup.written, **k):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("/prefixes-")))
        return real(df, name, *a, **k)

    monkeypatch.setattr(neardup, "written", seen)
    limit = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        body = [f"w{i}" for i in range(60)]
        texts = [" ".join([*body[:i], f"edit{i}", *body[i + 1 :]]) for i in range(0, 60, 7)] + [" ".join(f"v{i}" for i in range(30))]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.id: r.class_id for r in neardup.near_duplicate_classes(docs, star_rounds=0).collect()}
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", limit)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in range(len(texts)) if len(a & sets[j]) >= 0.8 * len(a | sets[j])) for a in sets]
    assert got == dict(enumerate(least))
    assert max(n for _, n in plans) == 1


def test_new_units_are_numbered_in_one_pass():
    """A new unit was looked up, made distinct, put in and looked up again (finding 2)."""
    hashed = []

    class Unit(str):
        def __hash__(self):
            hashed.append(str(self))
            return super().__hash__()

    grid = segment.Lattice(segment.pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.5))
    units = [Unit(x) for x in ("▁one", "▁two", "▁one", "▁three")]
    assert grid.codes(units).tolist() == [0, 1, 0, 2]
    assert len(hashed) <= 7  # one for each unit, and one more to put in each new one
    assert grid.codes(["▁two", "▁four", "▁one"]).tolist() == [1, 3, 0]
    plain = segment.Lattice(grid.model)
    plain.codes(["▁one", "▁two", "▁three", "▁four"])
    assert np.array_equal(grid.start, plain.start) and sorted(zip(grid.src, grid.to, grid.ids, strict=True)) == sorted(zip(plain.src, plain.to, plain.ids, strict=True))


def test_words_are_split_and_spelled_without_python(spark):
    """op7_lm took 1145 CPU seconds a GB: each word was a Python object, also in the join of the rare ones."""
    every = "".join(map(chr, range(0x250)))
    texts = ["", " ", None, "A b\x0b\x1cC\n\x1f d ", "\t", every, "\u0130\u00c0\u2003x y", "", "end"]
    flat, lens = lm.split(pa.array(["cut", *texts])[1:])
    ends = np.cumsum(lens).tolist()
    assert [flat.to_pylist()[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [lm.words(t)[:-1] for t in texts]
    none, lens = lm.split(pa.array([None, ""], pa.string()))
    assert len(none) == 0 and lens.tolist() == [0, 0]
    names = [b"a", b"\n", b"ab", b"abc", "\u00e9".encode(), b"\xff"]
    want = [zlib.crc32(w[-2:]) % lm.SPELLINGS for w in names]
    assert lm.spelling(names).tolist() == want and lm.spelling(pa.array(names, pa.binary())[2:]).tolist() == want[2:]
    df = spark.createDataFrame([(w,) for w in names], "word binary").repartition(1).select("word", lm.spelled("word").alias("s"))
    assert {bytes(r.word): r.s for r in df.collect()} == dict(zip(names, want, strict=True))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    brute = [w for t in texts for w in lm.words(t)]
    assert {bytes(r.word): r.n for r in lm.counts(docs).collect()} == {w: brute.count(w) for w in brute}


def test_windows_are_the_same_in_pieces(monkeypatch):
    """Output layers of a window go piece by piece, each with the classes in it (op7_lm): the pieces' size changes nothing."""
    m = lm.Model.start(pd.DataFrame({"word": [b"w%d" % i for i in range(600)], "n": range(700, 100, -1)}), np.ones(lm.SPELLINGS), np.ones(lm.SPELLINGS), 1000, 650)
    r = np.random.default_rng(0)
    m.weights = {k: (v + r.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in m.weights.items()}
    inputs = np.array([*range(600), m.base, m.base + 7, m.begin])
    x, y, h = r.choice(inputs, (7, 11)), r.choice(inputs, (7, 11)), r.normal(0, 0.3, (11, lm.HIDDEN))
    nets = [r.choice(inputs[:-1], n) for n in (1, 40, 7, 40)]
    out = []
    for rows in (4, 6, 1 << 10):
        monkeypatch.setattr(lm, "ROWS", rows)
        out.append((lm.gradients(m, x, y, h), lm.likelihood(m, nets), lm.likelihood(m, nets, held=5)))
    for (g, state, loss), *scores in out[:-1]:
        more, last, least = out[-1][0]
        assert abs(loss - least) < 1e-9 and np.allclose(state, last)
        assert all(np.allclose(g[k], more[k]) for k in ("c", "w", "h")) and np.array_equal(g["x"][0], more["x"][0]) and np.allclose(g["x"][1], more["x"][1])
        assert all(np.allclose(a, b, rtol=1e-6) for a, b in zip(scores, out[-1][1:], strict=True))
