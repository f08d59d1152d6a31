"""Sizes, resizing, fills and text tables on small cases against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield.operators import arrays, maps, peaks, resizing, search, sizing, volumes
from peakfield.sources import npy, tables
from peakfield.sources.files import shared_folder

f32 = np.float32


def factors(n):
    out, p = set(), 2
    while n > 1:
        while n % p == 0:
            out.add(p)
            n //= p
        p += 1
    return out


def upper(n, limit):
    n = max(2, n)
    if limit == 2:
        return 1 << (n - 1).bit_length()
    n += n % 2
    while not factors(n) <= {2, 3, 5, 7, 11, 13} - set(range(limit + 1, 20)):
        n += 2
    return n


def nice(n):
    for limit in (2, 3, 5, 7, 9, 13):
        if upper(n, limit) - n < n * 0.1:
            return upper(n, limit)
    return upper(n, 13)


def binned(n, factor):
    return int(f32(f32(n) / f32(factor)) + f32(0.5))


def realized(wanted, n):
    near = max(2, binned(n, wanted))
    return f32(f32(n) / f32(near + near % 2))


def scan(wanted, square, pixel, h, w):
    for step in (1, -1):
        best, k = None, 0
        while square + k * step >= 2:
            n = square + k * step
            factor = realized(wanted, n)
            size, error = binned(n, factor), abs(float(f32(wanted)) - float(factor))
            if best is None or error < best[0]:
                best = (error, factor, size)
            if best[0] * float(f32(pixel)) < 0.00005 or size > 4096:
                break
            k += 1
        if best[2] <= h and best[2] <= w:
            break
    return best[1], best[2], k * step


SHAPES = [(320, 320, 40, 1.5, 3.0), (320, 320, 40, 1.5, 2.0), (333, 500, 41, 1.07, 4.3), (1025, 700, 64, 1.0, 2.0), (97, 97, 16, 1.3, 3.3), (2000, 2100, 100, 0.83, 5.0), (64, 900, 20, 1.0, 3.1), (4096, 4000, 200, 1.06, 2.2)]


@pytest.fixture(scope="module")
def plans(spark):
    rows = [(i, *s) for i, s in enumerate(SHAPES)] + [(90, *SHAPES[0]), (91, 300, 300, None, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "i long, height int, width int, template int, pixel_size double, resolution double")
    return {r.i: r.plan for r in sizing.planned(df, statistics="precompiled").collect()}


def test_plans(plans):
    assert len(plans) == len(SHAPES) + 2 and plans[90] == plans[0]
    for i, (h, w, t, pixel, wanted) in enumerate(SHAPES):
        p, pix = plans[i], f32(pixel)
        res = max(f32(wanted), f32(2) * pix)
        if max(h, w) > 1024:
            res = max(f32(f32(2) * pix * f32(f32(n) / f32(1024))) for n in (h, w))
        again = not math.isclose(float(res), float(f32(2) * pix), rel_tol=1e-6, abs_tol=1e-6)
        assert (p.resampled, p.max_search_size_applied) == (again, max(h, w) > 1024) and abs(p.resolution - res) < 1e-5
        square = max(h, w)
        factor, size, offset = scan(f32(f32(res / pix) / f32(2)), square, pixel, h, w) if again else (f32(1), None, 0)
        crop, pre = ((size, size), (square + offset,) * 2) if again else ((h, w), (h, w))
        found = (nice(crop[0]), nice(crop[1]))
        assert (abs(p.binning - factor) < 1e-6, p.bin_offset, (p.crop_h, p.crop_w), (p.pre_h, p.pre_w), (p.search_h, p.search_w)) == (True, offset, crop, pre, found)
        for a, n, c, s, r in (("h", h, crop[0], found[0], pre[0]), ("w", w, crop[1], found[1], pre[1])):
            total = r - n if again else s - c
            before = total // 2 + (total % 2 if n % 2 else 0)
            after = total - before
            inner = ((s - c) // 2, (s - c) // 2) if again else (before, after)
            if again:
                before, after = math.ceil(before / float(factor)) + inner[0], math.ceil(after / float(factor)) + inner[1]
            assert (p[f"before_{a}"], p[f"after_{a}"], p[f"fft_before_{a}"], p[f"fft_after_{a}"]) == (before, after, *inner)
            assert (p[f"roi_{a}"], p[f"stats_{a}"]) == (s - before - after, s - before - after - sum(inner))
        assert p.template_crop == binned(t, factor) and p.template_search == upper(p.template_crop, 5) and p.resized == (not again and found != (h, w))
        assert p.error is None or min(p.roi_h, p.roi_w, p.stats_h, p.stats_w) <= 0


def test_rotation_and_modes(spark):
    df = spark.createDataFrame([(512, 300, 20, 1.0, 2.0)], "height int, width int, template int, pixel_size double, resolution double")
    p = sizing.planned(df, rotate=True, size_mode="exact", threshold="full").first().plan
    assert p.rotated and (p.search_h, p.search_w) == (300, 512) and p.threshold_pixels == 512 * 300
    assert sizing.planned(df, size_mode="power2").first().plan.search_w == 512
    assert sizing.planned(df.where("false")).count() == 0
    p = sizing.planned(df, statistics="precompiled", border=200).first().plan
    assert p.error == "statistics have no area"


def test_sizes(spark):
    n = [1, 2, 3, 11, 97, 121, 509, 1331, 4099, 99_999, 1 << 19]
    got = spark.createDataFrame([(k,) for k in n], "n int").select("n", sizing.nice_size(F.col("n")).alias("v"), sizing.power_of_two(F.col("n")).alias("p")).collect()
    assert [(r.v, r.p) for r in got] == [(nice(k), 1 << (k - 1).bit_length()) for k in n]
    with pytest.raises(Exception, match="beyond all"):
        spark.range(1).select(sizing.nice_size(F.lit(1 << 21))).collect()


def plan(spark, **v):
    base = {"error": None, "original_h": 9, "original_w": 12, "pre_h": 12, "pre_w": 12, "crop_h": 8, "crop_w": 8, "search_h": 8, "search_w": 8, "lower_h": 1, "lower_w": 0, "upper_h": 6, "upper_w": 7, "before_h": 1, "before_w": 0, "binning": 1.5, "resampled": True, "resized": False, "rotated": False} | v
    return F.struct(*[F.lit(x).cast("string" if k == "error" else type_of(x)).alias(k) for k, x in base.items()])


def type_of(x):
    return {bool: "boolean", int: "int", float: "double"}[type(x)]


def test_resizing_reports_what_cannot_be_done(spark):
    rows = spark.createDataFrame([(1, "mip", [1.0] * 64), (2, "mip", [1.0] * 63), (3, "map", [1.0] * 64), (4, "psi", None)], "k long, name string, v array<double>")
    got = {r.k: r for r in resizing.from_search(rows.withColumn("plan", plan(spark, original_h=12)), "k", "name", "v").collect()}
    assert got[1].error is None and np.allclose(got[1].values, 1.0) and len(got[1].values) == 144
    assert [got[k].error is not None and got[k].values is None for k in (2, 3, 4)] == [True] * 3
    bad = resizing.from_search(rows.withColumn("plan", plan(spark, error="no area")), "k", "name", "v").collect()
    assert {r.error for r in bad} == {"no area"}
    cut = resizing.from_search(rows.where("k = 1").withColumn("plan", plan(spark)), "k", "name", "v", rescale=False).first()
    assert (cut.height, cut.width) == (6, 8) and all(cut.inside)
    assert resizing.from_search(rows.where("false").withColumn("plan", plan(spark)), "k", "name", "v").count() == 0


def test_rotated_maps(spark):
    v = np.arange(24.0).reshape(4, 6)
    own = plan(spark, original_h=6, original_w=4, search_h=4, search_w=6, lower_h=0, lower_w=0, upper_h=3, upper_w=5, before_h=0, before_w=0, binning=1.0, resampled=False, rotated=True)
    rows = spark.createDataFrame([(1, n, v.ravel().tolist()) for n in ("mip", "psi")], "k long, name string, v array<double>").withColumn("plan", own)
    got = {r.name: np.array(r.values).reshape(r.height, r.width) for r in resizing.from_search(rows, "k", "name", "v").collect()}
    inside = np.array(resizing.from_search(rows, "k", "name", "v").first().inside).reshape(6, 4)
    assert np.allclose(got["mip"][inside], np.rot90(v, -1)[inside]) and np.allclose(got["psi"][inside], (np.rot90(v, -1) + 90)[inside])
    images = spark.createDataFrame([(1, np.rot90(v, -1).ravel().tolist())], "k long, v array<double>").withColumn("plan", own)
    back = resizing.to_search(images, "k", "v", mode="zero").first()
    assert (back.height, back.width) == (4, 6) and back["values"] == v.ravel().tolist()


@pytest.mark.parametrize("mode", ["zero", "edge", "replicate", "noise"])
def test_paddings_agree(spark, mode):
    v = np.random.default_rng(2).normal(size=(5, 5))
    got = arrays.padded(spark.createDataFrame([(1, v.ravel().tolist())], "vec_id long, embedding array<double>"), 5, 8, mode).collect()
    own, want = np.zeros((8, 8)), resizing.padded(v, (8, 8), mode, 1)
    for r in got:
        own[r.y, r.x] = r.v
    assert sum(r.copied for r in got) == 25 and np.allclose(own[1:6, 1:6] if mode != "replicate" else own, v if mode != "replicate" else want)
    assert mode == "noise" or np.allclose(own, want)


def test_nearest_and_flood(spark):
    v = np.zeros((7, 9))
    known = np.zeros((7, 9), bool)
    known[2, 1] = known[5, 7] = True
    v[2, 1], v[5, 7] = 3.0, 8.0
    full = resizing.nearest(v, known, np.ones((7, 9), bool), 1)
    assert set(np.unique(full)) == {3.0, 8.0} and full[0, 0] == 3 and full[6, 8] == 8
    with pytest.raises(ValueError, match="no known"):
        resizing.nearest(v, np.zeros_like(known), known, 2)
    rows = [(k, y, x, float(v[y, x]) if known[y, x] and k == 1 else None) for k in (1, 2) for y in range(7) for x in range(9)]
    px = spark.createDataFrame(rows, "vec_id long, y int, x int, v double")
    near = maps.flooded(maps.nearest_fill(px, 1)).collect()
    assert {(r.y, r.x): r.v for r in near if r.vec_id == 1} == {(y, x): full[y, x] for y in range(7) for x in range(9)}
    assert all(r.v is None for r in near if r.vec_id == 2)


def test_text_tables_keep_all(spark):
    rows = [(1, "a\nb"), (2, ""), (3, " x "), (4, None), (5, 'q"t\tt'), (6, "\\n\\\\e\r\n\\"), (7, "\\e"), (8, '"'), (9, "#"), (10, "line\n" * 40)]
    df = spark.createDataFrame(rows, "i long, error string")
    assert sorted(map(tuple, tables.read_tsv(spark, tables.write_tsv(df, "t", "i"), df.schema).collect())) == rows


def test_compared_folders_by_path(spark):
    folder = shared_folder(spark, "two")
    rows = spark.createDataFrame([("a/x", [1.0]), ("b/x", [2.0])], "name string, v array<double>")
    npy.write_arrays(rows, f"{folder}/one", "name", "v")
    npy.write_arrays(rows.where("name = 'a/x'"), f"{folder}/other", "name", "v")
    found = npy.compared(npy.files(spark, f"{folder}/one"), npy.files(spark, f"{folder}/other"), 0, 0)
    assert {(r.name, r.status) for r in found.collect()} == {("a/x", "close"), ("b/x", "missing_candidate")}


def test_infinite_scores_are_no_peaks(spark):
    df = spark.createDataFrame([(1, 0, 0, float("inf")), (1, 1, 1, 5.0), (1, 9, 9, float("nan"))], "grid long, x long, y long, score double")
    assert [(r.x, r.rank) for r in peaks.greedy(df, 1.0, 2.0, 10).collect()] == [(1, 1)]


def test_no_counted_place_is_an_error(spark):
    m = spark.createDataFrame([(1, 0.0, 0.0, 5)], "vec_id long, s1 double, s2 double, n long")
    with pytest.raises(Exception, match="no place is counted"):
        search.global_scale(m).collect()


def test_sphere_means(spark):
    v = np.arange(125.0)
    df = spark.createDataFrame([(1, v.tolist())], "vec_id long, embedding array<double>")
    c = (np.indices((5, 5, 5)) - 2.0) ** 2
    for radius in (0.0, 1.0, 2.3):
        assert abs(volumes.sphere_mean(df, 5, radius).first()["mean"] - v.reshape(5, 5, 5)[c.sum(0) <= radius**2].mean()) < 1e-9
