import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield import domain, kernel, models, projection, running, sizes, times
from peakfield import queries as own
from peakfield.operators import grids, search
from peakfield.sources import mrc, star

DATA = "/root/testdata/sf0.001"


def told(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(own.oracle_sql() | domain.oracle_sql() | kernel.oracle_sql() | projection.oracle_sql() | sizes.oracle_sql() | running.oracle_sql() | times.oracle_sql() | models.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df, want = (own.queries() | domain.queries() | kernel.queries() | projection.queries() | sizes.queries() | running.queries() | times.queries() | models.queries())[name](spark, DATA), sql.sql((own.oracle_sql() | domain.oracle_sql() | kernel.oracle_sql() | projection.oracle_sql() | sizes.oracle_sql() | running.oracle_sql() | times.oracle_sql() | models.oracle_sql())[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(told(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(told(r[i]) for i in at) for r in want.fetchall())


def test_greedy_peaks_equal_brute_force(spark):
    rows = [(r.grid, r.x, r.y, r.score) for r in spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id % 8 as grid", "event_id % 64 as x", "event_id div 64 as y", "value as score").collect()]
    want = []
    for g in sorted({r[0] for r in rows}):
        left = [r for r in rows if r[0] == g and r[3] >= 1.0]
        rank = 0
        while left:
            best = min(left, key=lambda r: (-r[3], r[2], r[1]))
            rank += 1
            want.append((g, rank, best[1], best[2], best[3]))
            left = [r for r in left if (r[1] - best[1]) ** 2 + (r[2] - best[2]) ** 2 > 25]
    assert sorted(tuple(r) for r in own.queries()["greedy_nms"](spark, DATA).collect()) == sorted(want)


def test_greedy_peaks_of_one_large_grid_spread(spark):
    from peakfield.operators import peaks

    r = np.random.default_rng(5)
    rows = [(None if i % 2 else 1, int(x), int(y), float(v)) for i, (x, y, v) in enumerate(zip(r.integers(-40, 40, 1500), r.integers(-40, 40, 1500), r.integers(0, 30, 1500), strict=True))]
    df = spark.createDataFrame(rows, "grid long, x long, y long, score double")
    for radius, most in ((3.5, 1000), (0.0, 50)):
        want = []
        for g in (None, 1):
            left, rank = [x for x in rows if x[0] == g and x[3] >= 2], 0
            while left and rank < most:
                best = min(left, key=lambda p: (-p[3], p[2], p[1]))
                rank += 1
                want.append((g, rank, *best[1:]))
                left = [p for p in left if (p[1] - best[1]) ** 2 + (p[2] - best[2]) ** 2 > radius**2]
        got = peaks.greedy(df, 2.0, radius, most)
        # no grid goes to one group
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_range_of_ranks_has_no_global_window(spark):
    from peakfield.operators import catalog

    keys = [None, *np.random.default_rng(2).permutation(5000).tolist(), None]
    got = catalog.ranked_range(spark.createDataFrame([(k,) for k in keys], "k int").repartition(7), "k", 1, 3000)
    assert "windowspecdefinition(k" not in got._jdf.queryExecution().toString()
    assert sorted((r.row_index, r.k) for r in got.collect() if r.k is not None) == [(k + 2, k) for k in range(2999)]


def test_every_line_is_parsed(spark):
    from peakfield.operators import catalog

    atom = "ATOM      2  CA  ALA B   1      11.500  -2.250 1.0e+02  1.00  0.00          FE"
    text = "HEADER\r\n" + atom + "\n" + atom[:54] + "\n"
    got = catalog.fixed_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text").collect()
    want = [(1, 1, "HEADER", "", "", None, None, None), (1, 2, "ATOM  ", "B", "FE", 11.5, -2.25, 100.0), (1, 3, "ATOM  ", "B", "C", 11.5, -2.25, 100.0), (1, 4, "", "", "", None, None, None), (3, 1, "", "", "", None, None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_views_of_a_known_grid():
    assert len(grids.views("C1", 3.0)) == 4606
    assert len(grids.steps(np.float32(90), np.float32(360), closed=True)) == 5
    with pytest.raises(ValueError):
        grids.views("X2", 3.0)


def test_cyclic_views_of_the_upper_half():
    for order in ("C1", "C3"):
        whole, half = grids.views(order, 7.0), grids.views(order, 7.0, whole=False)
        assert max(t for _, t in half) <= 90.01 and len(half) < len(whole)
    assert grids.views("D2", 7.0, whole=False) == grids.views("D2", 7.0)


def test_search_grids_equal_brute_force(spark):
    f = np.float32

    def count(symmetry, step):
        try:
            phi_max, theta_max = grids.ranges(symmetry)
        except ValueError:
            return None
        step, n, theta = f(step), 0, f(0)
        theta_step = theta_max / f(int(theta_max / step + f(0.5)))
        while theta < theta_max + theta_step / f(2):
            around = phi_max
            if theta not in (f(0), f(180)):
                around = phi_max / f(max(1, int(phi_max / min(abs(step / np.sin(theta * f(math.pi / 180))), phi_max) + f(0.5))))
            phi = f(0)
            while phi < phi_max:
                n, phi = n + 1, phi + around
            theta = theta + theta_step
        return n

    known, modes = {}, set()
    for r in domain.queries()["search_grids"](spark, DATA).collect():
        if r.one:
            want = (r.radius, 0, 0, 1, 1)
        else:
            radius = r.radius if r.radius >= 1 else 200.0
            step = r.angular_step if (r.angular_step or 0) > 0 else float(f(180 / math.pi) * f(f(2) * f(r.resolution) / f(radius)))
            psi = r.psi_step if (r.psi_step or 0) > 0 else float(f(360) / f(max(1, int(f(360) / (f(180 / math.pi) * f(f(r.pixel) / f(radius))) + f(0.5)))))
            turns, at = 0, f(0)
            while at <= f(360):
                turns, at = turns + 1, at + f(psi)
            key = (r.symmetry, step)
            known[key] = known[key] if key in known else count(*key)
            want = (radius, step, psi, known[key], turns)
        modes.add((r.one, r.radius < 1, r.angular_step is None, r.psi_step is None, want[3] is None))
        assert (r.radius_used, r.angular_used, r.psi_used, r.n_views, r.n_psi) == want
        assert r.n_orientations == (None if want[3] is None else want[3] * want[4])
    assert len(modes) > 8


def test_grids_that_cannot_be_made(spark):
    rows = [("C1", None, 1.0, 5.0, None, None, None), ("C1", 5.0, 0.0, 50.0, None, None, False), (None, 5.0, 1.0, 50.0, None, None, False), ("C1", 5.0, 1.0, None, 500.0, 720.0, None), ("C1", None, None, 0.0, None, None, True)]
    df = spark.createDataFrame(rows, "symmetry string, resolution double, pixel double, radius double, angular_step double, psi_step double, one boolean")
    got = [(r.radius_used, r.n_views, r.n_psi, r.n_orientations) for r in grids.planned(df).collect()]
    assert got[0][1:2] == (None,) and got[1][2] is None and got[1][1] > 0 and got[2][1] is None and got[3] == (200.0, None, 1, None) and got[4] == (200.0, 1, 1, 1)


def test_reduced_equals_maxima_and_moments(spark):
    rows = [(1, 3, 2.0), (1, 1, 2.0), (1, 2, float("nan")), (2, 1, -1.0), (3, 4, float("nan")), (4, 1, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, task long, score double")
    got = {r.vec_id: (r.mip, r.task, r.n) for r in search.reduced(df).collect()}
    assert got == {1: (2.0, 1, 3), 2: (0.0, None, 1), 3: (0.0, None, 1), 4: (0.0, None, 1)}
    parts = [search.reduced(df.where(f"task % 2 = {i}")) for i in range(2)]
    assert {r.vec_id: (r.mip, r.task, r.n) for r in search.merged(*parts).collect()} == got


def test_winners_have_their_views(spark):
    views = grids.views("C4", 15.0)
    for r in domain.queries()["winner_orientations"](spark, DATA).collect():
        task = r.event_id % (13 * len(views))
        assert (r.grid_index, r.phi, r.theta, r.psi) == (task // 13, *views[task // 13], 30.0 * (task % 13))


def test_noise_threshold_equals_brute_force(spark):
    from statistics import NormalDist

    rows = [(r.event_id, r.value) for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "value").collect()]
    v = np.array([r[1] for r in rows])
    least = NormalDist().inv_cdf(1 - 20 / len(v))
    want = {r[0] for r, z in zip(rows, (v - v.mean()) / v.std(), strict=True) if z >= least}
    assert {r.event_id for r in domain.queries()["noise_threshold"](spark, DATA).collect()} == want


def test_star_loops():
    text = "data_Optics\nloop_\n_a\n_b #2\n1 'x y'\n2\n3 # c\n4\n_pair 5\ndata_m\n_key 1\nloop_\n_c\n"
    with pytest.raises(ValueError):
        list(star.loops(text))
    assert list(star.loops(text.replace("3 # c\n4", "3"))) == [("Optics", ["_a", "_b"], ["1", "x y", "2", "3"]), ("m", ["_c"], [])]


def test_mrc_round_trip_and_wrong_values():
    v = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    got = list(mrc.sections("a", mrc.encoded(v, 1.5)))
    assert [g["values"][0].tolist() for g in got] == [x.ravel().tolist() for x in v]
    assert (got[0]["nx"][0], got[0]["ny"][0], got[0]["nz"][0], got[0]["voxel"][0]) == (4, 3, 2, 1.5)
    v[1, 1, 1] = np.nan
    with pytest.raises(ValueError):
        list(mrc.sections("a", mrc.encoded(v, 1.5)))


def test_padding_with_noise_is_drawn_again_alike(spark):
    from peakfield.operators import arrays

    images = spark.createDataFrame([(k, [float(i) for i in range(16)]) for k in range(200)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.y, r.x): r for r in arrays.padded(images, 4, 8, "noise", 3).collect()}
    again = {(r.vec_id, r.y, r.x): r for r in arrays.padded(images.repartition(7), 4, 8, "noise", 3).collect()}
    assert got == again
    assert [got[5, 2 + i // 4, 2 + i % 4].v for i in range(16)] == list(range(16))
    noise = np.array([r.v for r in got.values() if not r.copied])
    assert len(noise) == 200 * 48 and abs(noise.mean()) < 0.04 and abs(noise.std() - 1) < 0.03
    cut = {(r.y, r.x): (r.v, r.copied) for r in arrays.padded(images, 4, 2, "zero").where("vec_id = 0").collect()}
    assert cut == {(0, 0): (5.0, True), (0, 1): (6.0, True), (1, 0): (9.0, True), (1, 1): (10.0, True)}


def test_slices_of_a_larger_volume():
    from peakfield.operators import volumes

    v = np.random.default_rng(4).normal(size=(8, 8, 8))
    full = volumes.spectrum(v)
    turn = volumes.rotations(np.array([0.0, 90.0]), np.array([0.0, 0.0]), np.array([0.0, 0.0]))
    got = volumes.cut(full, turn, 8)
    # without a turn the slice is the plane z = 0, but for the outermost samples, which have no neighbour beyond them
    for fy in range(-3, 3):
        for fx in range(4):
            if (fy, fx) != (0, 0) and not (fx == 0 and fy == -3):
                assert np.isclose(got[0, fy % 8, fx], full[0, fy, fx])
    assert np.allclose(got[:, 0, 0], 0) and np.allclose(got[:, 7, 0], np.conj(got[:, 1, 0]))
    # a quarter turn about z takes x to y
    assert np.isclose(got[1, 0, 1], full[0, 1, 0]) and np.isclose(got[1, 1, 0], full[0, 0, -1])


def test_configurations_say_what_they_may(spark):
    from peakfield.operators import configs

    rows = configs.resolved(spark.createDataFrame([(1, '{"a": "2", "z": 1, "y": null}'), (2, None), (3, "no json"), (4, '{"a": "x"}')], "id long, json string"), "json", {"a": ("double", 1.5)})
    assert [(r.id, r.unknown, r.a) for r in rows.orderBy("id").collect()] == [(1, ["y", "z"], 2.0), (2, [], 1.5), (3, [], 1.5), (4, [], 1.5)]
    assert [r.p for r in spark.range(10).select(configs.piece(F.col("id"), 10, 4).alias("p")).collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
