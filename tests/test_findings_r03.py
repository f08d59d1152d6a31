import datetime
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from peakfield import kernel, models
from peakfield import queries as own
from peakfield.operators import batch, maps, peaks, spectral


def both(spark, folder, module, name, **tables):
    """Rows of a query and of its SQL over the given tables, as text in order."""
    con = duckdb.connect()
    con.sql("set threads = 1")
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found, want = module.queries()[name](spark, str(folder)), con.sql(module.oracle_sql()[name])
    told = lambda rows: sorted(repr([None if v is None else v for v in r]) for r in rows)
    return told(found.select(*want.columns).collect()), told(want.fetchall())


def test_fields_between_other_spaces_and_line_ends(spark, tmp_path):
    at = lambda v: " " * 30 + "".join(f"{v:<8}" for _ in range(3)) + " " * 22
    texts = [at(v) for v in ("12\r", "12 ", "12\x85", "\xa012", "　12 ", "1234e567", "12\t", "᠎12")] + [" " * 76 + "\xa0C", " " * 12 + "N" + " " * 63 + "　\xa0", None, ""]
    found, want = both(spark, tmp_path, own, "fixed_width_lines", documents=pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert found == want


def test_first_line_among_equal_values(spark, tmp_path):
    ids = list(range(20_000))
    random.Random(3).shuffle(ids)
    for order in (sorted(ids), ids):
        e = pa.table({"event_type": [("view", "click")[i % 2] for i in order], "value": [float(i % 100 // 10) for i in order], "event_id": order})
        pq.write_table(e, f"{tmp_path}/events.parquet")
        found = kernel.queries()["histogram_summaries"](spark.newSession(), str(tmp_path)).collect()
        assert sorted(tuple(r) for r in found) == [("click", 10_000, 0.0, 1), ("view", 10_000, 0.0, 0)]


def test_rates_among_equal_times(spark, tmp_path):
    at = lambda i: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=i // 10)
    ids = list(range(400))
    random.Random(3).shuffle(ids)
    pq.write_table(pa.table({"event_id": ids, "ts": [at(i) for i in ids], "user_id": [7] * len(ids), "value": [float(i * i % 97) for i in ids]}), f"{tmp_path}/events.parquet")
    found = {r.event_id: r.rate for r in kernel.queries()["recent_rate"](spark, str(tmp_path)).collect()}
    assert found == {i: float(i * i % 97 - (i - 1) ** 2 % 97) if i and i % 10 == 0 else None for i in range(400)}


def test_rates_over_microseconds(spark, tmp_path):
    begin = datetime.datetime(2026, 1, 1)
    steps = [1, 2, 3, 5, 7, 11, 13, 1000, 1001, 999_983]
    at = [begin + datetime.timedelta(microseconds=sum(steps[:i])) for i in range(len(steps) + 1)]
    events = pa.table({"event_id": list(range(len(at))), "ts": at, "user_id": [7] * len(at), "value": [float(i * i % 7) for i in range(len(at))]})
    found, want = both(spark, tmp_path, kernel, "recent_rate", events=events)
    assert found == want


def test_models_of_equal_atoms_are_made_each(spark, tmp_path):
    keys = [40 * m + i for m in (3, 4, 15_942) for i in range(40)]
    customers = pa.table({"c_custkey": keys, "c_nationkey": pa.array([k % 25 for k in keys], pa.int32())})
    found, want = both(spark, tmp_path, models, "model_templates", customer=customers)
    assert found == want


def test_rows_of_jobs_are_handed_on_together(spark, monkeypatch):
    jobs, held = spark.createDataFrame([(1, 1.0)], "index long, x double"), []
    monkeypatch.setattr(type(jobs), "mapInPandas", lambda df, f, schema: held.append(f))

    def work(job):
        if job["x"] is None:
            raise ValueError("there is no x")
        return {"n": int(job["x"])}

    batch.attempted(jobs, work, "n int")
    frames = list(held[0](iter([pd.DataFrame({"index": range(1000), "x": [None if i % 10 == 0 else float(i) for i in range(1000)]})])))
    rows = pd.concat(frames)
    assert len(frames) <= 16 and list(rows["index"]) == list(range(1000))
    assert list(rows["n"]) == [None if i % 10 == 0 else i for i in range(1000)] and list(rows["error"]) == ["ValueError: there is no x" if i % 10 == 0 else None for i in range(1000)]


def test_maxima_of_a_block_are_handed_on_in_pieces(spark, monkeypatch):
    images = spark.createDataFrame([(i, [float(i), 1.0, 0.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    tasks, held = spark.createDataFrame([(5, [1.0, 0.0, 0.0, 0.0])], "task long, template array<double>"), []
    plain = type(images).mapInPandas
    monkeypatch.setattr(type(images), "mapInPandas", lambda df, f, schema: held.append(f) or plain(df, f, schema))
    spectral.correlated(images, tasks, 2)
    rows = [(0, 0, None, i, [float(i), 1.0, 0.0, 2.0]) for i in range(1300)] + [(0, 0, 5, None, [1.0, 0.0, 0.0, 0.0])]
    frames = list(held[0](iter([pd.DataFrame(rows, columns=["block", "slice", "task", "key", "values"])])))
    assert [len(f) for f in frames] == [512, 512, 276] and [k for f in frames for k in f["key"]] == list(range(1300))


def test_flood_sends_nothing_through_the_driver(spark, capsys):
    px = spark.createDataFrame([(0, y, x, 1.0 if x == y == 0 else None) for y in range(3) for x in range(3)], "vec_id long, y int, x int, v double")
    found = maps.flooded(px)
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out and found.where("v = 1").count() == 9


def test_greedy_sorts_stay_small(spark, monkeypatch):
    rows = spark.createDataFrame([(0, 10 * i, 0, float(i + 1)) for i in range(100)], "grid long, x long, y long, score double")
    plain, dealt = type(rows).repartition, []
    monkeypatch.setattr(peaks, "PART_ROWS", 10, raising=False)
    monkeypatch.setattr(type(rows), "repartition", lambda df, n, *c: dealt.append(n) or plain(df, n, *c))
    found = peaks.greedy(rows, 1.0, 5.0, 1000)
    assert dealt == [10] and sorted((r.x, r.rank) for r in found.collect()) == [(10 * i, 100 - i) for i in range(100)]
