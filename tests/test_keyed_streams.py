"""Keyed windows, silences and stream scoring over several micro-batches and a restart."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from panelspark.operators.registry import append_run, gates_table, version_stages
from panelspark.plans import scoring_queries as S
from panelspark.streaming.keyed import count_windows, run_keyed, silences
from panelspark.streaming.scoring import read_version, score_stream, served_version

SCHEMA = "k string, ts timestamp, id bigint, v double"
START = dt.datetime(2024, 1, 1)


def _land(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_count_windows_over_batches_and_a_restart(spark, tmpdir_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), START + dt.timedelta(seconds=i), i, None if i % 11 == 0 else float(i)) for i in range(90)]
    folder, root = f"{tmpdir_path}/in", f"{tmpdir_path}/out"

    def run():
        return run_keyed(count_windows(_stream(spark, folder), "k", ["ts", "id"], ["v"], 7), root)

    for part in (rows[:25], rows[25:40]):
        _land(spark, folder, random.Random(1).sample(part, len(part)))
    run()
    _land(spark, folder, rows[40:])
    got = sorted((r["k"] or "", r["window_no"], r["id"], r["v"]) for r in run().na.fill({"v": -1.0}).collect())  # goes on where it stopped
    by = defaultdict(list)
    for k, _, i, v in rows:
        by[k or ""].append((i, -1.0 if v is None else v))
    expected = sorted((k, n // 7, *r) for k, rs in by.items() for n, r in enumerate(rs[: len(rs) // 7 * 7]))
    assert got == expected


def test_a_late_row_calls_the_alarm_off(spark, tmpdir_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    folder, root = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    query = lambda: run_keyed(silences(_stream(spark, folder), "k"), root)
    _land(spark, folder, [("a", at(0), 1, 0.0), ("b", at(0), 2, 0.0), ("c", at(9), 3, 0.0), (None, at(0), 4, 0.0), ("a", None, 5, 0.0)])
    assert query().collect() == []  # the watermark is a minute before the first rows
    # b comes late, but before the watermark (now at 0) has passed the end of its silence
    _land(spark, folder, [("c", at(10), 6, 0.0), ("b", at(2), 7, 0.0)])
    assert query().collect() == []
    _land(spark, folder, [("c", at(14), 8, 0.0)])  # watermark 4: a is silent since 0, b only since 2
    assert [(r["k"], r["last_seen"], r["n_events"]) for r in query().collect()] == [("a", "2024-01-01 00:00:00", 1)]
    _land(spark, folder, [("c", at(30), 9, 0.0), ("a", at(29), 10, 0.0)])  # watermark 20: b, and c between 14 and 30 is no open one
    assert sorted((r["k"], r["last_seen"], r["n_events"]) for r in query().collect()) == [
        ("a", "2024-01-01 00:00:00", 1),
        ("b", "2024-01-01 00:02:00", 2),
    ]


ITEMS = "l_orderkey bigint, l_linenumber int, year int, quantity double, discount double, flag string, price double"


@pytest.fixture()
def items():
    rng = random.Random(2)
    return [
        (i, 1, 1995, float(rng.randint(1, 50)), None if i % 5 == 0 else rng.choice([0.01, 0.05, 0.09]), rng.choice(["A", "N", None]), rng.gauss(50, 9))
        for i in range(200)
    ]


def test_promotion_changes_later_batches_only(spark, tmpdir_path, items):
    root, folder = f"{tmpdir_path}/s", f"{tmpdir_path}/in"
    train = spark.createDataFrame(items, ITEMS)
    S.train_version(spark, train, root, 1)
    load = lambda v: read_version(spark, f"{root}/models", "price", v, S.NUMERIC, S.CATEGORICAL)
    run = lambda: score_stream(_stream(spark, folder, ITEMS), lambda: served_version(spark, f"{root}/registry", "price"), load, f"{root}/out")
    _land(spark, folder, items[:60], ITEMS)
    assert {r["model_version"] for r in run().collect()} == {1}
    S.train_version(spark, train.withColumn("price", train.price * 3), root, 2)
    unseen = [(1000, 1, 1995, None, None, "never seen", 0.0), (1001, 1, 1995, 3.0, 0.01, "", 0.0)]
    _land(spark, folder, items[60:] + unseen, ITEMS)
    scored = {r["l_orderkey"]: r for r in run().collect()}
    assert len(scored) == 202 and {r["model_version"] for k, r in scored.items() if k < 60} == {1} and {r["model_version"] for k, r in scored.items() if k >= 60} == {2}
    for version, rows in ((1, items[:60]), (2, items[60:] + unseen)):
        for r in load(version)(spark.createDataFrame(rows, ITEMS)).collect():
            assert scored[r["l_orderkey"]]["prediction"] == pytest.approx(r["prediction"])
    assert scored[1000]["flag_code"] == -1
    # a batch that runs again keeps its version and replaces its own rows
    from panelspark.streaming.scoring import batch_scorer

    batch_scorer(lambda: 2, load, f"{root}/out")(spark.createDataFrame(items[:60], ITEMS), 0)
    again = spark.read.option("basePath", f"{root}/out/scored").parquet(f"{root}/out/scored/batch=*")
    assert again.count() == 202 and again.filter("model_version = 1").count() == 60


def test_a_target_without_a_served_version_raises(spark, tmpdir_path):
    runs = spark.createDataFrame([("price", 1, "r2", 0.1)], "target string, version int, metric string, value double")
    append_run(version_stages(runs, gates_table(spark, {"price": ("r2", 0.4)})), f"{tmpdir_path}/registry", 1)
    with pytest.raises(ValueError, match="serves no version"):
        served_version(spark, f"{tmpdir_path}/registry", "price")
    assert served_version(spark, f"{tmpdir_path}/registry", "price", "latest") == 1


@pytest.mark.parametrize("n", [1, 9, 10, 500])
def test_rows_of_a_key_are_ordered_in_bounded_memory(n, monkeypatch):
    import pandas as pd

    from panelspark.streaming import keyed as K

    monkeypatch.setattr(K, "SORT_ROWS", 10)
    monkeypatch.setattr(K, "_BLOCK_ROWS", 3)
    rng = random.Random(n)
    rows = [(None if rng.random() < 0.05 else START + dt.timedelta(seconds=rng.randrange(n)), i // 3, float(i)) for i in range(n)]
    frame = pd.DataFrame(rows, columns=["ts", "id", "v"]).astype({"ts": "datetime64[ns]"})
    parts = [frame.iloc[i : i + 4] for i in range(0, n, 4)] or [frame]
    want = frame.sort_values(["ts", "id"], kind="stable", na_position="first", ignore_index=True)
    got = list(K.in_order(iter(parts), ["ts", "id"], 10))
    assert pd.concat(got, ignore_index=True).equals(want)
    assert n < 100 or max(map(len, got)) < 3 * (n // 8 + 1)

    class State:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def clear(self):
            self.value = None

        put = update = lambda self, value: setattr(self, "value", value)

    class Handle:
        getValueState = getListState = lambda self, *_: State()  # noqa: N815

    from pyspark.sql import types as T

    kept = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    windows = K.CountWindows("k", T.StringType(), ["ts", "id"], kept, 7)
    windows.init(Handle())
    out = list(windows.handleInputRows(("a",), iter(parts), None))
    assert [v for o in out for v in o["v"]] == list(want["v"])[: n // 7 * 7]
    assert [w for o in out for w in o["window_no"]] == [i // 7 for i in range(n // 7 * 7)]
    assert len(windows.waiting.value or []) == n % 7 and max(map(len, out), default=0) <= 16
