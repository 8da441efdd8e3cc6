"""Drift (PSI, eligibility, retention) and service-metric queries."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import drift as DR
from panelspark.operators import monitoring as MO
from panelspark.operators.ordering import dense_index
from tests.conftest import rows


def test_psi_zero_on_same_table_and_large_on_shift_b12(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    same = DR.psi(ref, ref, ["x"], ["c"])
    assert all(abs(r["psi"]) < 1e-12 for r in same.collect())
    shifted = ref.select((F.col("x") + 60).alias("x"), F.lit("9").alias("c"))
    got = dict(rows(DR.psi(ref, shifted, ["x"], ["c"]), "feature", "psi"))
    assert got["x"] > 0.2 and got["c"] > 0.2
    ds = DR.dataset_drift(DR.psi(ref, shifted, ["x"], ["c"])).first()
    assert ds["n_drifted"] == 2 and ds["dataset_drift"]


def test_psi_is_non_negative(spark):
    ref = spark.range(500).select((F.col("id") * 7 % 50).cast("double").alias("x"))
    cur = spark.range(300).select((F.col("id") * 3 % 40).cast("double").alias("x"))
    assert DR.psi(ref, cur, ["x"]).first()["psi"] >= 0


def test_grouped_psi_matches_reference_edges(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    cur = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") % 80 + 10).cast("double").alias("x"))
    grouped = dict(rows(DR.psi_grouped(ref, cur, "g", ["x"]), "g", "psi"))
    for g in (0, 1):
        one = DR.psi(ref, cur.filter(F.col("g") == g), ["x"], edges="reference").first()["psi"]
        assert abs(grouped[g] - one) < 1e-9


def test_eligibility_drops_all_null_column(spark):
    ref = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "a double, b double")
    cur = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert DR.eligible_columns(ref, cur, ["a", "b", "zz"]) == ["a"]


def test_retention_keeps_newest_ten_b16(spark):
    base = dt.datetime(2024, 1, 1)
    reps = spark.createDataFrame(
        [(base + dt.timedelta(hours=i), f"r{i:02d}") for i in range(12)], "report_ts timestamp, report_name string"
    )
    kept = DR.retention(reps).orderBy("rank").collect()
    assert [r["report_name"] for r in kept] == [f"r{i:02d}" for i in range(11, 1, -1)]


def breaches(spark, flags):
    base = dt.datetime(2024, 1, 1, 0, 0)
    data = [(base + dt.timedelta(minutes=i), bool(f)) for i, f in enumerate(flags)]
    return spark.createDataFrame(data, "_start timestamp_ntz, breach boolean")


def test_sustained_needs_five_consecutive_b14(spark):
    assert MO.sustained(breaches(spark, [1, 1, 0, 1, 1, 1, 1, 0])).count() == 0
    fired = MO.sustained(breaches(spark, [1, 1, 1, 1, 1, 1, 0]))
    assert rows(fired, "eval_start", "alert_start") == [("2024-01-01 00:04:00", True), ("2024-01-01 00:05:00", False)]


def test_absences_cross_day_boundaries(spark):
    t = [dt.datetime(2024, 1, 1, 23, 50), dt.datetime(2024, 1, 1, 23, 51), dt.datetime(2024, 1, 2, 0, 1), dt.datetime(2024, 1, 2, 0, 2)]
    df = spark.createDataFrame([("x", v) for v in t], "event_type string, ts timestamp_ntz")
    got = rows(MO.absences(df), "gap_start", "gap_end", "gap_seconds")
    assert got == [("2024-01-01 23:51:00", "2024-01-02 00:01:00", 600.0)]


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 13).alias("b"))
    out = dense_index(df, ["k"])
    got = [(r["k"], r["seq"]) for r in out.collect()]
    assert sorted(s for _, s in got) == list(range(5000))
    assert all(k == s for k, s in got)


def test_dense_index_splits_a_hot_hour(spark):
    # every row in the same hour (a micro-batch): ranges still split it, numbers stay dense and ordered
    df = spark.range(0, 3000).select(
        F.lit(dt.datetime(2024, 1, 1, 5, 0)).cast("timestamp_ntz").alias("ts"), ((F.col("id") * 7919) % 3000).alias("event_id")
    )
    out = dense_index(df, ["ts", "event_id"], start=10, partitions=6)
    got = sorted((r["event_id"], r["seq"]) for r in out.collect())
    assert got == [(i, i + 10) for i in range(3000)]
    parts = df.repartitionByRange(6, "ts", "event_id").rdd.glom().map(len).collect()
    assert max(parts) < 3000  # the hour is cut into several ranges


def test_sliding_windows_count_each_event_five_times(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 3, 30))], "event_type string, ts timestamp_ntz")
    out = MO.request_rate(df)
    assert out.count() == 5 and {r["n"] for r in out.collect()} == {1}


def test_grouped_percentile_matches_spark(spark):
    from panelspark.operators.quantiles import grouped_percentile

    # group 0 holds a third of the rows; group 99 has only a null value
    df = spark.range(0, 6000).select(
        F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id") % 17).alias("g"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.round(F.rand(7) * 100, 2)).alias("v"),
    )
    df = df.unionByName(spark.createDataFrame([(99, None), (None, 1.0), (None, 4.0), (None, float("nan"))], "g long, v double"))
    for p in (0.95, 0.5, 0.0, 1.0):
        want = {r["g"]: r["q"] for r in df.filter("v IS NULL OR NOT isnan(v)").groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
        got = {r["g"]: r["q"] for r in grouped_percentile(df, ["g"], "v", p, "q").collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert (got[k] is None and w is None) or abs(got[k] - w) < 1e-9, (p, k)


def test_absences_of_a_hot_key_over_many_ranges(spark):
    import random

    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    ts = sorted(t0 + dt.timedelta(seconds=rnd.randint(0, 40 * 3600)) for _ in range(1500))
    data = [("hot", t) for t in ts] + [("cold", t0), ("cold", t0 + dt.timedelta(hours=5))]
    df = spark.createDataFrame(data, "event_type string, ts timestamp_ntz")
    want = []
    for key in ("cold", "hot"):
        s = sorted(t for k, t in data if k == key)
        want += [(key, (b - a).total_seconds()) for a, b in zip(s, s[1:]) if (b - a).total_seconds() > 180]
    got = sorted((r["event_type"], r["gap_seconds"]) for r in MO.absences(df).collect())
    assert got == sorted(want)


def test_ranged_order_with_more_ranges_than_rows(spark):
    from panelspark.operators.ordering import next_in_order

    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("c", 7), ("a", 2)], "k string, t int")
    seq = sorted((r["k"], r["t"], r["seq"]) for r in dense_index(df, ["k", "t"], partitions=16).collect())
    assert seq == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 3), ("c", 7, 4)]
    nxt = sorted(
        (r["k"], r["t"], r["_next_k"], r["_next_t"]) for r in next_in_order(df, ["k", "t"], ["k", "t"], partitions=16).collect()
    )
    assert nxt == [("a", 1, "a", 2), ("a", 2, "a", 3), ("a", 3, "b", 1), ("b", 1, "c", 7), ("c", 7, None, None)]


def test_psi_ignores_nan_and_does_not_stretch_to_infinity(spark):
    ref = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    cur = spark.range(1000).select((F.col("id") + 700).cast("double").alias("x"))
    plain = DR.psi(ref, cur, ["x"]).first()["psi"]
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert abs(DR.psi(ref.union(odd), cur.union(odd), ["x"]).first()["psi"] - plain) < 1e-12
    far = spark.createDataFrame([(float("inf"),)], "x double")
    assert DR.psi(ref.union(far), cur, ["x"]).first()["psi"] > 0.5 * plain


def test_a_damaged_buffer_stops_the_batch(spark, tmpdir_path):
    import os

    import pytest

    from panelspark.streaming.drift_stream import buffered_rows

    assert buffered_rows(spark, f"{tmpdir_path}/none") == 0
    os.makedirs(f"{tmpdir_path}/s/buffer/epoch=0")
    with open(f"{tmpdir_path}/s/buffer/epoch=0/part-0.parquet", "wb") as f:
        f.write(b"damaged")
    with pytest.raises(Exception):  # noqa: B017
        buffered_rows(spark, f"{tmpdir_path}/s")
