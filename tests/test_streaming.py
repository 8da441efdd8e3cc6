"""Count-window drift stream (B13) and the watermarked rate stream."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.streaming.drift_stream import buffered_rows, run_drift_stream


def scored_rows(spark, start, n):
    base = dt.datetime(2024, 1, 1)
    data = [(start + i, base + dt.timedelta(minutes=start + i), float((start + i) % 7), "t" + str(i % 2)) for i in range(n)]
    return spark.createDataFrame(data, "event_id long, ts timestamp_ntz, value double, event_type string")


def run(spark, root, chunks):
    src = f"{root}/src"
    start = 0
    for n in chunks:
        scored_rows(spark, start, n).coalesce(1).write.mode("append").parquet(src)
        start += n
    schema = scored_rows(spark, 0, 1).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    ref = lambda: scored_rows(spark, 0, 100)
    reports = run_drift_stream(stream, ref, ["value"], ["event_type"], ["ts", "event_id"], f"{root}/drift", size=20)
    return reports, buffered_rows(spark, f"{root}/drift")


def test_count_window_reports_b13(spark, tmpdir_path):
    r19, left19 = run(spark, f"{tmpdir_path}/a", [19])
    assert r19.count() == 0 and left19 == 19
    r20, left20 = run(spark, f"{tmpdir_path}/b", [20])
    assert r20.count() == 1 and left20 == 0
    r45, left45 = run(spark, f"{tmpdir_path}/c", [15, 15, 15])
    assert r45.count() == 2 and left45 == 5
    assert sorted(r["report_no"] for r in r45.collect()) == [0, 1]
    assert all(r["n_rows"] == 20 for r in r45.collect())
