"""J1 and A9 with late truth: a label follows most events after up to 16 minutes, a fifth never get one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming.late_truth import join_truth, merged, metrics, moments
from ..streaming.rates import event_stream, run_to_table
from . import driver_tables as D
from .catalog import query, rounded
from .oracle import SQL, r4


@query("stream_metrics")
def q_stream_metrics(spark, sf_dir):
    """Metrics per target over what is settled: predictions and labels older than half an hour at the newest event."""
    ev = event_stream(spark, sf_dir).select("event_id", "event_type", "ts", "value")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 17).cast("int"))
    labels = ev.filter(F.col("event_id") % 5 != 0).select(
        "event_id", F.col("event_type").alias("label_type"), (F.col("ts") + minutes).alias("label_ts"), F.col("value").alias("label")
    )
    predictions = ev.select("event_id", "event_type", "ts", (F.col("value") * 0.9 + (F.col("event_id") % 7)).alias("prediction"))
    joined = join_truth(predictions, labels, "event_id", "ts", "label_ts")
    root = scratch_path(spark, "stream-truth")
    run_to_table(joined, f"{root}/out", f"{root}/checkpoint")
    newest = D.events(spark, sf_dir).agg(F.max("ts").cast("timestamp").alias("m"))  # one row
    settled = F.coalesce("ts", "label_ts") < F.col("m") - F.expr("INTERVAL 30 MINUTES")
    rows = spark.read.schema(joined.schema).parquet(f"{root}/out").crossJoin(F.broadcast(newest)).filter(settled)
    daily = moments(rows, [F.coalesce("event_type", "label_type").alias("target"), F.to_date(F.coalesce("ts", "label_ts")).alias("day")])
    out = metrics(merged(daily, ["target"]))
    return rounded(out.select("target", "n", "n_waiting", "n_orphans", "mae", "r2", "residual_std"))


SQL["stream_metrics"] = f"""
WITH edge AS (SELECT max(ts) - INTERVAL 30 MINUTE AS m FROM events),
p AS (SELECT event_id, event_type, ts, value * 0.9 + event_id % 7 AS prediction FROM events),
y AS (SELECT event_id, event_type, ts + to_minutes(event_id % 17) AS label_ts, value AS label FROM events WHERE event_id % 5 <> 0),
j AS (SELECT coalesce(p.event_type, y.event_type) AS target, prediction, label FROM p FULL JOIN y
    ON p.event_id = y.event_id AND label_ts >= ts AND label_ts <= ts + INTERVAL 10 MINUTE WHERE coalesce(ts, label_ts) < (SELECT m FROM edge))
SELECT target, count(prediction + label) AS n, count(*) FILTER (WHERE label IS NULL) AS n_waiting, count(*) FILTER (WHERE prediction IS NULL) AS n_orphans,
    {r4("avg(abs(prediction - label))")} AS mae,
    {r4("1 - sum((prediction - label) ** 2) / sum(CASE WHEN prediction IS NOT NULL THEN label * label END) * 1e0 / (1 - sum(CASE WHEN prediction IS NOT NULL THEN label END) ** 2 / count(prediction + label) / sum(CASE WHEN prediction IS NOT NULL THEN label * label END))")} AS r2,
    {r4("stddev_pop(prediction - label)")} AS residual_std
FROM j GROUP BY target"""
