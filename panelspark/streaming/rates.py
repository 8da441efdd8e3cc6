"""Service-metric streams (T1-T3, T5 in streaming form).

Events arrive as a file stream; ``ts`` is cast to TIMESTAMP (watermarks
refuse TIMESTAMP_NTZ) in the session time zone and back for display.
Windows of 5 minutes sliding by 1 minute are closed by a 10-minute
watermark (own choice) and emitted once, in append mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitoring import ERROR_RATIO_LIMIT, SLIDE, WINDOW, WINDOW_SECONDS

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, directory: str, name: str = "events.parquet", max_files: int | None = None) -> DataFrame:
    """File stream over the landed event files of a folder."""
    schema = spark.read.parquet(f"{directory.rstrip('/')}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, WATERMARK)


def _display(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def rate_stream(events: DataFrame, target: str = "event_type", ts: str = "ts") -> DataFrame:
    """T1 on a stream: requests per second per target and closed window."""
    return (
        with_event_time(events, ts)
        .groupBy(F.window(F.col(ts), WINDOW, SLIDE).alias("w"), F.col(target))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            _display(F.col("w.start")).alias("window_start"),
            F.col(target),
            "n",
            (F.col("n") / F.lit(float(WINDOW_SECONDS))).alias("rate"),
        )
    )


def error_ratio_stream(events: DataFrame, is_error: Column, ts: str = "ts") -> DataFrame:
    """T3 on a stream: error ratio per closed window with the breach flag; keeps the
    window start as event time so a second (chained) window can follow."""
    return (
        with_event_time(events, ts)
        .groupBy(F.window(F.col(ts), WINDOW, SLIDE).alias("w"))
        .agg(F.sum(is_error.cast("long")).alias("n_error"), F.count(F.lit(1)).alias("n"))
        .select(F.window_time("w").alias("eval_time"), F.col("w.start").alias("start"), "n_error", "n")
        .withColumn("breach", (F.col("n_error") / F.col("n")) > F.lit(ERROR_RATIO_LIMIT))
    )


def run_to_table(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming query over everything available now into a parquet sink."""
    q = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def sustained_stream(breaches: DataFrame, n: int = 5) -> DataFrame:
    """T5 on a stream: a second (chained) sliding window over the evaluation
    times of the first; it fires when all ``n`` evaluations inside breached.

    The evaluation of a first-level window is its ``window_time`` (end - 1 us),
    so the second-level window starting at s holds the evaluations of the
    first-level windows starting at s - (n-1) .. s minutes.
    """
    w2 = F.window(F.col("eval_time"), f"{n} minutes", SLIDE)
    return (
        breaches.groupBy(w2.alias("w2"))
        .agg(F.sum(F.col("breach").cast("int")).alias("n_breach"))
        .filter(F.col("n_breach") == F.lit(n))
        .select(_display(F.col("w2.start")).alias("eval_start"), F.col("n_breach").cast("long").alias("n_consecutive"))
    )


def sessions_stream(events: DataFrame, key: str = "event_type", ts: str = "ts", gap: str = "3 minutes") -> DataFrame:
    """T6 on a stream: heartbeat sessions per key; a session closes after ``gap``
    without events, and the time between sessions is an outage."""
    return (
        with_event_time(events, ts)
        .groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(
            F.col(key),
            _display(F.col("s.start")).alias("session_start"),
            _display(F.col("s.end")).alias("session_end"),
            "n_events",
        )
    )


def p95_stream(events: DataFrame, target: str = "event_type", latency: str = "value", ts: str = "ts") -> DataFrame:
    """T2 on a stream: approximate P95 per target and closed window (bounded sketch state)."""
    return (
        with_event_time(events, ts)
        .groupBy(F.window(F.col(ts), WINDOW, SLIDE).alias("w"), F.col(target))
        .agg(F.percentile_approx(F.col(latency), 0.95, 10000).alias("p95"))
        .select(_display(F.col("w.start")).alias("window_start"), F.col(target), "p95")
    )
