"""Registered streaming queries (T1, T4, D4): run with ``availableNow`` into
a fresh folder under the checkpoint folder, then read back the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz_literal
from ..session import scratch_path
from ..streaming.drift_stream import run_drift_stream
from ..streaming.rates import event_stream, rate_stream, run_to_table
from . import driver_tables as D
from .catalog import query, rounded


@query("stream_rate")
def q_stream_rate(spark, sf_dir):
    """T1 as a stream: only windows the 10-minute watermark has closed are emitted."""
    root = scratch_path(spark, "stream-rate")
    run_to_table(rate_stream(event_stream(spark, sf_dir).select("ts", "event_type")), f"{root}/out", f"{root}/ck")
    return rounded(spark.read.parquet(f"{root}/out"))


@query("stream_drift_20")
def q_stream_drift_20(spark, sf_dir):
    """T4 + D4: a drift report per 20 scored rows against the first week of events."""
    root = scratch_path(spark, "stream-drift")
    stream = event_stream(spark, sf_dir).select("event_id", "ts", "value", "event_type")

    def reference():
        ev = D.events(spark, sf_dir).select("ts", "value", "event_type")
        first = ev.agg(F.min(F.date_trunc("day", "ts"))).first()[0]
        return ev.filter(F.datediff(F.date_trunc("day", "ts"), ntz_literal(first)) < 7)

    reports = run_drift_stream(stream, reference, ["value"], ["event_type"], ["ts", "event_id"], root)
    return rounded(reports)


@query("stream_sustained")
def q_stream_sustained(spark, sf_dir):
    """T3 + T5 as one stream: error ratio per window, then a chained window for `for: 5m`."""
    from ..streaming.rates import error_ratio_stream, sustained_stream

    root = scratch_path(spark, "stream-sustained")
    ev = event_stream(spark, sf_dir).select("ts", "event_type")
    q = sustained_stream(error_ratio_stream(ev, F.col("event_type") == "error"))
    run_to_table(q, f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out")


@query("stream_sessions")
def q_stream_sessions(spark, sf_dir):
    """T6 as a stream: closed heartbeat sessions per event type (gap 3 minutes)."""
    from ..streaming.rates import sessions_stream

    root = scratch_path(spark, "stream-sessions")
    run_to_table(sessions_stream(event_stream(spark, sf_dir).select("ts", "event_type")), f"{root}/out", f"{root}/ck")
    return spark.read.parquet(f"{root}/out")


@query("stream_p95")
def q_stream_p95(spark, sf_dir):
    """T2 as a stream: approximate P95 latency per target and closed window."""
    from ..streaming.rates import p95_stream

    root = scratch_path(spark, "stream-p95")
    run_to_table(p95_stream(event_stream(spark, sf_dir).select("ts", "event_type", "value")), f"{root}/out", f"{root}/ck")
    return rounded(spark.read.parquet(f"{root}/out"))
