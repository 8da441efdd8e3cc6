"""T4, D4 and T6 with keyed state: drift reports per target, silent keys by timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz_literal
from ..operators.drift import psi_grouped
from ..params import DRIFT_REFERENCE_MIN_ROWS
from ..session import scratch_path
from ..streaming.keyed import count_windows, run_keyed, silences
from ..streaming.rates import event_stream
from . import driver_tables as D
from .catalog import query, rounded
from .oracle import SQL, _psi_bin, r4


@query("stream_drift_keyed")
def q_stream_drift_keyed(spark, sf_dir):
    """A drift report per target and 20 of its rows, against the first week of events."""
    stream = event_stream(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    windows = run_keyed(count_windows(stream, "event_type", ["ts", "event_id"], ["value"], DRIFT_REFERENCE_MIN_ROWS), scratch_path(spark, "stream-keyed"))
    ev = D.events(spark, sf_dir).select("ts", "value")
    first = ev.agg(F.min(F.date_trunc("day", "ts"))).first()[0]
    reference = ev.filter(F.datediff(F.date_trunc("day", "ts"), ntz_literal(first)) < 7)
    named = windows.select(F.concat_ws(":", "event_type", "window_no").alias("report"), "value", "event_id")
    # a window's rows are few and fixed: combined before the shuffle
    sums = named.groupBy("report").agg(F.count(F.lit(1)).alias("n_rows"), F.max("event_id").alias("last_event"), F.avg("value").alias("mean_value"))
    per = psi_grouped(reference, named.select("report", "value"), "report", ["value"])
    return rounded(sums.join(per.select("report", "psi", "drifted"), "report"))


@query("stream_open_absence")
def q_stream_open_absence(spark, sf_dir):
    """Users without an event for 3 minutes once the watermark has passed that."""
    stream = event_stream(spark, sf_dir).select("user_id", "ts")
    return run_keyed(silences(stream, "user_id"), scratch_path(spark, "stream-silence"))


SQL["stream_drift_keyed"] = f"""
WITH fd AS (SELECT min(date_trunc('day', ts)) AS d FROM events),
rs AS (SELECT CAST(value AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS cat FROM events, fd WHERE date_diff('day', fd.d, date_trunc('day', ts)) < 7 AND value IS NOT NULL),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM rs),
rc AS (SELECT {_psi_bin("rs")} AS bin, count(*) AS n FROM rs, rng GROUP BY 1),
rq AS (SELECT bin, greatest(n / sum(n) OVER (), 1e-4) AS q FROM rc),
num AS (SELECT event_type, event_id, value, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY event_type) // 20 AS n_full
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
cs AS (SELECT concat(event_type, ':', seq // 20) AS report, event_id, CAST(value AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS cat FROM num WHERE seq // 20 < n_full),
sums AS (SELECT report, count(*) AS n_rows, max(event_id) AS last_event, avg(x) AS mean_value FROM cs GROUP BY report),
cc AS (SELECT report, {_psi_bin("cs")} AS bin, count(*) AS n FROM cs, rng WHERE x IS NOT NULL GROUP BY ALL),
cp AS (SELECT report, bin, greatest(n / sum(n) OVER (PARTITION BY report), 1e-4) AS p FROM cc),
per AS (SELECT report, sum((p - coalesce(q, 1e-4)) * ln(p / coalesce(q, 1e-4)) - coalesce((1e-4 - q) * ln(1e-4 / q), 0))
    + (SELECT sum((1e-4 - q) * ln(1e-4 / q)) FROM rq) AS psi FROM cp LEFT JOIN rq USING (bin) GROUP BY report)
SELECT report, n_rows, last_event, {r4("mean_value")} AS mean_value, {r4("psi")} AS psi, psi >= 0.2 AS drifted FROM sums JOIN per USING (report)"""

SQL["stream_open_absence"] = """
WITH last AS (SELECT user_id, max(ts) AS last_ts, count(*) AS n_events FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)
SELECT user_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_seen, n_events FROM last
WHERE epoch_ms(last_ts) + 180000 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000"""
