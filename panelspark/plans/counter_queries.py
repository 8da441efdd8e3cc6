"""T1 and T2 on counters: every event is a sample of its type's counters, which start anew each day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.counters import bucket_quantile, increases
from ..operators.monitoring import P95_LATENCY_LIMIT
from . import driver_tables as D
from .catalog import query, rounded
from .oracle import SQL, r4

BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]


def _when(us):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


@query("counter_rate_5m")
def q_counter_rate_5m(spark, sf_dir):
    """Requests a second per target from cumulative counters that reset at midnight."""
    ev = D.events(spark, sf_dir).select("event_type", "ts", "event_id")
    day = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    samples = ev.withColumn("total", F.row_number().over(day))
    out = increases(samples, ["event_type"], "ts", "total")
    return rounded(out.select("event_type", _when("eval_us").alias("eval_time"), "n_samples", "increase", "rate"))


@query("bucket_p95_5m")
def q_bucket_p95_5m(spark, sf_dir):
    """P95 over all targets, interpolated in the buckets of their latency histograms, with the alert's limit."""
    ev = D.events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    day = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bounds = [*BOUNDS, float("inf")]
    held = F.transform(F.array(*[F.lit(b) for b in bounds]), lambda b: F.struct(b.alias("le"), (F.coalesce(F.col("value"), F.lit(0.0)) <= b).cast("bigint").alias("one")))
    totals = [F.sum(F.get(held, F.lit(i))["one"]).over(day) for i in range(len(bounds))]
    names = [f"le{i}" for i in range(len(bounds))]
    # an event samples all buckets of its type at once
    rates = increases(ev.select("event_type", "ts", *[t.alias(n) for n, t in zip(names, totals, strict=True)]), ["event_type"], "ts", names)
    each = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"rate_{n}").alias("rate")) for b, n in zip(bounds, names, strict=True)])
    rates = rates.select("event_type", "eval_us", F.inline(each))
    out = bucket_quantile(rates, ["eval_us"], 0.95)
    return rounded(out.select(_when("eval_us").alias("eval_time"), F.col("quantile").alias("p95"), (F.col("quantile") > P95_LATENCY_LIMIT).alias("breach")))


def _rates(series: str) -> str:
    return f"""
pairs AS (SELECT *, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER s AS us2, lead(v) OVER s AS v2 FROM samples WINDOW s AS (PARTITION BY {series} ORDER BY ts, v)),
placed AS (SELECT *, unnest(range(((us - 1) // 60000000 + 1) * 60000000, us + 300000000, 60000000)) AS e FROM pairs),
per AS (SELECT {series}, e, count(*) AS n, min(us) AS a, max(us) AS z, arg_min(v, (us, v)) AS v0,
        coalesce(sum(CASE WHEN us2 <= e THEN CASE WHEN v2 < v THEN v2 ELSE v2 - v END END), 0) AS inc FROM placed GROUP BY ALL HAVING count(*) > 1 AND max(us) > min(us)),
spans AS (SELECT *, (z - a) / 1e6 AS covered, (z - a) / 1e6 / (n - 1) AS mean, (a - e) / 1e6 + 300 AS before, (e - z) / 1e6 AS behind FROM per),
rates AS (SELECT {series}, e, n, inc, inc / 300 / covered * (covered
    + least(CASE WHEN before >= 1.1 * mean THEN mean / 2 ELSE before END, CASE WHEN inc > 0 THEN covered * v0 / inc END)
    + CASE WHEN behind >= 1.1 * mean THEN mean / 2 ELSE behind END) AS rate FROM spans)"""


SQL["counter_rate_5m"] = f"""WITH samples AS (
    SELECT event_type, ts, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS v FROM events),{_rates("event_type")}
SELECT event_type, strftime(make_timestamp(e), '%Y-%m-%d %H:%M:%S') AS eval_time, n AS n_samples, CAST(inc AS DOUBLE) AS increase, {r4("rate")} AS rate FROM rates"""

SQL["bucket_p95_5m"] = f"""WITH samples AS (
    SELECT event_type, le, ts, sum(CASE WHEN coalesce(value, 0) <= le THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, le, date_trunc('day', ts) ORDER BY ts, event_id) AS v
    FROM events, unnest([{", ".join(f"{b}::DOUBLE" for b in BOUNDS)}, 'inf'::DOUBLE]) AS b(le)),{_rates("event_type, le")},
added AS (SELECT e, le, sum(rate) AS c FROM rates GROUP BY e, le),
stacked AS (SELECT e, le, max(c) OVER u AS c, lag(le, 1, 0) OVER u AS lower FROM added WINDOW u AS (PARTITION BY e ORDER BY le ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY e ORDER BY le) AS under, 0.95 * max(c) OVER (PARTITION BY e) AS rank FROM stacked),
hit AS (SELECT * FROM ranked WHERE c >= rank QUALIFY row_number() OVER (PARTITION BY e ORDER BY le) = 1),
found AS (SELECT e, CASE WHEN rank <= 0 THEN NULL WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (rank - under) / (c - under) END AS p FROM hit)
SELECT strftime(make_timestamp(e), '%Y-%m-%d %H:%M:%S') AS eval_time, {r4("p")} AS p95, p > 2.0 AS breach FROM found"""
