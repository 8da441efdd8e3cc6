"""Service-metric queries in batch form.

Sliding windows (5 minutes every minute) are Spark's ``window`` (an
expand into the five windows an event belongs to, then a partial
aggregated groupBy): no per-key ordering, no single task.  The sustained
condition (T5) uses the same trick on the breaching evaluations: each
breach counts for the next ``for`` evaluations, a firing evaluation is one
that collects all of them.  Gaps between heartbeats (T6) come from the
next row in (key, time) order over range partitions of that order, so no
key's whole history (nor a hot hour of it) has to sit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup
from .ordering import next_in_order
from .quantiles import grouped_percentile

WINDOW = "5 minutes"
SLIDE = "1 minute"
WINDOW_SECONDS = 300
ERROR_RATIO_LIMIT = 0.1  # fixed value: 5xx ratio alert above 10 %
P95_LATENCY_LIMIT = 2.0  # fixed value: P95 latency alert above 2 s
SUSTAIN_EVALUATIONS = 5  # fixed value: `for: 5m` at one evaluation per minute


def _fmt(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sliding(df: DataFrame, ts: str = "ts", window: str = WINDOW, slide: str = SLIDE) -> Column:
    return F.window(F.col(ts), window, slide)


def request_rate(df: DataFrame, target: str = "event_type", ts: str = "ts") -> DataFrame:
    """Requests per second per target over 5-minute windows sliding by 1 minute."""
    return (
        df.groupBy(sliding(df, ts).alias("w"), F.col(target))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            _fmt(F.col("w.start")).alias("window_start"),
            F.col(target),
            "n",
            (F.col("n") / F.lit(float(WINDOW_SECONDS))).alias("rate"),
        )
    )


def latency_p95(
    df: DataFrame, target: str = "event_type", latency: str = "value", ts: str = "ts", approx: bool = False
) -> DataFrame:
    """P95 latency per target and window, with the 2 s breach flag.

    Exact and interpolated by default (``quantiles.grouped_percentile``:
    ranks from (window, target, latency) counts over range partitions, so
    a hot window is spread over many tasks); ``approx=True`` switches to
    ``percentile_approx`` (bounded sketch per group, one pass).
    """
    if approx:
        p95 = (
            df.groupBy(sliding(df, ts).alias("w"), F.col(target))
            .agg(F.percentile_approx(F.col(latency), 0.95, 10000).cast("double").alias("p95"))
            .select(F.col("w.start").alias("_start"), target, "p95")
        )
    else:
        ev = df.select(sliding(df, ts)["start"].alias("_start"), F.col(target), F.col(latency))
        p95 = grouped_percentile(ev, ["_start", target], latency, 0.95, "p95")
    return p95.select(
        _fmt(F.col("_start")).alias("window_start"),
        F.col(target),
        "p95",
        (F.col("p95") > F.lit(P95_LATENCY_LIMIT)).alias("breach"),
    )


def latency_p95_all(df: DataFrame, latency: str = "value", ts: str = "ts") -> DataFrame:
    """T2 over all targets (the alert rule's form): exact P95 per window with the breach flag."""
    ev = df.select(sliding(df, ts)["start"].alias("_start"), F.col(latency))
    return grouped_percentile(ev, ["_start"], latency, 0.95, "p95").select(
        "_start",
        _fmt(F.col("_start")).alias("window_start"),
        "p95",
        (F.col("p95") > F.lit(P95_LATENCY_LIMIT)).alias("breach"),
    )


def error_ratio(df: DataFrame, is_error: Column, ts: str = "ts") -> DataFrame:
    """Error ratio per window over all targets, with the 10 % breach flag."""
    return (
        df.groupBy(sliding(df, ts).alias("w"))
        .agg(F.sum(is_error.cast("long")).alias("n_error"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").alias("_start"),
            _fmt(F.col("w.start")).alias("window_start"),
            "n_error",
            "n",
            (F.col("n_error") / F.col("n")).alias("error_ratio"),
        )
        .withColumn("breach", F.col("error_ratio") > F.lit(ERROR_RATIO_LIMIT))
    )


def sustained(breaches: DataFrame, start: str = "_start", keys: tuple[str, ...] = (), n: int = SUSTAIN_EVALUATIONS) -> DataFrame:
    """T5: evaluations where the condition held in each of the last ``n`` evaluations.

    Each breaching evaluation at minute b counts for evaluations b .. b+n-1;
    an evaluation is firing when it collects n counts (distributed groupBy).
    """
    shifts = F.sequence(F.lit(0), F.lit(n - 1))
    exp = breaches.filter(F.col("breach")).select(
        *keys, F.explode(shifts).alias("_k"), F.col(start).alias("_b")
    )
    ev = exp.select(*keys, (F.col("_b") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_k"))).alias("_eval"))
    fired = ev.groupBy(*keys, "_eval").agg(F.count(F.lit(1)).alias("n_consecutive")).filter(
        F.col("n_consecutive") == F.lit(n)
    )
    prev = fired.select(*keys, (F.col("_eval") + F.expr("INTERVAL 1 MINUTE")).alias("_eval"), F.lit(False).alias("_s"))
    out = fired.join(prev, on=[*keys, "_eval"], how="left")
    return out.select(
        *keys,
        _fmt(F.col("_eval")).alias("eval_start"),
        "n_consecutive",
        F.coalesce(F.col("_s"), F.lit(True)).alias("alert_start"),
    )


def next_event(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Adds ``_next``: the key's next event time.

    The events are cut into contiguous ranges of the (key, time) order
    (``ordering.next_in_order``), so a hot key is spread over many tasks;
    the following row belongs to the same key or the key has no next event.
    """
    nxt = next_in_order(df.select(key, ts), [key, ts], [key, ts])
    same = F.col(f"_next_{key}").eqNullSafe(F.col(key))
    return nxt.select(key, ts, F.when(same, F.col(f"_next_{ts}")).alias("_next"))


def absences(df: DataFrame, key: str = "event_type", ts: str = "ts", gap_minutes: int = 3) -> DataFrame:
    """Gaps without any event of a key longer than ``gap_minutes``."""
    nxt = next_event(df.select(key, ts), key, ts)
    gap = F.expr(f"timestampdiff(MICROSECOND, {ts}, _next)")
    return (
        nxt.filter(F.col("_next").isNotNull())
        .withColumn("_gap_us", gap)
        .filter(F.col("_gap_us") > F.lit(gap_minutes * 60 * 1_000_000))
        .select(
            F.col(key),
            _fmt(F.col(ts)).alias("gap_start"),
            _fmt(F.col("_next")).alias("gap_end"),
            (F.col("_gap_us") / F.lit(1e6)).alias("gap_seconds"),
        )
    )


def open_absences(df: DataFrame, now, key: str = "event_type", ts: str = "ts", gap_minutes: int = 3) -> DataFrame:
    """T6, still open: keys whose last event is more than ``gap_minutes`` before ``now``
    (the evaluation time, e.g. the newest event seen).  One row per key."""
    from ..functions.columns import ntz_literal

    last = df.groupBy(key).agg(F.max(ts).alias("_last"))
    gap = F.timestamp_diff("MICROSECOND", F.col("_last"), ntz_literal(now))
    return last.filter(gap > F.lit(gap_minutes * 60 * 1_000_000)).select(
        F.col(key), _fmt(F.col("_last")).alias("last_seen"), (gap / F.lit(1e6)).alias("silent_seconds")
    )


def scored_log(df: DataFrame, target: str = "event_type", latency: str = "value") -> DataFrame:
    """T8 + W2: per-target counts and mean latency broadcast back to each row.

    Aggregate + join (the aggregate has one row per target) instead of an
    unbounded window over a target's rows.
    """
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_target"), F.avg(latency).alias("mean_latency"))
    return lookup(df, per, [target])
