"""T1 and T2 as a metrics server measures them: rates of cumulative counters, quantiles from cumulative buckets.

A counter's samples grow until its process starts anew, when they begin at zero.  The increase over a window
is the sum of the steps between neighbouring samples in it, where a step down counts as the
whole new value.  A rate stretches the increase over the part of the window the samples don't reach: to an
edge nearer than 1.1 times the mean distance of samples, else by half that distance, and never to before the counter's zero.

The sample before each comes from ranges of the (series, time) order (``ordering.next_in_order``, latest first), and each
sample is added, with its step, to the evaluations whose window holds it, as plain sums: no series and no window has to fit a task, and
nothing is sorted once it is dealt to its evaluations.  Counters sampled together (the buckets of a histogram) are
columns of one sample.  Bucket rates add up over instances; a quantile is interpolated inside the bucket that holds its rank.

Defined results: null times and values are no samples; a null series key is a key; a window with one sample (or
several of one moment) has no rate; samples of one moment follow one another by value; an empty table has no window.
A quantile needs a +Inf bucket, is null where it is empty, and is the highest finite bound where the rank lies above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import next_in_order

WINDOW_SECONDS = 300
STEP_SECONDS = 60
NEAR = 1.1  # fixed value: an edge is near within this many mean distances


def increases(samples: DataFrame, series: Sequence[str], ts: str = "ts", value: str | Sequence[str] = "value", window: int = WINDOW_SECONDS, step: int = STEP_SECONDS) -> DataFrame:
    """Per series and evaluation (every ``step`` seconds, over the ``window`` seconds up to it): ``eval_us``,
    ``n_samples``, ``increase`` and ``rate`` per second.

    Several values are counters of one sample (a row without one of them is none): ``increase_<value>`` and ``rate_<value>`` of each."""
    values = [value] if isinstance(value, str) else list(value)
    places = range(len(values))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    present = F.col(ts).isNotNull()
    for c in values:
        present = present & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # latest first: the next row is the sample before
    rows = samples.filter(present).select(*series, (-us).alias("_us"), *[(-F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(values)])
    order = [*series, "_us", *[f"_v{i}" for i in places]]
    near = next_in_order(rows, order, order)
    same = F.lit(True)
    for c in series:
        same = same & F.col(f"_next_{c}").eqNullSafe(F.col(c))
    near = near.select(
        *series,
        (-F.col("_us")).alias("us"),
        F.when(same, -F.col("_next__us")).alias("us0"),
        *[(-F.col(f"_v{i}")).alias(f"v{i}") for i in places],
        *[F.when(F.col(f"_v{i}") > F.col(f"_next__v{i}"), -F.col(f"_v{i}")).otherwise(F.col(f"_next__v{i}") - F.col(f"_v{i}")).alias(f"grown{i}") for i in places],
    )
    tick = step * 1_000_000
    first = (F.floor((F.col("us") - 1) / tick) + 1).cast("bigint") * tick
    last = (F.floor((F.col("us") + window * 1_000_000 - 1) / tick)).cast("bigint") * tick
    each = near.withColumn("eval_us", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(tick).cast("bigint")))))
    joined = F.coalesce(F.col("us0") > F.col("eval_us") - window * 1_000_000, F.lit(False))  # the sample before is in the window too
    per = each.groupBy(*series, "eval_us").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("us").alias("from_us"),
        F.max("us").alias("to_us"),
        *[F.sum(F.when(~joined, F.col(f"v{i}"))).alias(f"first{i}") for i in places],  # one sample of a window
        *[F.coalesce(F.sum(F.when(joined, F.col(f"grown{i}"))), F.lit(0.0)).alias(f"increase{i}") for i in places],
    )
    per = per.filter((F.col("n_samples") > 1) & (F.col("to_us") > F.col("from_us")))
    covered = (F.col("to_us") - F.col("from_us")) / 1e6
    mean = covered / (F.col("n_samples") - 1)

    def reach(distance: Column) -> Column:
        return F.when(distance >= mean * NEAR, mean / 2).otherwise(distance)

    before = reach((F.col("from_us") - F.col("eval_us")) / 1e6 + float(window))
    after = reach((F.col("eval_us") - F.col("to_us")) / 1e6)

    def told(i: int) -> list[Column]:
        grown, start = F.col(f"increase{i}"), F.col(f"first{i}")
        zero = F.when((grown > 0) & (start >= 0), covered * start / grown)
        stretched = (covered + F.least(before, zero) + after) / covered
        end = "" if isinstance(value, str) else f"_{values[i]}"
        return [grown.alias(f"increase{end}"), (grown * stretched / float(window)).alias(f"rate{end}")]

    return per.select(*series, "eval_us", "n_samples", *[c for i in places for c in told(i)])


def bucket_quantile(rates: DataFrame, by: Sequence[str], q: float, le: str = "le", rate: str = "rate") -> DataFrame:
    """The ``q`` quantile per ``by`` from cumulative buckets (upper bound ``le``, +Inf included), whose rates are added first."""
    added = rates.groupBy(*by, le).agg(F.sum(rate).alias("c"))  # partial sums; instances merge by adding
    listed = added.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(le).cast("double").alias("le"), "c"))).alias("b"))  # a row per bound
    # counts of one moment can differ between instances: bounds above never hold less
    level = F.transform("b", lambda x, i: F.array_max(F.transform(F.slice("b", F.lit(1), i + 1), lambda y: y["c"])))
    df = listed.withColumn("c", level).withColumn("n", F.size("b")).withColumn("total", F.element_at("c", -1))
    rank = F.col("total") * q
    df = df.withColumn("at", F.array_position(F.transform("c", lambda x: x >= rank), True).cast("int"))
    bound, below = F.element_at("b", F.col("at"))["le"], F.get(F.transform("b", lambda x: x["le"]), F.col("at") - 2)
    under, here = F.coalesce(F.get("c", F.col("at") - 2), F.lit(0.0)), F.element_at("c", F.col("at"))
    lower = F.when(F.col("at") == 1, F.lit(0.0)).otherwise(below)
    inside = lower + (bound - lower) * (rank - under) / (here - under)
    whole = (F.element_at("b", -1)["le"] == float("inf")) & (F.col("total") > 0) & (F.col("n") > 1)
    value = F.when(F.col("at") == F.col("n"), below).when((F.col("at") == 1) & (bound <= 0), bound).otherwise(inside)
    return df.select(*by, F.when(whole, value).alias("quantile"))
