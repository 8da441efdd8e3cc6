"""Exact quantiles, global and by group, by radix refinement.

Spark's exact ``median`` / ``percentile`` aggregate merges a value -> count map of a
group into one final task, which is unbounded for a hot group or a whole
column.  Here a value becomes a 64-bit key of the same order (its bits, those of negative numbers
turned over).  The first pass counts rows per (group, leading 16 bits), combined map-side, with the least and
largest value; running sums over a group's at most 65,536 buckets find the bucket that
holds a wanted rank.  A bucket of one or two rows, or of one value, gives it at once; only rows of the
others are counted again by their next 16 bits, so four passes settle any table and most need one or two.  No
row is sorted.  Groups of at most ``DIRECT`` values, counted before, go through the built-in aggregate, which gives
the same (their maps are bounded); no task holds more than a group's buckets, whatever the values are (infinite ones and the ends of
the double range included); null group keys are groups, null and NaN values are no values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_double
from ..session import scratch_path
from .joins import measured

# Values a group may have for the built-in aggregate, and values of all columns together for a few global ones.
DIRECT = 50_000
DIRECT_COLUMNS = 1_000_000
_DIGIT = 16
_LEVELS = 64 // _DIGIT


def order_key(x: Column) -> Column:
    """Bigint with the order of a double (-0.0 as 0.0)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x, F.lit(0.0)) + F.lit(0.0)).cast("bigint")
    return F.when(x.isNotNull(), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1))))


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join with a written table of few rows per group; its other columns are new."""
    names = [f"_k_{k}" for k in keys]
    right = side.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(f"`{c}`") for c in side.columns if c not in keys])
    right = F.broadcast(right) if measured(side) is not None else right
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in zip(keys, names, strict=True)]
    condition = F.lit(True)
    for c in on:
        condition = condition & c
    return df.join(right, condition, how).drop(*names)


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """One row per group: ``keys``, ``_n`` (values) and ``_v0``, ``_v1``, ...: the
    value at the 0-based rank ``ranks[i](_n)`` of the sorted group (null without values)."""
    keys = list(keys)
    rows = df.select(*[F.col(f"`{k}`") for k in keys], clean_double(F.col(f"`{value}`")).alias("_value"))
    keyed = rows.withColumn("_key", order_key(F.col("_value")))
    settled: list[DataFrame] = []
    groups = open_ = None
    for level in range(_LEVELS):
        shift = 64 - _DIGIT * (level + 1)
        digits = F.shiftright("_key", shift)
        parent = F.lit(0).cast("bigint") if not level else F.shiftright("_at", _DIGIT)
        if level:
            # rows of the buckets that still hold a wanted rank
            wanted = open_.select(*[F.col(f"`{k}`") for k in keys], "_parent").distinct()
            keyed = _join(keyed.withColumn("_parent", F.shiftright("_key", shift + _DIGIT)), wanted, [*keys, "_parent"]).drop("_parent")
            keyed = _written(keyed) if level == 1 else keyed
        counted = keyed.groupBy(*keys, digits.alias("_at")).agg(
            F.count("_key").alias("_c"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")
        )
        counted = counted.withColumn("_parent", parent)
        same = Window.partitionBy(*keys, "_parent")
        counted = counted.withColumn("_before", F.sum("_c").over(same.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
        if not level:
            counted = _written(counted.withColumn("_n", F.sum("_c").over(same)))
            groups = counted.groupBy(*keys).agg(F.max("_n").alias("_n"))
            asked = F.array(*[F.struct(F.lit(i).alias("_i"), rank(F.col("_n")).cast("bigint").alias("_r")) for i, rank in enumerate(ranks)])
            placed = counted.withColumn("_w", F.explode(asked)).select("*", "_w.*").drop("_w", "_n")
        else:
            placed = _join(counted, open_, [*keys, "_parent"])
        held = placed.filter((F.col("_c") > 0) & (F.col("_before") <= F.col("_r")) & (F.col("_r") < F.col("_before") + F.col("_c")))
        held = held.withColumn("_r", F.col("_r") - F.col("_before"))
        known = (F.col("_lo") == F.col("_hi")) | (F.col("_c") == 2)
        held = _written(held.select(*[F.col(f"`{k}`") for k in keys], "_i", "_r", "_at", known.alias("_known"), F.when(F.col("_r") == 0, F.col("_lo")).otherwise(F.col("_hi")).alias("_v")))
        settled.append(held.filter("_known").select(*[F.col(f"`{k}`") for k in keys], "_i", "_v"))
        open_ = held.filter(~F.col("_known")).select(*[F.col(f"`{k}`") for k in keys], F.col("_at").alias("_parent"), "_i", "_r")
        if open_.isEmpty():
            break
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    # null-safe by construction: groups without values come along as rows without a rank
    blank = groups.select(*[F.col(f"`{k}`") for k in keys], F.lit(None).cast("int").alias("_i"), F.lit(None).cast("double").alias("_v"), "_n")
    both = found.withColumn("_n", F.lit(None).cast("bigint")).unionByName(blank)
    return both.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_v{i}") for i in range(len(ranks))])


def _position(p: float) -> Callable[[Column], Column]:
    return lambda n: (n - F.lit(1)).cast("double") * F.lit(float(p))


def grouped_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str = "percentile") -> DataFrame:
    """Exact percentile of ``value`` per group of ``keys``: linear interpolation between
    the values at ranks floor and ceil of ``p * (n - 1)``; null for a group without values."""
    keys = list(keys)
    named = [F.col(f"`{k}`") for k in keys]
    clean = df.select(*named, clean_double(F.col(f"`{value}`")).alias("_value"))
    large = _written(clean.groupBy(*keys).agg(F.count("_value").alias("_n")).filter(F.col("_n") > DIRECT))
    if large.isEmpty():
        return clean.groupBy(*keys).agg(F.percentile("_value", float(p)).alias(out))
    refined = _refined(_join(clean, large.select(*named), keys, "left_semi"), keys, "_value", p, out)
    return _join(clean, large.select(*named), keys, "left_anti").groupBy(*keys).agg(F.percentile("_value", float(p)).alias(out)).unionByName(refined)


def _refined(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    named = [F.col(f"`{k}`") for k in keys]
    at = _position(p)
    ranked = ranked_values(df, keys, value, [lambda n: F.floor(at(n)), lambda n: F.ceil(at(n))])
    pos, lv, hv = at(F.col("_n")), F.col("_v0"), F.col("_v1")
    lo, hi = F.floor(pos), F.ceil(pos)
    interp = (hi - pos) * lv + (pos - lo) * hv
    return ranked.select(*named, F.when((hi == lo) | (lv == hv), lv).otherwise(interp).alias(out))


def exact_quantiles(df: DataFrame, cols: Sequence[str], prob: float) -> dict[str, float | None]:
    """Linear-interpolated quantile per column; None for a column without values."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    stacked = df.select(F.explode(F.array(*pairs)).alias("s")).select("s.column", "s.value")
    # the columns may be dear to compute, and every pass reads them
    stacked = _written(stacked)
    if stacked.count() <= DIRECT_COLUMNS:
        cleaned = stacked.select("column", clean_double(F.col("value")).alias("value"))
        found = cleaned.groupBy("column").agg(F.percentile("value", float(prob)).alias("q"))
    else:
        found = _refined(stacked, ["column"], "value", prob, "q")
    rows = found.collect()  # one row per column
    found = {r["column"]: r["q"] for r in rows}
    return {c: found.get(c) for c in cols}


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact interpolating median per column (mean of the two middle values)."""
    return exact_quantiles(df, cols, 0.5)


def value_at_rank(df: DataFrame, column: str, rank: int) -> float | None:
    """The value at a 0-based rank of a column."""
    one = df.select(F.lit(0).alias("_g"), F.col(column))
    found = ranked_values(one, ["_g"], column, [lambda n: F.lit(int(rank))]).collect()  # one row
    return found[0]["_v0"] if found else None
