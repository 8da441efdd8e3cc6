"""Stored summaries that merge without rereading rows: quantile sketches (A3, A4) and daily histograms.

``sketched`` keeps one KLL sketch per key, time stretch and column; ``merged_quantile`` merges any of
them.  A sketch of at most ``SKETCH_K`` values holds them all, so its quantile is exact (the least value with
that share of the values at or below it); of more, its rank is off by at most ``RANK_ERROR`` of the count, with 99 % confidence.

``daily`` keeps one histogram per day and column whose bins are [b * 2^e, (b + 1) * 2^e); e is the least
exponent with which the day's range takes about ``BINS`` bins.  A wider bin of another power of two is a
whole number of narrower ones, so histograms of any days merge by coarsening to the widest, and the bins of a merge
are those of the raw rows.  At most BINS + 2 rows a day and column, whatever the rows.

NaN and null are no values; infinite values count in the day's outermost bins (a day of only infinite
ones has none); null days and keys are groups of their own; empty tables have no summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_double
from ..params import DRIFT_PSI_THRESHOLD, PSI_FLOOR
from .joins import lookup

# Own choices.
SKETCH_K = 200
RANK_ERROR = 0.0167
BINS = 128
PSI_MAX_BINS = 16
# Exponents below the largest value's that still give whole numbers of 64 bits; the exponent of a day of zeros.
_DIGITS, _ZEROS = 50, -1000


def _stacked(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), clean_double(c).alias("x")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.feature", "s.x").filter(F.col("x").isNotNull())


def sketched(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(keys, feature, n, sketch), combined map-side."""
    return _stacked(df, keys, columns).groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch")
    )


def merged(sketches: DataFrame, keys: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    return sketches.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def merged_quantile(sketches: DataFrame, keys: Sequence[str], share: float = 0.5, k: int = SKETCH_K) -> DataFrame:
    """(keys, feature, n, value) of the sketches of all stretches of a key."""
    return merged(sketches, keys, k).select(*keys, "feature", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("value"))


def _exponent(lo: Column, hi: Column, bins: int) -> Column:
    """Width of about ``bins`` bins between the ends, and no finer than 64 bits can number."""
    largest = F.greatest(F.abs(lo), F.abs(hi))
    by_range = F.when(hi > lo, F.ceil(F.log2(hi / (bins - 1) - lo / (bins - 1)))).otherwise(F.lit(_ZEROS))
    by_digits = F.when(largest > 0, F.floor(F.log2(largest)) - _DIGITS).otherwise(F.lit(_ZEROS))
    return F.greatest(by_range, by_digits, F.lit(_ZEROS)).cast("int")


def daily(df: DataFrame, day: str, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(day, feature, e, bin, n)."""
    finite = lambda c: F.when(F.abs(clean_double(c)) < F.lit(float("inf")), clean_double(c))
    ends = df.groupBy(day).agg(*[f(finite(c)).alias(f"__{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    # null days would not meet their ends
    told = lookup(df.select(F.struct(day).alias("__d"), *columns), ends.select(F.struct(day).alias("__d"), *[c for c in ends.columns if c != day]), ["__d"])

    def place(i: int, c: str) -> Column:
        lo, hi = F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        e = _exponent(lo, hi, bins)
        x = F.least(F.greatest(clean_double(c), lo), hi)
        at = F.when(clean_double(c).isNotNull() & lo.isNotNull(), F.floor(x / F.pow(F.lit(2.0), e)).cast("bigint"))
        return F.struct(F.lit(c).alias("feature"), e.alias("e"), at.alias("bin"))

    cells = told.select(F.col("__d")[day].alias(day), F.explode(F.array(*[place(i, c) for i, c in enumerate(columns)])).alias("s"))
    return cells.select(day, "s.*").filter(F.col("bin").isNotNull()).groupBy(day, "feature", "e", "bin").agg(F.count(F.lit(1)).alias("n"))


def coarsened(histograms: DataFrame, keys: Sequence[str] = (), counts: Sequence[str] = ("n",), bins: int = BINS) -> DataFrame:
    """Histograms of the same key and feature as one, of at most ``bins`` bins."""
    part = Window.partitionBy(*keys, "feature")
    # rows of days and bins, not of the table
    widest = histograms.withColumn("__e", F.max("e").over(part)).withColumn("bin", F.expr("shiftright(bin, least(__e - e, 63))"))
    cells = widest.groupBy(*keys, "feature", F.col("__e").alias("e"), "bin").agg(*[F.sum(c).alias(c) for c in counts])
    lo, hi = F.min("bin").over(part), F.max("bin").over(part)
    more = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda s: F.call_function("shiftright", F.col("__hi"), s) - F.call_function("shiftright", F.col("__lo"), s) < bins))
    wide = cells.withColumns({"__lo": lo, "__hi": hi}).withColumn("__s", more)
    return wide.groupBy(*keys, "feature", (F.col("e") + F.col("__s")).alias("e"), F.call_function("shiftright", F.col("bin"), F.col("__s")).alias("bin")).agg(
        *[F.sum(c).alias(c) for c in counts]
    )


def window_psi(
    reference: DataFrame, current: DataFrame, bins: int = PSI_MAX_BINS, floor: float = PSI_FLOOR, threshold: float = DRIFT_PSI_THRESHOLD
) -> DataFrame:
    """D2 on stored histograms of any two runs of days: (feature, n_reference, n_current, psi, drifted)
    over at most ``bins`` bins; a feature without values on a side has no row."""
    sides = reference.select("feature", "e", "bin", F.col("n").alias("q"), F.lit(0).cast("bigint").alias("p")).unionByName(
        current.select("feature", "e", "bin", F.lit(0).cast("bigint").alias("q"), F.col("n").alias("p"))
    )
    cells = coarsened(sides, counts=("q", "p"), bins=bins)
    part = Window.partitionBy("feature")  # at most ``bins`` rows
    cells = cells.withColumns({"n_reference": F.sum("q").over(part), "n_current": F.sum("p").over(part)}).filter("n_reference > 0 and n_current > 0")
    p, q = (F.greatest(F.col(c) / F.col(n), F.lit(floor)) for c, n in (("p", "n_current"), ("q", "n_reference")))
    out = cells.groupBy("feature", "n_reference", "n_current").agg(F.sum((p - q) * F.log(p / q)).alias("psi"))
    return out.withColumn("drifted", F.col("psi") >= F.lit(threshold))
