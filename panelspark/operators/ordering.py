"""Dense arrival numbers without a single-partition window.

The rows are range-partitioned on the order (Spark samples the order key
and cuts it into contiguous ranges of about equal row counts), sorted
inside each range, and numbered there; a small table with one row per
range (its row count) gives each range's offset by a running sum.  A hot
hour, key or micro-batch is split over many ranges like any other stretch
of the order, so no task holds more than about one range.

Spark samples the range bounds anew each time the exchange runs, so the
numbered rows are written once (a table in the shared checkpoint folder)
and both the per-range counts and the numbers are read from that one
copy.  The number of a row is the count of rows before it in the order,
whatever the range bounds are, so it depends only on the data (a
recomputed task after a lost executor yields the same numbers) as long as
``order`` is a total order (break ties with a unique column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# monotonically_increasing_id: partition index above bit 33, row index in the partition below
_ROW_BITS = 33


def _c(name: str):
    return F.col(f"`{name}`")


def ranged(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows with ``_range`` (index of their contiguous range of the order)
    and ``_pos`` (position inside the range), written once and read back.

    ``partitions``: number of ranges (default: the session's shuffle
    partition count, which is sized from the input).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    mid = F.col("_mid")
    return spark.read.parquet(path).select(
        *[_c(c) for c in df.columns],
        F.shiftright(mid, _ROW_BITS).alias("_range"),
        mid.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_pos"),
    )


def dense_index(
    df: DataFrame, order: Sequence[str], out: str = "seq", start: int = 0, partitions: int | None = None
) -> DataFrame:
    """Adds ``out`` = 0-based position of the row in ``order`` (plus ``start``)."""
    r = ranged(df, order, partitions)
    counts = r.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range (<= n rows): a global running sum over it is cheap
    w_off = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    return (
        r.join(F.broadcast(offsets), on="_range", how="inner")
        .withColumn(out, F.col("_off") + F.col("_pos") + F.lit(start))
        .drop("_range", "_pos", "_off")
    )


def next_in_order(df: DataFrame, order: Sequence[str], values: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Adds ``_next_<c>`` for each of ``values``: the columns of the following
    row in ``order`` (null for the last row).

    Inside a range by ``lead``; for the last row of a range, the first row
    of the next non-empty range, from a table with one row per range.
    """
    r = ranged(df, order, partitions)
    w = Window.partitionBy("_range").orderBy("_pos")
    inner = r.select(
        *[_c(c) for c in df.columns],
        "_range",
        F.lead("_pos").over(w).isNull().alias("_last"),
        *[F.lead(_c(c)).over(w).alias(f"_in_{c}") for c in values],
    )
    w_r = Window.orderBy("_range")  # one row per range (<= n rows)
    firsts = r.filter(F.col("_pos") == 0).select("_range", *[F.lead(_c(c)).over(w_r).alias(f"_nr_{c}") for c in values])
    return inner.join(F.broadcast(firsts), on="_range", how="left").select(
        *[_c(c) for c in df.columns],
        *[F.when(F.col("_last"), _c(f"_nr_{c}")).otherwise(_c(f"_in_{c}")).alias(f"_next_{c}") for c in values],
    )
