"""Mixing sources to target weights with hash thresholds.

Every document draws a 60-bit hash.  A source takes all its documents as often
as its target holds its size, and of the rest a share of them: those whose hash
lies under a threshold.  The threshold comes from histograms: sums of sizes by
source and hash bucket find the bucket in which the budget ends, and only that
bucket is counted again in finer ones.  Where the next document is too large for
what is left, a nested threshold goes on behind it among the documents that
still fit; ``ROUNDS`` of them bring a source within a small document of its
target.  Nothing is sorted: the last step is a filter on (source, hash, size).

Targets: all sizes together are shared by weight; a target stops at ``max_copies``
times its source's size and the excess goes to the others by weight, until none
is above.  That fixed point is found at once by ordering the sources by how early
they reach their stop.

Defined results: null texts have size 0 and are taken 0 words; a null source is a
source of its own, after all others; rows that repeat another in id and text draw
the same hash and are taken together; an empty table gives an empty result;
a result column replaces an input column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, join_small, staged

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
ROUNDS = 4
_COARSE, _FINE = 48, 32  # bits below a bucket of the first and of the refined histogram
_END = (1 << 60) - 1

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on id and text alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.
    The windows over all rows hold one row per source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    a = sizes.withColumn("w", weight.cast("bigint")).withColumn("cap", max_copies * F.col("source_size"))
    every = Window.partitionBy()
    by_stop = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    b = a.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    stops = (F.col("total") - F.col("cap_before")) * F.col("w") >= F.col("cap") * F.col("w_left")
    c = b.withColumn("stops", stops)
    free = F.sum("total").over(every) / F.count(F.lit(1)).over(every) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(every), F.lit(0))
    w_free = F.sum(F.when(~F.col("stops"), F.col("w"))).over(every)
    d = c.withColumns({"free": free.cast("bigint"), "w_free": w_free})
    share = (F.col("free") * F.col("w")).cast("double") / F.col("w_free").cast("double")
    return d.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def thresholds(drawn: DataFrame, goals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per source: ``whole`` copies of every document, and for each round the end
    ``cut<r>`` of its hashes (from the end of the round before) and the largest
    size ``fit<r>`` it takes.  ``drawn``: staged (source, size, h)."""
    state = goals.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint").alias("whole"),
        F.lit(-1).cast("bigint").alias("cut0"),
    )
    state = state.withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
    for r in range(1, rounds + 1):
        state = staged(state, "mix-state")
        now = state.select("source", F.col(f"cut{r - 1}").alias("cut"), "left")
        fits = join_small(drawn, now, ["source"], "inner").filter((F.col("h") > F.col("cut")) & (F.col("size") <= F.col("left")) & (F.col("size") > 0))
        up_to = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)

        def within(rows: DataFrame, bits: int, up_to=up_to) -> DataFrame:
            sums = rows.groupBy("source", F.shiftright("h", bits).alias("b"), "left").agg(F.sum("size").alias("s"))
            return sums.select("source", "b", "left", F.sum("s").over(up_to).alias("c"))

        # the bucket in which the budget ends; sources that take all that fits have none
        edge = within(fits, _COARSE).groupBy("source").agg(
            F.coalesce(F.max(F.when(F.col("c") <= F.col("left"), F.col("c"))), F.lit(0)).alias("under"),
            F.min(F.when(F.col("c") > F.col("left"), F.col("b"))).alias("edge"),
        )
        edge = staged(edge, "mix-edge")
        inner = join_small(fits.drop("left", "cut"), edge.join(now.select(F.col("source").alias("s_"), "left"), F.col("source").eqNullSafe(F.col("s_"))).select("source", "edge", (F.col("left") - F.col("under")).alias("left")), ["source"], "inner")
        inner = inner.filter(F.shiftright("h", _COARSE) == F.col("edge"))
        fine = within(inner, _FINE).groupBy("source").agg(
            F.max(F.when(F.col("c") <= F.col("left"), F.col("c"))).alias("more"),
            F.max(F.when(F.col("c") <= F.col("left"), F.col("b"))).alias("last"),
        )
        cuts = edge.join(fine.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")), "left").select(
            F.col("source").alias("s_"),
            (F.col("under") + F.coalesce("more", F.lit(0))).alias("got"),
            F.when(F.col("edge").isNull(), F.lit(_END))
            .otherwise(F.coalesce(F.shiftleft(F.col("last") + 1, _FINE), F.shiftleft("edge", _COARSE)) - 1)
            .alias("cut_"),
        )
        state = state.join(cuts, F.col("source").eqNullSafe(F.col("s_")), "left").select(
            *[c for c in state.columns if c != "left"],
            F.greatest(F.coalesce("cut_", F.lit(_END)), F.col(f"cut{r - 1}")).alias(f"cut{r}"),
            F.col("left").alias(f"fit{r}"),
            (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"),
        )
    return staged(state, "mix-state")


def _under(state: DataFrame) -> Column:
    """Whether a row of (size, h) beside its source's state is in the last, partial copy."""
    under = F.lit(False)
    for r in [int(c[3:]) for c in state.columns if c.startswith("fit")]:
        under |= (F.col("h") > F.col(f"cut{r - 1}")) & (F.col("h") <= F.col(f"cut{r}")) & (F.col("size") <= F.col(f"fit{r}"))
    if "add_size" in state.columns:
        under |= F.coalesce((F.col("size") == F.col("add_size")) & (F.col("h") == F.col("add_h")), F.lit(False))
    return under


def with_nearest(drawn: DataFrame, state: DataFrame) -> DataFrame:
    """The smallest document that is left out is taken as well where it brings the
    source nearer to its target than leaving it out (``add_size``, ``add_h``)."""
    out = join_small(drawn, state, ["source"], "inner").filter(~_under(state) & (F.col("size") > 0) & (F.col("left") > 0))
    least = out.groupBy("source").agg(F.min(F.struct("size", "h")).alias("m")).select(F.col("source").alias("s_"), "m")
    near = F.col("m.size") < 2 * F.col("left")
    joined = state.join(least, F.col("source").eqNullSafe(F.col("s_")), "left")
    return staged(joined.select(*state.columns, F.when(near, F.col("m.size")).alias("add_size"), F.when(near, F.col("m.h")).alias("add_h")), "mix-state")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None,
    weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES,
) -> DataFrame:
    """``keep`` columns (default: all) of every row with ``size``, ``source_size``,
    ``target`` (its source's), ``copies`` and ``taken`` (words, copies counted)."""
    cols = docs.columns if keep is None else keep
    drawn = docs.select(
        F.struct(*[col(c) for c in cols]).alias("row"),
        col(source).alias("source"), n_words(col(text)).alias("size"), draw(col(doc_id), col(text)).alias("h"),
    )
    narrow = staged(drawn.drop("row"), "mix-draws")
    goals = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    state = with_nearest(narrow, thresholds(narrow, staged(goals, "mix-targets")))
    copies = F.when(F.col("size") > 0, F.col("whole") + _under(state).cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    results = [("size", F.col("size")), ("source_size", F.col("source_size")), ("target", F.col("target")), ("copies", copies), ("taken", copies * F.col("size"))]
    names = {n for n, _ in results}
    joined = join_small(drawn, state, ["source"])
    return joined.select(*[F.col("row")[c].alias(c) for c in cols if c.lower() not in names], *[c.alias(n) for n, c in results])
