"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard: at each level every child draws a
number from the document's id and the child's own name, divided by the child's
weight (the sum of the weights below it), and the lowest draw wins.  A draw depends
on nothing but id, name and weight, so a change of weights moves documents only
into or out of the subtrees whose weights changed.  Shards that are added open a
region of their own (``grown``), so that the added shard takes documents only into
itself and no others move.

Slots number the documents of each shard from 0 by (id, size, text checksum): the
rows are cut into ranges of that order and every range starts at the sum of the
ranges before it, so that no shard is gathered in one task.

Defined results: null texts have no bytes; null ids draw as the text ``null``;
rows that repeat an id go to one shard and get slots of their own; an empty table
gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranged
from .common import col, join_small, staged

Tree = list[list[list[float]]]  # regions, racks, weights of shards


def tree(shards: int = 24, racks: int = 2, per_rack: int = 4) -> Tree:
    """Regions of ``racks`` times ``per_rack`` shards of weight 1; the last region may be smaller."""
    full = [[1.0] * per_rack for _ in range(racks)]
    out = [[list(r) for r in full] for _ in range(shards // (racks * per_rack))]
    left = shards - len(out) * racks * per_rack
    if left:
        out.append([[1.0] * min(per_rack, left - i) for i in range(0, left, per_rack)])
    return out


def grown(old: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*old, [[weight]]]


def _lowest(weights: Column, doc: Column, level: str, *path: Column) -> Column:
    """Index of the child whose weighted draw is lowest."""

    def score(w: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(level), *path, i, doc)
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / w).alias("s"), i.alias("i"))

    return F.array_min(F.transform(weights, score))["i"]


def shard(df: DataFrame, doc: Column, of: Tree, out: str) -> DataFrame:
    """Adds ``out``: the number of the document's shard, counted through the tree."""
    weights = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    regions = weights([sum(map(sum, region)) for region in of])
    racks = F.array(*[weights(map(sum, region)) for region in of])
    leaves = F.array(*[F.array(*[weights(rack) for rack in region]) for region in of])
    first, n = [], 0
    for region in of:
        starts = []
        for rack in region:
            starts.append(n)
            n += len(rack)
        first.append(F.array(*map(F.lit, starts)))
    a = df.withColumn("__region", _lowest(regions, doc, "region"))
    a = a.withColumn("__rack", _lowest(F.get(racks, F.col("__region")), doc, "rack", F.col("__region")))
    rack = F.get(F.get(leaves, F.col("__region")), F.col("__rack"))
    a = a.withColumn("__leaf", _lowest(rack, doc, "shard", F.col("__region"), F.col("__rack")))
    number = F.get(F.get(F.array(*first), F.col("__region")), F.col("__rack")) + F.col("__leaf")
    return a.withColumn(out, number.cast("int")).drop("__region", "__rack", "__leaf")


def assign(
    docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """The ``keep`` columns (default: all) of every row with ``size``, ``text_crc32``,
    ``law`` (``key``), ``shard``, ``slot`` and ``grown_shard`` (with one shard more)."""
    cols = docs.columns if keep is None else keep
    raw = F.coalesce(col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.struct(*[col(c) for c in cols]).alias("row"), col(doc_id).alias("__id"),
        (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
    )
    now = tree(shards)
    doc = F.coalesce(F.col("__id").cast("string"), F.lit("null"))
    rows = staged(shard(shard(rows, doc, now, "shard"), doc, grown(now), "grown_shard"), "shards")
    r = ranged(rows, ["shard", "__id", "size", "text_crc32"])
    # one row for each range and shard in it: at most ranges + shards rows
    parts = r.groupBy("_range", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("at"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_range", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("at")).alias("base"))
    numbered = join_small(r, staged(base, "shard-bases"), ["_range", "shard"])
    results = [
        ("size", F.col("size")), ("text_crc32", F.col("text_crc32")), ("law", F.lit("key")), ("shard", F.col("shard")),
        ("slot", (F.col("_pos") + F.col("base")).cast("bigint")), ("grown_shard", F.col("grown_shard")),
    ]
    names = {n for n, _ in results}
    return numbered.select(*[F.col("row")[c].alias(c) for c in cols if c.lower() not in names], *[c.alias(n) for n, c in results])
