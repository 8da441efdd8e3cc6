"""Near duplicates by consistent weighted sampling.

Texts are sets of five-word shingles with TF-IDF weights.  Document frequencies
are counted over all documents in a table of ``DF_BUCKETS`` hashed counters, whose
size does not depend on the corpus; the counters add up over tasks, and the inverse
frequency is damped (``IDF_POWER``) so that a large family of copies does not turn
its own common shingles weightless.  Improved consistent weighted sampling draws
``bands`` x ``rows`` samples of a text: two texts draw the same sample with the
probability of their weighted Jaccard similarity.  The rows of a band make one key.

Texts of equal word sequences are one node.  Nodes that share a band key form a
bucket, and every node of a bucket is compared with its hub, the least node.  Where
nodes are left outside their hub's class, all pairs of the bucket that lie in different
classes are settled, those in the hub's class included: in buckets of up to ``FEW``
nodes by comparing them, in larger ones in tasks of two blocks of nodes each.  A block
has some ``BLOCK`` nodes and ``BLOCK_CHARS`` characters, so a task does not grow with the bucket.
Inside a task a pair is passed over only if both are in one class by then, or if the
bits in which their shingles differ prove it unlike (no similar pair is lost); the
task returns the links that join classes, fewer than it has nodes.  Every link is verified
by the weighted Jaccard similarity of the whole texts; a pair whose plain
similarity is as high is linked as well, so that what a large family has in common,
and its low weights, cannot hide a copy.  Classes are the connected components of the
links, found by exchanging least labels.

Defined results: null and empty texts are one node without shingles, linked to no
other; a text of fewer than five words is one shingle; repeated rows are in one
class; ``class_id`` is the least id of the class, null where all its ids are; an
empty table gives an empty result; result columns replace input columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, fresh, staged
from .shingles import mix, shingles

SIMILARITY = 0.8
BANDS, ROWS = 15, 4
# Nodes of a bucket up to which its pairs are compared as rows.
FEW = 16
# Nodes and characters of the blocks a larger bucket is dealt into.
BLOCK = 512
BLOCK_CHARS = 1 << 24
_BITS = 1024
DF_BUCKETS = 1 << 18
IDF_POWER = 0.25
_SEED = 20240101
_POOL = 1 << 16
_CHUNK = 2048


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Hashed document frequencies (``DF_BUCKETS`` counters) and the number of rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DF_BUCKETS + 1, np.int64)
        for batch in batches:
            for s in shingles(batch["t"].tolist()):
                total[np.unique(s & np.uint64(DF_BUCKETS - 1)).astype(np.int64)] += 1
            total[DF_BUCKETS] += len(batch)
        at = np.flatnonzero(total)
        if len(at):
            yield pd.DataFrame({"b": at, "n": total[at]})

    partial = docs.select(col(text).alias("t")).mapInPandas(count, "b bigint, n bigint")
    counts = staged(partial.groupBy("b").agg(F.sum("n").alias("n")), "shingle-counts").toPandas()  # at most DF_BUCKETS + 1 rows
    out = np.zeros(DF_BUCKETS + 1, np.int64)
    out[counts["b"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out[:DF_BUCKETS], int(out[DF_BUCKETS])


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    """Damped smoothed inverse document frequency by bucket."""
    return ((np.log((1 + n) / (1 + np.minimum(df, n))) + 1) ** IDF_POWER).astype(np.float32)


def weighted(s: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their TF-IDF weights."""
    u, tf = np.unique(s, return_counts=True)
    return u, tf.astype(np.float32) * idf[(u & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    return low / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - low)


class Sampler:
    """Improved consistent weighted sampling.  The random numbers of a shingle and a
    sample come from pools of prepared draws at places its hash decides."""

    def __init__(self, bands: int, rows: int, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, _POOL).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _POOL)).astype(np.float32)
        self.beta = rng.random(_POOL).astype(np.float32)

    def samples(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        m = len(self.factors)
        best = np.full(m, np.inf, np.float32)
        code = np.zeros(m, np.uint64)
        low = np.uint64(_POOL - 1)
        every = np.arange(m)
        log_w = np.log(weights).astype(np.float32)
        for i in range(0, len(keys), _CHUNK):
            k = keys[i : i + _CHUNK]
            x = self.factors[:, None] * k[None, :]
            r = self.r[x >> np.uint64(48)]
            beta = self.beta[(x >> np.uint64(32)) & low]
            t = np.floor(log_w[i : i + _CHUNK] / r + beta)
            a = self.log_c[(x >> np.uint64(16)) & low] - r * (t - beta + 1)
            at = a.argmin(axis=1)
            least = a[every, at]
            better = least < best
            best = np.where(better, least, best)
            new = mix(k[at] ^ mix(t[every, at].astype(np.int64).astype(np.uint64)))
            code = np.where(better, new, code)
        return code

    def keys(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        c = self.samples(keys, weights).reshape(self.bands, self.rows)
        x = np.arange(self.bands, dtype=np.uint64)
        for row in range(self.rows):
            x = mix(x ^ c[:, row])
        return x.view(np.int64)


def _nodes(docs: DataFrame, text: str, doc_id: str, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """(d, x, node, keys): id, hash of the text, 16 bytes of its word sequence, band keys."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((idf, Sampler(bands, rows)))  # a few MB whatever the corpus

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, sampler = shared.value
        for batch in batches:
            keys = []
            for s in shingles(batch["t"].tolist()):
                keys.append(sampler.keys(*weighted(s, idf)) if len(s) else np.zeros(0, np.int64))
            node = [hashlib.md5(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).digest() for t in batch["t"]]
            yield pd.DataFrame({"d": batch["d"], "x": batch["x"], "node": node, "keys": keys})

    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(col(doc_id).alias("d"), text_key(col(text)).alias("x"), col(text).alias("t"))
    return source.mapInPandas(sign, f"d {kind}, x bigint, node binary, keys array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar, with their ``similarity``."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = shared.value
        for batch in batches:
            left = [weighted(s, idf) for s in shingles(batch["ta"].tolist())]
            right = [weighted(s, idf) for s in shingles(batch["tb"].tolist())]
            value = np.array([similarity(a, b) for a, b in zip(left, right, strict=True)])
            plain = np.array([similarity((a[0], np.ones(len(a[0]))), (b[0], np.ones(len(b[0])))) for a, b in zip(left, right, strict=True)])
            ok = np.maximum(value, plain) >= threshold
            yield pd.DataFrame({"a": batch["a"][ok], "b": batch["b"][ok], "similarity": value[ok]})

    one = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "ta", "b", "tb").mapInPandas(check, "a binary, b binary, similarity double")


def _parities(s: np.ndarray) -> np.ndarray:
    """``_BITS`` bits of a set, each the parity of its elements there: two sets differ in
    as many elements at least as in bits."""
    at = np.bincount((mix(s) & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS)
    return np.packbits((at & 1).astype(np.uint8)).view(np.uint64)


def settle(sets: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, side: np.ndarray | None, threshold: float) -> list[tuple[int, int, float]]:
    """Links (i, j, weighted similarity) that join the classes ``label`` of weighted sets as all
    pairs of ``threshold`` or more would; with ``side`` only pairs of different sides count."""
    m = len(sets)
    size = np.array([len(k) for k, _ in sets], np.float64)
    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    least = np.array([w.min() if len(w) else 1.0 for _, w in sets], np.float64)
    bits = np.stack([_parities(k) for k, _ in sets])
    _, flat = np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets])
    ends = np.cumsum(size).astype(np.int64)
    starts = ends - size.astype(np.int64)
    mine = np.zeros(int(flat.max()) + 1 if len(flat) else 1, np.float32)
    group = np.unique(label, return_inverse=True)[1]
    # what two similar sets may differ in, of the sum of both
    may = (1 - threshold) / (1 + threshold) * (1 + 1e-6)
    out = []
    # the largest class comes last: its own pairs need no look
    for i in np.argsort(np.bincount(group)[group], kind="stable").tolist():
        left = group != group[i]
        if side is not None:
            left &= side != side[i]
        other = np.flatnonzero(left & (size > 0))
        if not len(other) or not size[i]:
            continue
        differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
        plain = differ <= may * (size[other] + size[i])
        heavy = differ * np.minimum(least[other], least[i]) <= may * (total[other] + total[i])
        near = plain | heavy
        other = other[near][np.argsort(differ[near], kind="stable")]
        own = flat[starts[i] : ends[i]]
        mine[own] = weight[starts[i] : ends[i]]
        for first in range(0, len(other), 64):
            some = other[first : first + 64]
            some = some[group[some] != group[i]]
            if not len(some):
                continue
            n = size[some].astype(np.int64)
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(starts[some] - begin, n)
            there = mine[flat[at]]
            low = np.add.reduceat(np.minimum(there, weight[at]), begin, dtype=np.float64)
            both = np.add.reduceat((there > 0).astype(np.float64), begin)
            value = low / (total[some] + total[i] - low)
            alike = np.maximum(value, both / (size[some] + size[i] - both)) >= threshold
            for j, v in zip(some[alike].tolist(), value[alike].tolist(), strict=True):
                if group[j] != group[i]:
                    out.append((i, j, v))
                    group[group == group[j]] = group[i]
        mine[own] = 0
    return out


def _settled(rows: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b, similarity) that join the classes of large buckets (bucket, n, node, label)."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    sized = texts.select("node", F.length("t").alias("chars"))
    rows = staged(rows.join(_small(sized), "node"), "large")
    of = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.first("n") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks"))
    dealt = rows.join(_small(staged(of, "blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    # a block meets every block, itself included
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "label")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(pdf["label"])[0]
        found: list[tuple[int, int, float]] = []
        if label.any():
            idf = shared.value
            sets = [weighted(s, idf) for s in shingles(pdf["t"].tolist())]
            side = pdf["block"].to_numpy() if pdf["i"].iloc[0] != pdf["j"].iloc[0] else None
            found = settle(sets, label, side, threshold)
        node = pdf["node"].tolist()
        ends = [(*sorted((bytes(node[i]), bytes(node[j]))), v) for i, j, v in found]
        return pd.DataFrame(ends, columns=["a", "b", "similarity"])

    return met.join(texts, "node").groupBy("bucket", "i", "j").applyInPandas(join, "a binary, b binary, similarity double").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in a link (a, b); the label is the least node it is connected to."""
    edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        # a label is itself a node: take its label too, so that paths halve
        of = labels.select(F.col("node").alias("new"), F.col("label").alias("next"))
        step = staged(new.join(of, "new", "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")), "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.filter(F.col("new") != F.col("label")).limit(1).count() == 0:
            return labels


def _candidates(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, t): one text of every wanted node (node, d, x)."""
    source = docs.select(col(doc_id).alias("d_"), text_key(col(text)).alias("x_"), col(text).alias("t"))
    found = source.join(_small(wanted), F.col("d_").eqNullSafe(F.col("d")) & (F.col("x_") == F.col("x"))).select("node", "t")
    found = staged(found, "candidates")
    # rows that repeat another in id and text are found several times
    again = found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.limit(1).count():
        found = staged(found.dropDuplicates(["node"]), "candidates")
    return found


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of short rows, to be broadcast if it has few of them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def link(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (d, x, node) of all rows, verified links (a, b, similarity) between nodes."""
    idf = inverse(*frequencies(docs, text))
    signed = staged(_nodes(docs, text, doc_id, idf, bands, rows), "signatures")
    # any row of a node can stand for it, as its word sequence is the node
    nodes = signed.groupBy("node").agg(F.min(F.struct("d", "x")).alias("r"), F.first("keys").alias("keys"))
    left = nodes.select("node", "r", F.posexplode("keys").alias("band", "bucket")).drop("band")
    shared = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1")
    buckets = staged(left.join(shared, "bucket"), "buckets")
    wanted = buckets.groupBy("node").agg(F.min("r").alias("r")).select("node", F.col("r.d").alias("d"), F.col("r.x").alias("x"))
    texts = _candidates(docs, staged(wanted, "wanted"), text, doc_id)
    buckets = buckets.drop("r")

    def verify(pairs: DataFrame) -> DataFrame:
        new = staged(pairs, "pairs")
        some = staged(new.select("a").union(new.select("b")).distinct().withColumnRenamed("a", "node"), "nodes")
        return staged(_verified(new, texts.join(_small(some), "node", "left_semi"), idf, threshold), "links")

    hubs = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = verify(hubs)
    labelled = staged(_labelled(buckets, components(links)), "labelled")
    # where a node is outside its hub's class, all pairs of different classes
    apart = staged(labelled.filter("label <> hub_label"), "apart")
    others = labelled.filter(F.col("n") <= FEW).select("bucket", F.col("node").alias("other"), F.col("label").alias("of"))
    both = apart.filter(F.col("n") <= FEW).join(others, "bucket").filter((F.col("label") != F.col("of")) & (F.col("other") != F.col("hub")))
    few = verify(both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct().join(hubs, ["a", "b"], "left_anti"))
    links = links.union(few)
    large = apart.filter(F.col("n") > FEW).select("bucket").distinct()
    if large.limit(1).count():
        rows_ = labelled.join(_small(staged(large, "large-buckets")), "bucket", "left_semi").select("bucket", "n", "node")
        rows_ = rows_.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
        links = links.union(staged(_settled(rows_, texts, idf, threshold), "links"))
    return signed.select("d", "x", "node"), links


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets with the ``label`` of their node and that of their hub."""
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    out = buckets.join(labels, "node", "left").join(of_hub, "hub", "left")
    return out.withColumns({"label": F.coalesce("label", "node"), "hub_label": F.coalesce("hub_label", "hub")})


def classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(d, x, node, label, class_id, class_size) of every row of ``docs``."""
    members, links = link(docs, text, doc_id, threshold, bands, rows)
    labels = components(links)
    counted = members.groupBy("node").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n"))
    named = counted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_class = named.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = staged(named.select("node", "label").join(of_class, "label"), "classes")
    return members.join(by_node, "node")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``class_id`` and ``class_size`` (rows)."""
    return classes(docs, text, doc_id, threshold).select(F.col("d").alias(doc_id), "class_id", "class_size")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row of every class, as it is: the one with the least id (nulls last), of
    equal ids the one with the least hash of its text, of equal rows any one."""
    every = classes(docs, text, doc_id, threshold)
    order = F.struct(F.col("d").isNull().alias("none"), F.col("d").alias("d"), F.col("x").alias("x"))
    counted = every.groupBy("label", "d", "x").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.groupBy("label").agg(F.min_by(F.struct("d", "x", "n"), order).alias("s")).select(F.col("s.d").alias("__d"), F.col("s.x").alias("__x"), F.col("s.n").alias("__n"))
    kept = staged(kept, "kept")
    (x_,) = fresh(docs, "__text")
    rows = docs.withColumn(x_, text_key(col(text)))
    on = col(doc_id).eqNullSafe(F.col("__d")) & (col(x_) == F.col("__x"))
    once = rows.join(kept.filter("__n = 1"), on, "left_semi")
    again = rows.join(kept.filter("__n > 1"), on, "left_semi").dropDuplicates([doc_id, x_])
    return once.union(again).drop(x_)
