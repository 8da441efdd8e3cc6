"""Hard negatives: for every positive of an anchor, the best-scored rows of other labels inside a window of its score.

Vectors become integers, anchors and candidates are packed into blocks, and a task
takes one block of anchors against a run of candidate blocks.  A tile of scores is
a product of two int64 matrices by Strassen's recursion (seven products of halves,
odd sides padded with a row or column of zeros, sums and differences exact), down to halves of
``LEAF``.  Two passes: the first keeps the best rows of the anchor's label in a
heap per anchor, the second, which knows the positives' scores, the best other rows in a heap
per positive's window.  Heaps of several tasks merge by keeping the best of their union, so a task
sends at most a heap per anchor, whatever the number of its candidates.

Scores order rows from the highest, ties by smaller id (null ids last), then by the row's place.

Defined results: rows with a null label, a null vector, or a null, NaN or infinite component
take no part; a missing component of a shorter vector counts as zero (an empty vector scores
0 against all); a row with a null id is never an anchor, but may be a positive or a negative;
repeated rows count one by one, and only the row itself is left out of its positives; an empty
table, and a table without anchors, give no row; other columns are not read.  Scores stay in 64
bits: a table whose largest component or dimension could lead past that raises an error that names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, staged

# Rows of a block of candidates and of anchors, and candidate blocks that one task takes against a block of anchors.
BLOCK = 2048
ANCHORS = 512
RUN = 256
# A side of a matrix from which Strassen's recursion multiplies directly.
LEAF = 8
SCALE = 256
# 100 times a score has to fit 64 bits.
_MOST = (1 << 63) // 100 - 1
_NO_ID = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of integer matrices of any shape."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if (m | k | n) & 1:
        a = np.pad(a, ((0, m & 1), (0, k & 1)))
        b = np.pad(b, ((0, k & 1), (0, n & 1)))
        return strassen(a, b, leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), p1.dtype)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The ``k`` best (score, id, place) of every row, kept over many tiles."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.row = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        # the least score that can still enter
        self.least = np.full(rows, np.iinfo(np.int64).min, np.int64)

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """Offers the columns of ``scores`` where ``allowed``."""
        allowed = allowed & (scores >= self.least[:, None])
        if scores.shape[1] > self.k and allowed.any():
            # only what reaches the k-th score of the row in this tile; ties all stay
            least = np.partition(np.where(allowed, scores, np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
            allowed &= scores >= least[:, None]
        r, c = np.nonzero(allowed)
        if not len(r):
            return
        row = np.concatenate([self.row, r])
        score = np.concatenate([self.score, scores[r, c]])
        one = np.concatenate([self.id, ids[c]])
        place = np.concatenate([self.place, places[c]])
        order = np.lexsort((place, one, -score, row))
        row = row[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        order = order[keep]
        self.row, self.score, self.id, self.place = row[keep], score[order], one[order], place[order]
        full = np.flatnonzero(np.arange(len(self.row)) - np.searchsorted(self.row, self.row) == self.k - 1)
        self.least[self.row[full]] = self.score[full]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def integers(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: int | None = None, classes: int = 10
) -> DataFrame:
    """(place, id, label, v): the rows that take part, with components ``floor(256 * x)``.

    Where the id is divisible by ``relabel`` the label becomes ``(label + 1) % classes``."""
    i, y = col(vec_id).cast("bigint"), col(label).cast("bigint")
    if relabel:
        y = F.when(F.coalesce(i % relabel == 0, F.lit(False)), (y + 1) % classes).otherwise(y)
    kept = df.filter(col(label).isNotNull() & _usable(col(vector)))
    floored = F.transform(col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return kept.select(F.monotonically_increasing_id().alias("place"), i.alias("id"), y.alias("label"), floored.alias("v"))


def _blocks(rows: DataFrame, n: int, dim: int, dtype: str) -> DataFrame:
    """(block, matrix, ids, labels, places): rows dealt to ``n`` blocks by a hash of their place."""

    def pack(block, rows):
        rows = rows.sort_by("place")
        flat = rows["v"].combine_chunks()
        ends = np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False)) if len(rows) else np.zeros(0, np.int64)
        matrix = np.zeros((len(rows), dim), dtype)
        values, at = flat.flatten().to_numpy(zero_copy_only=False), 0
        for r, end in enumerate(ends):
            matrix[r, : end - at] = values[at:end]
            at = end
        ids = rows["id"].fill_null(_NO_ID).to_numpy()
        out = {"block": pa.array([block[0].as_py()], pa.int64()), "matrix": pa.array([matrix.tobytes()], pa.binary())}
        for name, values in (("ids", ids), ("labels", rows["label"].to_numpy()), ("places", rows["place"].to_numpy())):
            out[name] = pa.array([values.astype("<i8").tobytes()], pa.binary())
        return pa.table(out)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(n)))
    return dealt.groupBy("block").applyInArrow(pack, "block bigint, matrix binary, ids binary, labels binary, places binary")


_FOUND = "anchor bigint, slot int, id bigint, place bigint, score bigint"


def _tiles(grid: DataFrame, dim: int, dtype: str, k: int, windows: bool) -> DataFrame:
    """(anchor, slot, id, place, score): the heaps of every task.

    ``grid`` has per (i, g) one row of an anchor block (kind 0) and rows of candidate blocks (kind 1), which
    follow it.  Without windows the heaps hold rows of the anchor's label other than itself (slot 0),
    with windows rows of other labels whose score lies in the anchor's window of the slot."""

    def long(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<i8")

    def emit(places: np.ndarray, heaps: list[Heaps]) -> pa.RecordBatch:
        parts = [(places[h.row], np.full(len(h.row), s, np.int32), h.id, h.place, h.score) for s, h in enumerate(heaps)]
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        ids = pa.array(cols[2], mask=cols[2] == _NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), ids, pa.array(cols[3]), pa.array(cols[4])], names=["anchor", "slot", "id", "place", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[Heaps] = []
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in ("kind", "matrix", "ids", "labels", "places", "lows", "highs")}
                matrix = np.frombuffer(row["matrix"], dtype).reshape(-1, dim).astype(np.int64)
                if row["kind"] == 0:
                    if heaps:
                        yield emit(places, heaps)
                    places, labels, anchors = long(row["places"]), long(row["labels"]), matrix
                    if windows:
                        lows, highs = (long(row[x]).reshape(len(places), -1) for x in ("lows", "highs"))
                    heaps = [Heaps(len(places), k) for _ in range(lows.shape[1] if windows else 1)]
                    continue
                scores = strassen(anchors, np.ascontiguousarray(matrix.T))
                same = labels[:, None] == long(row["labels"])[None, :]
                ids, at = long(row["ids"]), long(row["places"])
                if not windows:
                    heaps[0].add(scores, same & (places[:, None] != at[None, :]), ids, at)
                    continue
                for slot, heap in enumerate(heaps):
                    heap.add(scores, ~same & (scores >= lows[:, slot, None]) & (scores <= highs[:, slot, None]), ids, at)
        if heaps:
            yield emit(places, heaps)

    return grid.mapInArrow(run, _FOUND)


def _grid(anchors: DataFrame, candidates: DataFrame, n_runs: int) -> DataFrame:
    """Every anchor block beside every run of candidate blocks, a run's blocks behind the anchor block."""
    names = ["matrix", "ids", "labels", "places", "lows", "highs"]
    runs = F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1)).cast("array<bigint>"))
    a = anchors.select(F.col("block").alias("i"), runs.alias("g"), F.lit(0).alias("kind"), *names)
    none = F.lit(None).cast("binary")
    tasks = anchors.select(F.col("block").alias("i"))
    c = candidates.select(F.pmod("block", F.lit(n_runs)).alias("g"), F.lit(1).alias("kind"), *names[:4], none.alias("lows"), none.alias("highs"))
    pairs = tasks.withColumn("g", runs)
    c = pairs.join(c, "g").select("i", "g", "kind", *names)
    return a.unionByName(c).repartition("i", "g").sortWithinPartitions("i", "g", "kind")


def _best(found: DataFrame, keys: list[str], k: int, out: str) -> DataFrame:
    """The ``k`` best of the merged heaps, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("place").asc())
    return found.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def hard_negatives(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    relabel: int | None = None,
    classes: int = 10,
    block: int = BLOCK,
    anchor_block: int = ANCHORS,
    run: int = RUN,
) -> DataFrame:
    """Hard negatives of the anchors (rows whose id is divisible by ``every``), one row per
    (anchor, positive, negative): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The positives are the anchor's first rows of its label, the negatives of each the first rows of another label whose
    score lies between ``low`` and ``high`` hundredths of the positive's."""
    rows = staged(integers(df, vec_id, vector, label, relabel, classes), "vectors")
    is_anchor = F.coalesce(F.col("id") % every == 0, F.lit(False))
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_anchor).alias("n_anchors"),
        F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"),
        F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, F.bitwise_not(x))))).alias("most"),
    ).first()
    dim, most = max(int(seen["dim"]), 1), int(seen["most"] or 0) + 1
    if dim * most * most > _MOST:
        raise ValueError(f"scores of {dim} components up to {most} (after scaling) do not fit 64 bits")
    dtype = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    n_blocks = max(1, -(-int(seen["n"]) // block))
    n_runs = max(1, -(-n_blocks // run))
    none = F.lit(None).cast("binary")
    candidates = staged(_blocks(rows, n_blocks, dim, dtype), "candidates")
    mine = rows.filter(is_anchor)
    n_own = max(1, -(-int(seen["n_anchors"]) // anchor_block))
    own = staged(_blocks(mine, n_own, dim, dtype).select("*", none.alias("lows"), none.alias("highs")), "anchors")

    found = _tiles(_grid(own, candidates, n_runs), dim, dtype, positives, windows=False)
    best = staged(_best(found, ["anchor"], positives, "slot"), "positives")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of a block's anchors, in the order of their places; a slot without a positive is an empty window."""
        for batch in batches:
            lows, highs = [], []
            for n in range(batch.num_rows):
                places = np.frombuffer(batch.column("places")[n].as_py(), "<i8")
                lo, hi = np.ones((len(places), positives), "<i8"), np.zeros((len(places), positives), "<i8")
                at = {p: r for r, p in enumerate(places.tolist())}
                for w in batch.column("w")[n].as_py() or ():
                    r, s = at[w["anchor"]], w["slot"] - 1
                    lo[r, s] = -(-low * w["score"] // 100)
                    hi[r, s] = high * w["score"] // 100
                lows.append(lo.tobytes())
                highs.append(hi.tobytes())
            names = ["block", "matrix", "ids", "labels", "places"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], names=[*names, "lows", "highs"])

    # at most ``positives`` windows for each of a block's anchors
    of_block = best.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_own))).groupBy("block").agg(F.collect_list(F.struct("anchor", "slot", "score")).alias("w"))
    schema = "block bigint, matrix binary, ids binary, labels binary, places binary, lows binary, highs binary"
    with_windows = staged(own.drop("lows", "highs").join(of_block, "block").mapInArrow(bounds, schema), "windows")
    hits = _tiles(_grid(with_windows, candidates, n_runs), dim, dtype, negatives, windows=True)
    hits = _best(hits, ["anchor", "slot"], negatives, "rank").withColumn("slot", F.col("slot") + 1)
    ids = mine.select(F.col("place").alias("anchor"), F.col("id").alias("anchor_id"))
    pos = best.select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        hits.join(pos, ["anchor", "slot"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
