"""Training of Spark ML's tree ensembles on large tables (M2-M5).

Spark ML walks all rows once for every level of every group of trees: a boosted model of 400 rounds runs some 2,400
jobs over the rows, a forest of 500 trees holds 500 node numbers a row.  But a tree sees a row only as its bins (at most
``maxBins`` a feature) and its label.  So rows of equal bins form a cell, and what a tree needs is, for each cell, the
sums over its drawn rows (weights, labels, squares).  Every row is drawn anew for every tree:

* rows are binned, range partitioned by (cell, label), sorted and written once, in chunks of ``CHUNK_ROWS``; a large cell
  spans many chunks, and each chunk's part of it counts as a cell of its own;
* a pass over the chunks draws the rows of many trees (Poisson weights with replacement, else zero or one, from a
  generator per chunk and tree) and adds them up per cell;
* the sums of a forest's tree go to one task, which grows it; boosting needs the trees one after another, and grows them
  on the driver, which holds the sums of ``BLOCK_SUMS`` cells and rounds at a time;
* a classifier needs only counts: the weights of a cell's n rows of a class add up to a Poisson weight of mean rate * n.

Split candidates, impurity, the random features of a node, least rows, the merging of equal leaves and the boosting step
are Spark ML's, so without random draws the trees are the same.  The model is written in Spark ML's format and loaded as
its model.  Memory is bounded by ``MAX_CELLS`` (32 bins of three features times 64 of the others); ``train`` gives None for
a table with more, which then goes to Spark ML.  Fewer than ``LARGE_ROWS`` rows go there as well (``models``).
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

LARGE_ROWS = 100_000
CHUNK_ROWS = 1 << 17
MAX_CELLS = 1 << 21
# Sums (cells times trees) on the driver at a time, and in one shuffle of a forest; each is 20 bytes.
BLOCK_SUMS = 1 << 21
FOREST_SUMS = 1 << 25
_MODELS = {
    "GBTRegressor": (GBTRegressionModel, "org.apache.spark.ml.regression.GBTRegressionModel", "dtr"),
    "RandomForestRegressor": (RandomForestRegressionModel, "org.apache.spark.ml.regression.RandomForestRegressionModel", "dtr"),
    "RandomForestClassifier": (RandomForestClassificationModel, "org.apache.spark.ml.classification.RandomForestClassificationModel", "dtc"),
}
_TREES = {"dtr": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "dtc": "org.apache.spark.ml.classification.DecisionTreeClassificationModel"}
_OF_ENSEMBLE = {"bootstrap", "featureSubsetStrategy", "lossType", "maxIter", "numTrees", "stepSize", "subsamplingRate", "validationTol"}
_GROWN = 0xFFFFFFFF  # in the place of a chunk's upper bits, for the features of nodes
_NODE = "tree int, id int, prediction double, impurity double, stats array<double>, raw long, gain double, left int, right int, feature int, threshold double"


# ------------------------------------------------------------------- bins


def split_points(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Spark ML's candidates of a continuous feature: all middles of neighbours if they are few, else about equal counts."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) <= max_bins:
        return (found[:-1] + found[1:]) / 2
    stride = counts.sum() / max_bins
    out, seen, target = [], float(counts[0]), stride
    for i in range(1, len(found)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append((found[i - 1] + found[i]) / 2)
            target += stride
    return np.array(out)


def cell_numbers(columns: Sequence[np.ndarray], points: Sequence[np.ndarray]) -> np.ndarray:
    """One number per row for its bins; a value equal to a point lies below it, NaN above all."""
    out = np.zeros(len(columns[0]), np.int64)
    for x, p in zip(columns, points, strict=True):
        out = out * (len(p) + 1) + np.searchsorted(p, x, side="left")
    return out


def _finite(pdf: pd.DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    columns = [pdf[c].to_numpy(float) for c in names]
    if not all(np.isfinite(x).all() for x in columns):
        raise ValueError("labels and features must not be NaN or infinite")  # as Spark ML has it
    return columns


def bins_of(cells: np.ndarray, points: Sequence[np.ndarray]) -> np.ndarray:
    """Features x cells: the bins that ``cell_numbers`` numbered."""
    out, rest = [], cells
    for p in reversed(points):
        out.append(rest % (len(p) + 1))
        rest = rest // (len(p) + 1)
    return np.array(out[::-1], np.int32)


def with_cell(df: DataFrame, features: Sequence[str], points: Sequence[np.ndarray], out: str = "_cell") -> DataFrame:
    """Adds the number of the row's cell (nulls count as NaN)."""
    points = list(points)

    @F.pandas_udf("long")
    def number(*columns: pd.Series) -> pd.Series:
        return pd.Series(cell_numbers([c.to_numpy(float) for c in columns], points))

    return df.withColumn(out, number(*[F.col(c).cast("double") for c in features]))


def model_points(spark: SparkSession, stage_dir: str, features: int) -> list[np.ndarray]:
    """Per feature the thresholds of a saved ensemble, sorted (at most ``maxBins`` - 1 each)."""
    split = spark.read.parquet(f"{stage_dir}/data").select("nodeData.split.*").filter("featureIndex >= 0")
    found = split.select("featureIndex", F.explode("leftCategoriesOrThreshold").alias("at")).distinct().collect()
    return [np.array(sorted(r["at"] for r in found if r["featureIndex"] == i)) for i in range(features)]


def countable(points: Sequence[np.ndarray]) -> bool:
    return math.prod(len(p) + 1 for p in points) < 1 << 62


# ------------------------------------------------------------------- one tree


@dataclass
class Cells:
    """Cells of one tree: bins (features x cells), drawn rows, and sums of labels and squares or the cells' classes."""

    bins: np.ndarray
    weight: np.ndarray
    total: np.ndarray | None = None
    square: np.ndarray | None = None
    label: np.ndarray | None = None
    classes: int = 0

    def sums(self, at: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """n x stats over the cells ``at``, by their place: weight and total, or the weights of the classes."""
        if self.classes:
            return np.bincount(place * self.classes + self.label[at], self.weight[at], n * self.classes).reshape(n, -1)
        return np.stack([np.bincount(place, v[at], n) for v in (self.weight, self.total)], axis=-1)

    def count(self, sums: np.ndarray) -> np.ndarray:
        return sums.sum(-1) if self.classes else sums[..., 0]

    def gain(self, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Weighted decrease of the variance or of Gini's impurity."""
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            n, a, b = self.count(whole), self.count(left), self.count(right)
            if not self.classes:
                return a * b / (n * n) * (left[..., 1] / a - right[..., 1] / b) ** 2
            pure = lambda s, m: (s * s).sum(-1) / (m * m)
            return a / n * pure(left, a) + b / n * pure(right, b) - pure(whole, n)


def grow(cells: Cells, n_bins: Sequence[int], depth: int, least: int, subset: int, rng) -> tuple[list[list], np.ndarray]:
    """Nodes [stats, raw count, impurity, prediction, gain, left, right, feature, bin] from the root on, and the leaf of every cell."""
    nodes: list[list] = []
    leaf = np.zeros(cells.bins.shape[1], np.int64)

    def add(at: np.ndarray, place: np.ndarray, n: int) -> list[int]:
        sums = cells.sums(at, place, n)
        squares = None if cells.classes else np.bincount(place, cells.square[at], n)
        for k in range(n):
            w = cells.count(sums[k])
            if cells.classes:
                stats, impurity, prediction = sums[k], 1 - float((sums[k] ** 2).sum()) / (w * w) if w else 0.0, float(np.argmax(sums[k]))
            else:
                prediction = float(sums[k][1] / w) if w else 0.0
                stats, impurity = np.array([*sums[k], squares[k]]), max(0.0, float(squares[k] / w - prediction**2)) if w else 0.0
            nodes.append([stats, round(float(w)), impurity, prediction, -1.0, -1, -1, -1, -1])
        return [*range(len(nodes) - n, len(nodes))]

    at = np.arange(cells.bins.shape[1])
    place = np.zeros(len(at), np.int64)
    open_ = add(at, place, 1)
    for _ in range(depth):
        n = len(open_)
        used = np.argsort(rng.random((n, len(n_bins))), axis=1) < subset
        best = np.full(n, 0.0)
        chosen = np.full((n, 2), -1)
        for f, b in enumerate(n_bins):
            if b < 2 or not used[:, f].any():
                continue
            part = slice(None) if used[:, f].all() else np.flatnonzero(used[:, f][place])
            some, where = at[part], place[part]
            below = cells.sums(some, where * b + cells.bins[f, some], n * b).reshape(n, b, -1).cumsum(axis=1)
            whole, left = below[:, -1:], below[:, :-1]
            few = (cells.count(left) < least) | (cells.count(whole - left) < least)
            gains = np.where(few | ~used[:, f, None], -1.0, np.nan_to_num(cells.gain(left, whole), nan=-1.0))
            k = gains.argmax(axis=1)
            top = gains[np.arange(n), k]
            better = top > best
            best[better], chosen[better] = top[better], np.stack([np.full(n, f), k], axis=1)[better]
        # a gain as small as rounding errors of the sums is none
        scale = np.array([1.0 if cells.classes else nodes[i][0][2] / max(nodes[i][0][0], 1) for i in open_])
        split = best > 1e-15 * scale
        if not split.any():
            break
        first = 2 * (np.cumsum(split) - 1)
        going = split[place]
        at, place = at[going], place[going]
        up = cells.bins[chosen[place, 0], at] > chosen[place, 1]
        place = first[place] + up
        made = add(at, place, 2 * int(split.sum()))
        for k in np.flatnonzero(split):
            nodes[open_[k]][4:] = [float(best[k]), made[first[k]], made[first[k] + 1], int(chosen[k, 0]), int(chosen[k, 1])]
        open_ = made
        leaf[at] = np.array(made)[place]
    return nodes, leaf


def node_rows(tree: int, nodes: list[list], points: Sequence[np.ndarray]) -> list[tuple]:
    """The tree's rows of ``_NODE`` in pre-order; two leaves of equal prediction are merged, as Spark ML does."""
    whole = [True] * len(nodes)  # ends here
    for i in range(len(nodes) - 1, -1, -1):
        left, right = nodes[i][5:7]
        whole[i] = left < 0 or (whole[left] and whole[right] and nodes[left][3] == nodes[right][3])
    out: list[tuple] = []

    def walk(i: int) -> int:
        stats, raw, impurity, prediction, gain, left, right, f, b = nodes[i]
        k = len(out)
        out.append(())
        if whole[i]:
            out[k] = (tree, k, prediction, impurity, stats.tolist(), raw, -1.0, -1, -1, -1, None)
        else:
            a, z = walk(left), walk(right)
            out[k] = (tree, k, prediction, impurity, stats.tolist(), raw, gain, a, z, f, float(points[f][b]))
        return k

    walk(0)
    return out


# ------------------------------------------------------------------- draws


def weights_of(rate: float, replaced: bool) -> Callable[[np.random.Generator, int], np.ndarray]:
    """Draws the weights of n rows: Poisson with replacement, else one with probability ``rate``; 32 bits each."""
    p, total, below = math.exp(-rate), 0.0, []
    k = 0
    while replaced and total < 1 - 2.0**-33 and k < 200:
        total += p
        below.append(total)
        k += 1
        p *= rate / k
    limits = np.array([min(round(x * 2**32), 2**32 - 1) for x in (below[:-1] if replaced else [1 - rate])], np.uint64)
    lead = np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)
    low, high = np.searchsorted(limits, lead, "right"), np.searchsorted(limits, lead | np.uint64(0xFFFF), "right")
    table = np.where(low == high, low, 255).astype(np.uint8)

    def draw(rng, n):
        bits = rng.integers(0, 1 << 32, n, np.uint32)
        out = table[bits >> 16]
        unsure = np.flatnonzero(out == 255)
        out[unsure] = np.searchsorted(limits, bits[unsure].astype(np.uint64), "right")
        return out

    return draw


def _rng(*seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64([s & 0xFFFFFFFF for s in seed]))


def chunks(rows: DataFrame, features: Sequence[str], label: str, points: Sequence[np.ndarray], n: int) -> DataFrame:
    """(chunk, cells, starts, labels), written once: the chunk's distinct cells, their first rows, and the labels of the rows."""
    spark, names, points, size = rows.sparkSession, [f"_x{i}" for i in range(len(features))], list(points), CHUNK_ROWS

    def binned(batches):
        for pdf in batches:
            yield pd.DataFrame({"cell": cell_numbers(_finite(pdf, names), points), "y": _finite(pdf, ["_y"])[0]})

    def packed(batches):
        part, k, cells, ys = TaskContext.get().partitionId(), 0, [], []

        def full():
            c, y = np.concatenate(cells), np.concatenate(ys)
            found, starts = np.unique(c, return_index=True)
            return pd.DataFrame({"chunk": [(part << 20) + k], "cells": [found.tobytes()], "starts": [starts.astype(np.int32).tobytes()], "labels": [y.tobytes()]})

        for pdf in batches:
            for i in range(0, len(pdf), size):
                cells.append(pdf["cell"].to_numpy(np.int64)[i : i + size])
                ys.append(pdf["y"].to_numpy(float)[i : i + size])
                if sum(map(len, cells)) >= size:
                    yield full()
                    k, cells, ys = k + 1, [], []
        if cells:
            yield full()

    doubles = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    cells = rows.select(*doubles, F.col(label).cast("double").alias("_y")).mapInPandas(binned, "cell long, y double")
    path = scratch_path(spark, "chunks")
    parts = max(spark.sparkContext.defaultParallelism, -(-n // size))
    ordered = cells.repartitionByRange(parts, "cell", "y").sortWithinPartitions("cell", "y")
    ordered.mapInPandas(packed, "chunk long, cells binary, starts binary, labels binary").write.parquet(path)
    return spark.read.parquet(path)


def drawn(rows: DataFrame, first: int, last: int, draw, seed: int) -> DataFrame:
    """(tree, chunk, sums): for the trees first..last-1, per cell of the chunk, weights, sums of labels and of squares."""

    def run(batches):
        for pdf in batches:
            for chunk, starts, labels in pdf.itertuples(index=False):
                starts, y = np.frombuffer(starts, np.int32), np.frombuffer(labels)
                out, size = [], 0
                for t in range(first, last):
                    w = draw(_rng(seed, t, chunk, chunk >> 32), len(y))
                    wy = w * y
                    sums = [np.add.reduceat(w, starts, dtype=np.int32), np.add.reduceat(wy, starts), np.add.reduceat(wy * y, starts)]
                    out.append((t, chunk, b"".join(x.tobytes() for x in sums)))
                    size += len(out[-1][2])
                    if size > 1 << 22 or t + 1 == last:
                        yield pd.DataFrame(out, columns=["tree", "chunk", "sums"])
                        out, size = [], 0

    return rows.select("chunk", "starts", "labels").mapInPandas(run, "tree int, chunk long, sums binary")


def _joined(parts: Sequence[tuple[int, bytes]]) -> list[np.ndarray]:
    """Weights, sums and sums of squares of one tree over all cells, chunk by chunk."""
    out = []
    for _, raw in sorted(parts):
        n = len(raw) // 20
        out.append((np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.float64, n, 4 * n), np.frombuffer(raw, np.float64, n, 12 * n)))
    return [np.concatenate(x).astype(float) for x in zip(*out, strict=True)]


# ------------------------------------------------------------------- ensembles


def _subset(strategy: str, features: int, trees: int, classes: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    named = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3)}
    if strategy in named:
        return named[strategy]
    return min(features, int(strategy)) if re.fullmatch(r"\d+", strategy) else math.ceil(float(strategy) * features)


def _boosted(rows: DataFrame, bins: np.ndarray, points, est, subset: int):
    """Rows of the nodes of all rounds: each round's tree is fitted to the gradient of the squared loss, 2 (y - margin)."""
    n_bins, rounds, seed = [len(p) + 1 for p in points], est.getMaxIter(), est.getSeed()
    draw = weights_of(est.getSubsamplingRate(), False)
    margin = np.zeros(bins.shape[1])
    step = max(1, BLOCK_SUMS // len(margin))
    for first in range(0, rounds, step):
        last = min(rounds, first + step)
        parts: dict[int, list] = {t: [] for t in range(first, last)}
        for r in drawn(rows, first, last, draw, seed).collect():  # at most BLOCK_SUMS sums, or those of one round
            parts[r["tree"]].append((r["chunk"], bytes(r["sums"])))
        for t in range(first, last):
            w, s, q = _joined(parts.pop(t))
            if t:
                s, q = 2 * (s - w * margin), 4 * (q - 2 * margin * s + margin * margin * w)
            nodes, leaf = grow(Cells(bins, w, s, q), n_bins, est.getMaxDepth(), est.getMinInstancesPerNode(), subset, _rng(seed, t, 0, _GROWN))
            margin += np.array([x[3] for x in nodes])[leaf] * (est.getStepSize() if t else 1.0)
            yield from node_rows(t, nodes, points)


def _forest(rows: DataFrame, bins: np.ndarray, points, est, subset: int, classes: int, counts: tuple | None):
    """Frames of the nodes of some trees each; a tree is grown in one task."""
    spark, trees, seed = rows.sparkSession, est.getNumTrees(), est.getSeed()
    rate, replaced = est.getSubsamplingRate(), est.getBootstrap()
    n_bins, points, depth, least = [len(p) + 1 for p in points], list(points), est.getMaxDepth(), est.getMinInstancesPerNode()
    shared = spark.sparkContext.broadcast((bins, counts))
    names = [x.split()[0] for x in _NODE.split(", ")]

    def frame(tree: int, cells: Cells) -> pd.DataFrame:
        nodes, _ = grow(cells, n_bins, depth, least, subset, _rng(seed, tree, 0, _GROWN))
        return pd.DataFrame(node_rows(tree, nodes, points), columns=names).astype({"threshold": float})

    if classes:

        def counted(batches):
            bins, (label, n) = shared.value
            for pdf in batches:
                for t in pdf["id"]:
                    rng = _rng(seed, int(t))
                    w = rng.poisson(rate * n) if replaced else rng.binomial(n, rate)
                    yield frame(int(t), Cells(bins, w.astype(float), label=label, classes=classes))

        yield spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(counted, _NODE)
        return
    draw = weights_of(rate, replaced)

    def one(key, pdf):
        bins, _ = shared.value
        return frame(int(key[0]), Cells(bins, *_joined([*zip(pdf["chunk"], pdf["sums"], strict=True)])))

    step = max(spark.sparkContext.defaultParallelism, FOREST_SUMS // bins.shape[1])
    for a in range(0, trees, step):
        z = min(trees, a + step)
        yield drawn(rows, a, z, draw, seed).repartition(z - a, "tree").groupBy("tree").applyInPandas(one, _NODE)


def _save(spark: SparkSession, est, frames, trees: int, weights: Sequence[float], features: int, classes: int) -> str:
    """Spark ML's folder of the fitted model."""
    path = scratch_path(spark, "ensemble")
    est.save(f"{path}-params")
    said = json.loads(spark.read.text(f"{path}-params/metadata").first()[0])
    _, name, kind = _MODELS[type(est).__name__]
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": said["sparkVersion"]}
    of_tree = {k: {p: v for p, v in said[k].items() if p not in _OF_ENSEMBLE} for k in ("paramMap", "defaultParamMap")}
    more = {"numFeatures": features, **({"numClasses": classes} if classes else {})}
    own = {"class": name, **head, "uid": est.uid, "paramMap": said["paramMap"], "defaultParamMap": said["defaultParamMap"], **more, "numTrees": trees}
    spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, json.dumps({"class": _TREES[kind], **head, "uid": f"{kind}_{uuid.uuid4().hex[:12]}", **of_tree, **more}), float(w)) for i, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    threshold = F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>"))
    split = F.struct(F.col("feature").alias("featureIndex"), threshold.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    for f in frames:
        f.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.mode("append").parquet(f"{path}/data")
    return path


def train(est, rows: DataFrame, features: Sequence[str], classes: int = 0, n: int | None = None):
    """The fitted Spark ML model of a GBTRegressor, RandomForestRegressor or RandomForestClassifier whose vector has the
    given double columns; ``rows`` have the label, none of them null.  None if the rows have too many cells."""
    spark, features, label = rows.sparkSession, list(features), est.getLabelCol()
    n = rows.count() if n is None else n
    doubles = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    # as many rows as Spark ML takes to place its split candidates; the trees themselves see all rows
    wanted = max(est.getMaxBins() ** 2, 10_000)
    some = rows.select(*doubles)
    some = (some if n <= wanted else some.sample(False, wanted / n, est.getSeed())).toPandas()
    names = list(some.columns)
    points = [split_points(x, min(est.getMaxBins(), n)) for x in _finite(some, names)]
    if not countable(points):
        return None
    counts = None
    if classes:

        def binned(batches):
            for pdf in batches:
                yield pd.DataFrame({"cell": cell_numbers(_finite(pdf, names), points), "label": pdf["_y"]})

        cells = rows.select(*doubles, F.col(label).cast("int").alias("_y")).mapInPandas(binned, "cell long, label int")
        path = scratch_path(spark, "cells")
        cells.groupBy("cell", "label").count().write.parquet(path)
        table = spark.read.parquet(path)
        if table.count() > MAX_CELLS:
            return None
        found = table.orderBy("cell", "label").toPandas()
        bins, counts = bins_of(found["cell"].to_numpy(np.int64), points), (found["label"].to_numpy(np.int64), found["count"].to_numpy(np.int64))
        chunked = rows
    else:
        chunked = chunks(rows, features, label, points, n)
        if (chunked.agg(F.sum(F.length("cells") / 8)).first()[0] or 0) > MAX_CELLS:
            return None
        found = sorted((r["chunk"], bytes(r["cells"])) for r in chunked.select("chunk", "cells").collect())
        bins = bins_of(np.frombuffer(b"".join(c for _, c in found), np.int64), points)
    kind = type(est).__name__
    trees = est.getMaxIter() if kind == "GBTRegressor" else est.getNumTrees()
    subset = _subset(est.getFeatureSubsetStrategy(), len(features), trees, classes)
    weights = [1.0] * trees
    if kind == "GBTRegressor":
        subset = len(features) if est.getFeatureSubsetStrategy() == "auto" else subset
        weights[1:] = [est.getStepSize()] * (trees - 1)
        frames = [spark.createDataFrame([*_boosted(chunked, bins, points, est, subset)], _NODE, verifySchema=False)]
    else:
        frames = _forest(chunked, bins, points, est, subset, classes, counts)
    return _MODELS[kind][0].load(_save(spark, est, frames, trees, weights, len(features), classes))
