"""M2 / M5: boosted trees with an L2 penalty on leaf weights, one or many classes.

Features are cut into bins by fixed edges.  A round grows one tree per class (one tree for a regression) level by
level: one distributed aggregate a level sums gradients and hessians by (class, node, feature,
bin), combined map-side, so what reaches the driver has at most classes x nodes x features x bins rows whatever
the number of training rows.  Splits maximise ``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)``, leaves weigh
``-G/(H+l)``.  Squared loss has gradient ``margin - y`` and hessian 1; classes go through a softmax with gradient
``p - [y = k]`` and hessian ``2 p (1 - p)``.

A margin depends on a row's bins alone, so without row sampling the rows of equal bins (and class) are read once and
become one row with their number and the sum of their labels: their gradients and hessians are those sums' own.  With
sampling every row stays (number 1).  Margins are written once a round (so lineage stays one round long); bins
and trees are nested comparisons that compile with the query, scoring needs no Python.  A null or NaN feature is in the lowest bin; ties
between splits go to the first feature, then the lowest bin; a row without a label takes no part.
"""

from __future__ import annotations

import json
import random
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import RANDOM_SEED
from ..session import scratch_path

MIN_CHILD_HESSIAN = 1.0  # own choice of the fitted library's default: least hessian sum of a child
MIN_HESSIAN = 1e-16
_LEAST_GAIN = 1e-9


@dataclass
class Tree:
    """Nodes in heap order: ``feature`` -1 at a leaf; a row goes left where its bin is <= ``bin``."""

    feature: list[int]
    bin: list[int]
    weight: list[float]
    depth: int


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    base: list[float]
    rate: float
    classes: list[str] | None = None
    rounds: list[list[Tree]] = field(default_factory=list)


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 64) -> list[list[float]]:
    """Edges from mergeable approximate percentiles, at most ``bins`` - 1 a feature."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.nanvl(_c(f).cast("double"), F.lit(None).cast("double")), probs, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(row[f"e{i}"] or [])) for i in range(len(features))]


def binned(features: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """Bin of every feature: the number of its edges below the value."""

    def below(x: Column, own: Sequence[float], lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > own[mid], below(x, own, mid + 1, hi)).otherwise(below(x, own, lo, mid))

    def one(x: Column, own: Sequence[float]) -> Column:
        own = sorted(float(e) for e in own)
        return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(below(x, own, 0, len(own)))

    return F.array(*[one(_c(name).cast("double"), own) for name, own in zip(features, edges, strict=True)])


def _walk(tree: Tree, bins: Column, steps: int, end: Callable[[int], Column], node: int = 0) -> Column:
    """``end`` of the node a row reaches in ``steps`` steps, as nested comparisons."""
    f = tree.feature[node]
    if not steps or f < 0:
        return end(node)
    left, right = (_walk(tree, bins, steps - 1, end, node * 2 + side) for side in (1, 2))
    return F.when(F.get(bins, F.lit(f)) > tree.bin[node], right).otherwise(left)


def node_of(tree: Tree, bins: Column, depth: int | None = None) -> Column:
    """The node a row reaches in ``depth`` steps."""
    return _walk(tree, bins, tree.depth if depth is None else depth, F.lit)


def leaf_weight(tree: Tree, bins: Column) -> Column:
    return _walk(tree, bins, tree.depth, lambda node: F.lit(float(tree.weight[node])))


def best_splits(hist: Sequence, penalty: float, least: float = MIN_CHILD_HESSIAN) -> dict[tuple[int, int], tuple[int, int]]:
    """(class, node) -> (feature, bin) of the best split, from rows (k, node, f, bin, g, h)."""
    by: dict[tuple[int, int], dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for r in hist:
        by[r["k"], r["node"]][r["f"]].append((r["bin"], r["g"], r["h"]))
    out = {}
    for key, features in by.items():
        best = _LEAST_GAIN
        for f in sorted(features):
            rows = sorted(features[f])
            total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
            whole = total_g * total_g / (total_h + penalty)
            g = h = 0.0
            for b, one_g, one_h in rows[:-1]:
                g, h = g + one_g, h + one_h
                if h < least or total_h - h < least:
                    continue
                gain = g * g / (h + penalty) + (total_g - g) ** 2 / (total_h - h + penalty) - whole
                if gain > best + _LEAST_GAIN * abs(best):
                    best, out[key] = gain, (f, b)
    return out


def _gradients(k: int, margins: Column, y: Column, classes: int) -> tuple[Column, Column]:
    """Summed over the ``n`` rows that a row stands for; ``y`` is their class, or the sum of their labels."""
    n = F.col("n")
    if classes == 1:
        return n * F.get(margins, F.lit(0)) - y, n.cast("double")
    top = F.array_max(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda a, m: a + F.exp(m - top))
    p = F.exp(F.get(margins, F.lit(k)) - top) / total
    return n * (p - (y == k).cast("double")), n * F.greatest(2.0 * p * (1.0 - p), F.lit(MIN_HESSIAN))


def fit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: Mapping,
    edges: Sequence[Sequence[float]] | None = None,
    classify: bool = False,
    key: Sequence[str] = (),
    seed: int = RANDOM_SEED,
) -> Boosted:
    """Boosted trees with the parameters of ``params`` (n_estimators, max_depth, learning_rate, reg_lambda, subsample, colsample_bytree).

    Rows are sampled by a hash of ``key`` (default: all columns read) and the round, so a task run again takes the same rows."""
    kind = _c(label).cast("string" if classify else "double")
    rows = df.filter(kind.isNotNull())
    edges = [list(e) for e in (edges or quantile_edges(rows, features))]
    depth, rate, penalty = int(params["max_depth"]), float(params["learning_rate"]), float(params.get("reg_lambda", 1.0))
    share, columns = float(params.get("subsample", 1.0)), float(params.get("colsample_bytree", 1.0))
    if share < 1:
        # a row is drawn by its own hash
        hashed = F.xxhash64(*[_c(c) for c in (key or [*features, label])])
        merged = rows.select(binned(features, edges).alias("bins"), kind.alias("y"), F.lit(1).cast("bigint").alias("n"), hashed.alias("key"))
    else:
        of = rows.select(binned(features, edges).alias("bins"), kind.alias("y"))
        by, total = (["bins", "y"], []) if classify else (["bins"], [F.sum("y").alias("y")])
        merged = of.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *total).withColumn("key", F.lit(0).cast("bigint"))
    merged = _written(merged, "boost")
    classes = None
    if classify:
        # one row per class
        classes = [r[0] for r in merged.select("y").distinct().orderBy("y").collect()]
        y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")).cast("double") - 1 if classes else F.lit(0.0)
        base = [0.0] * len(classes)
    else:
        y = F.col("y")
        base = [float(merged.agg(F.sum("y") / F.sum("n")).first()[0] or 0.0)]
    n = len(base)
    model = Boosted(list(features), edges, base, rate, classes)
    if not n:
        return model
    state = merged.select("bins", y.alias("y"), "n", F.array(*[F.lit(b) for b in base]).alias("margins"), "key")
    for r in range(int(params["n_estimators"])):
        rng = random.Random(f"{seed}:{r}")
        size = 2 ** (depth + 1) - 1
        trees = [Tree([-1] * size, [0] * size, [0.0] * size, depth) for _ in range(n)]
        used = [sorted(rng.sample(range(len(features)), max(1, round(columns * len(features))))) for _ in range(n)]
        drawn = state
        if share < 1:
            drawn = state.filter(F.pmod(F.xxhash64("key", F.lit(seed), F.lit(r)), F.lit(1_000_000)) < int(share * 1_000_000))
        for level in range(depth):
            cells = []
            for k, tree in enumerate(trees):
                g, h = _gradients(k, F.col("margins"), F.col("y"), n)
                cells.append(F.struct(F.lit(k).alias("k"), node_of(tree, F.col("bins"), level).alias("node"), g.alias("g"), h.alias("h")))
            one = drawn.select("bins", F.explode(F.array(*cells)).alias("t")).filter(F.col("t.node") >= 2**level - 1)
            own = F.get(F.array(*[F.array(*[F.lit(f) for f in u]) for u in used]), F.col("t.k"))
            cell = one.select("t.*", "bins", F.explode(own).alias("f")).withColumn("bin", F.get(F.col("bins"), F.col("f")))
            hist = cell.groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for (k, node), (f, b) in best_splits(hist, penalty).items():
                trees[k].feature[node], trees[k].bin[node] = f, b
        ends = []
        for k, tree in enumerate(trees):
            g, h = _gradients(k, F.col("margins"), F.col("y"), n)
            ends.append(F.struct(F.lit(k).alias("k"), node_of(tree, F.col("bins")).alias("node"), g.alias("g"), h.alias("h")))
        sums = drawn.select(F.explode(F.array(*ends)).alias("t")).groupBy("t.k", "t.node").agg(F.sum("t.g").alias("g"), F.sum("t.h").alias("h"))
        for s in sums.collect():
            trees[s["k"]].weight[s["node"]] = -rate * s["g"] / (s["h"] + penalty)
        model.rounds.append(trees)
        moved = [F.get(F.col("margins"), F.lit(k)) + leaf_weight(t, F.col("bins")) for k, t in enumerate(trees)]
        state = _written(state.select("bins", "y", "n", F.array(*moved).alias("margins"), "key"), "boost")
    return model


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def margins(model: Boosted, bins: Column) -> Column:
    """Summed leaf weights per class."""
    return F.array(*[sum((leaf_weight(trees[k], bins) for trees in model.rounds), F.lit(b)) for k, b in enumerate(model.base)])


def predict(model: Boosted, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Regression: ``out``.  Classes: ``out`` is the likeliest (ties: the first), ``probabilities`` a map of class to probability."""
    scored = df.withColumn("__bins", binned(model.features, model.edges)).withColumn("__m", margins(model, F.col("__bins")))
    if model.classes is None:
        return scored.withColumn(out, F.get(F.col("__m"), F.lit(0))).drop("__bins", "__m")
    top = F.array_max("__m")
    weights = F.transform("__m", lambda m: F.exp(m - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    names = F.array(*[F.lit(c) for c in model.classes])
    return (
        scored.withColumn(out, F.get(names, (F.array_position("__m", top) - 1).cast("int")))
        .withColumn("probabilities", F.map_from_arrays(names, F.transform(weights, lambda w: w / total)))
        .drop("__bins", "__m")
    )


def as_table(spark, model: Boosted) -> DataFrame:
    """The model as rows (round, class, node, feature, edge, weight): one a node, for storing and for scoring in SQL."""
    rows = []
    for r, trees in enumerate(model.rounds):
        for k, t in enumerate(trees):
            for node, f in enumerate(t.feature):
                edge = model.edges[f][t.bin[node]] if f >= 0 and t.bin[node] < len(model.edges[f]) else None
                rows.append((r, model.classes[k] if model.classes else None, node, model.features[f] if f >= 0 else None, edge, t.weight[node]))
    return spark.createDataFrame(rows, "round int, class string, node int, feature string, edge double, weight double")


def save_boosted(spark, model: Boosted, path: str) -> None:
    """The model as one JSON row."""
    spark.createDataFrame([(json.dumps(asdict(model)),)], "model string").write.mode("overwrite").parquet(path)


def load_boosted(spark, path: str) -> Boosted:
    saved = json.loads(spark.read.parquet(path).first()["model"])
    saved["rounds"] = [[Tree(**t) for t in trees] for trees in saved["rounds"]]
    return Boosted(**saved)
