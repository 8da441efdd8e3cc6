"""Additive feature contributions of tree ensembles (M7, K2).

Path-dependent TreeSHAP (Lundberg, Erion, Lee 2018, "Consistent
individualized feature attribution for tree ensembles"), in its per-path
form: every root-to-leaf path contributes on its own (as in GPUTreeShap,
Mitchell et al. 2022).  For a path with unique features, a row only decides
whether each split is "hot", 0/1, so the EXTEND / UNWIND weight recursion runs
once for every pattern of hot splits of the path (2^depth, before the rows are
dealt), and a row looks its pattern up; which rows meet a
condition is found once for all paths that hold it.  The work per batch is
O(paths x depth) vectorised operations.  Paths of more than ``TABLE_DEPTH``
features run the recursion over the rows of the batch.

The trees come from the saved model (Spark ML writes every node with its
split, children, prediction and ``rawCount`` = training rows reaching the
node, i.e. the cover).  The node table is read once on the driver (its size
is the model's, not the data's), broadcast to the executors, and the
scoring table is processed by ``mapInPandas``: the rows never leave Spark.
Rows that lie between the same bounds of all paths are brought together and worked out once a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import TOP_N_CONTRIBUTIONS
from ..session import scratch_path
from .forests import bins_of, countable, with_cell

TABLE_DEPTH = 10


@dataclass
class Path:
    features: np.ndarray  # unique feature per element (root excluded)
    zero: np.ndarray  # cover fraction per element
    lo: np.ndarray  # per element: lower bound (exclusive) of the feature on the path, -inf if none
    hi: np.ndarray  # per element: upper bound (inclusive), +inf if none
    value: np.ndarray  # leaf value (scalar regression, vector of class shares)
    weight: float  # tree weight
    cover: float  # training rows reaching the leaf
    table: np.ndarray | None = None  # per element and pattern of hot splits (bit per element): its share of the value


def _paths_of_tree(nodes: pd.DataFrame, weight: float, classes: int | None) -> list[Path]:
    by_id = {int(r.id): r for r in nodes.itertuples(index=False)}
    out: list[Path] = []

    def leaf_value(r) -> np.ndarray:
        if classes is None:
            return np.array([float(r.prediction)])
        stats = np.asarray(r.impurityStats, dtype=float)
        tot = stats.sum()
        return stats / tot if tot > 0 else np.full(classes, 1.0 / classes)

    def walk(node_id: int, conds: list[tuple[int, float, float, float]]):
        r = by_id[node_id]
        if int(r.leftChild) < 0:
            merged: dict[int, list[float]] = {}
            for f, z, lo, hi in conds:
                if f in merged:
                    m = merged[f]
                    m[0] *= z
                    m[1] = max(m[1], lo)
                    m[2] = min(m[2], hi)
                else:
                    merged[f] = [z, lo, hi]
            feats = np.array(list(merged.keys()), dtype=int)
            vals = np.array(list(merged.values()), dtype=float).reshape(-1, 3)
            out.append(Path(feats, vals[:, 0], vals[:, 1], vals[:, 2], leaf_value(r), weight, float(r.rawCount)))
            return
        f = int(r.featureIndex)
        thr = float(r.threshold)
        cover = float(r.rawCount)
        left, right = by_id[int(r.leftChild)], by_id[int(r.rightChild)]
        zl = float(left.rawCount) / cover if cover > 0 else 0.5
        zr = float(right.rawCount) / cover if cover > 0 else 0.5
        walk(int(r.leftChild), conds + [(f, zl, -np.inf, thr)])
        walk(int(r.rightChild), conds + [(f, zr, thr, np.inf)])

    walk(int(nodes["id"].min()), [])
    return out


def load_paths(spark: SparkSession, model_path: str, kind: str) -> tuple[list[Path], np.ndarray]:
    """Paths of all trees of a saved GBT / RF stage, and the expected value (base).

    ``kind``: 'gbt' (weighted sum), 'rf' (average), 'rf_classes' (average of class shares).
    """
    data = spark.read.parquet(f"{model_path}/data").select("treeID", "nodeData.*")
    nodes = data.select(
        "treeID",
        "id",
        "prediction",
        "impurityStats",
        "rawCount",
        "leftChild",
        "rightChild",
        F.col("split.featureIndex").alias("featureIndex"),
        F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col("split.numCategories").alias("numCategories"),
    ).toPandas()  # model-sized, not data-sized
    if (nodes["numCategories"].fillna(-1) > 0).any():
        raise ValueError("categorical splits are not supported; assemble categories as numeric codes")
    trees = sorted(nodes["treeID"].unique())
    if kind == "gbt":
        w = spark.read.parquet(f"{model_path}/treesMetadata").toPandas()
        wcol = "weights" if "weights" in w.columns else w.columns[-1]
        tcol = "treeID" if "treeID" in w.columns else w.columns[0]
        weights = dict(zip(w[tcol].astype(int), w[wcol].astype(float)))
    else:
        weights = {t: 1.0 / len(trees) for t in trees}
    classes = None
    if kind == "rf_classes":
        classes = len(nodes["impurityStats"].iloc[0])
    paths: list[Path] = []
    base = None
    for t in trees:
        tn = nodes[nodes["treeID"] == t]
        ps = _paths_of_tree(tn, weights[int(t)], classes)
        root_cover = float(tn.loc[tn["id"] == tn["id"].min(), "rawCount"].iloc[0])
        # expected value of the tree: cover-weighted mean of its leaves
        ev = sum(p.value * p.cover for p in ps) / root_cover * weights[int(t)]
        base = ev if base is None else base + ev
        paths.extend(ps)
    return paths, np.atleast_1d(base)


def _shares(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Share of the path's value per element and row of ``one`` (rows x elements, 1.0 where the split is hot)."""
    n, d = one.shape
    # EXTEND over the root (z=1, o=1) and the d elements
    w = [np.ones(n)]
    zs = [1.0]
    os_ = [np.ones(n)]
    for k in range(d):
        z, o = zero[k], one[:, k]
        length = len(w)
        w.append(np.zeros(n))
        for i in range(length - 1, -1, -1):
            w[i + 1] = w[i + 1] + o * w[i] * (i + 1) / (length + 1)
            w[i] = z * w[i] * (length - i) / (length + 1)
        zs.append(z)
        os_.append(o)
    L = len(w) - 1
    out = np.zeros((d, n))
    for k in range(1, L + 1):
        z, o = zs[k], os_[k]
        # UNWOUND_SUM with element k removed, for o = 1 and o = 0 at once
        total1 = np.zeros(n)
        nxt = w[L].copy()
        for j in range(L - 1, -1, -1):
            tmp = nxt * (L + 1) / (j + 1)
            total1 += tmp
            nxt = w[j] - tmp * z * (L - j) / (L + 1)
        total0 = np.zeros(n)
        if z > 0:
            for j in range(L - 1, -1, -1):
                total0 += w[j] / (z * (L - j) / (L + 1))
        out[k - 1] = np.where(o > 0, total1, total0) * (o - z)
    return out


def with_tables(paths: Sequence[Path]) -> list[Path]:
    """The paths with the shares of all their patterns, paths of equal cover fractions sharing one table."""
    known: dict[bytes, np.ndarray] = {}
    out = []
    for p in paths:
        d = len(p.features)
        if p.table is None and 0 < d <= TABLE_DEPTH:
            key = p.zero.tobytes()
            if key not in known:
                known[key] = _shares((np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float), p.zero)
            p = replace(p, table=known[key])
        out.append(p)
    return out


def shap_values(x: np.ndarray, paths: Sequence[Path], n_out: int) -> np.ndarray:
    """Contributions, rows x features x outputs."""
    n = x.shape[0]
    phi = np.zeros((n_out, x.shape[1], n))
    columns = np.ascontiguousarray(x.T)
    hot: dict[tuple[int, float, float], np.ndarray] = {}

    def meets(f: int, lo: float, hi: float) -> np.ndarray:
        if (f, lo, hi) not in hot:
            c = columns[f]
            # Spark sends NaN right at every split: it satisfies only bounds open to the right
            hot[f, lo, hi] = np.where(np.isnan(c), np.isinf(hi), (c > lo) & (c <= hi))
        return hot[f, lo, hi]

    for p in with_tables(paths):
        d = len(p.features)
        if d == 0:
            continue
        ones = [meets(int(f), float(lo), float(hi)) for f, lo, hi in zip(p.features, p.lo, p.hi, strict=True)]
        if p.table is None:
            shares = _shares(np.stack(ones, axis=1).astype(float), p.zero)
        else:
            pattern = np.zeros(n, np.int16)
            for k, one in enumerate(ones):
                pattern |= one.astype(np.int16) << k
        for k, f in enumerate(p.features):
            for c, value in enumerate(p.value):
                phi[c, f] += (p.table[k] * (value * p.weight))[pattern] if p.table is not None else shares[k] * (value * p.weight)
    return phi.transpose(2, 1, 0)


def contributions(
    df: DataFrame,
    features: Sequence[str],
    paths: Sequence[Path],
    base: np.ndarray,
    keep: Sequence[str],
    class_col: str | None = None,
    top_n: int = TOP_N_CONTRIBUTIONS,
) -> DataFrame:
    """M7 + K2: top-n contributions by |value|, largest first, for each row.

    For a classifier, ``class_col`` holds the index of the class to explain
    (the predicted one).  Output: ``keep`` columns, ``base_value``,
    ``contributions`` (array of (feature, value)) and ``contribution_sum``
    (all features; base + sum = model output).
    """
    feats = list(features)
    keep = list(keep)
    n_out = len(base)
    # model-sized, shipped once per executor (a closure would travel with every task)
    paths_bc = df.sparkSession.sparkContext.broadcast(with_tables(paths))
    base = np.asarray(base, dtype=float)
    extra = [c for c in ([class_col] if class_col else []) if c not in keep]
    src = df.select(*keep, *extra, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)])
    keep_types = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    out_schema = (
        keep_types + ", base_value double, contributions array<struct<feature:string,value:double>>, contribution_sum double"
    )
    xcols = [f"_x{i}" for i in range(len(feats))]

    def shares(x: np.ndarray, k: np.ndarray) -> tuple[list, np.ndarray]:
        """Top contributions and their sum per row of ``x``, for the output ``k`` of each."""
        sel = shap_values(x, paths_bc.value, n_out)[np.arange(len(x)), :, k]
        order = np.argsort(-np.abs(sel), axis=1, kind="stable")[:, :top_n]
        return [[{"feature": feats[j], "value": float(sel[i, j])} for j in order[i]] for i in range(len(x))], sel.sum(axis=1)

    def run(batches):
        for pdf in batches:
            res = pdf[keep].copy()
            if len(pdf) == 0:
                res["base_value"] = []
                res["contributions"] = []
                res["contribution_sum"] = []
                yield res
                continue
            k = pdf[class_col].to_numpy(dtype=int) if class_col else np.zeros(len(pdf), dtype=int)
            res["base_value"] = base[k]
            if points is None:
                top, total = shares(pdf[xcols].to_numpy(dtype=float), k)
            else:
                found, row = np.unique(np.stack([pdf["_cell"].to_numpy(np.int64), k]), axis=1, return_inverse=True)
                # the upper end of a bin lies on the same sides of all conditions as the rows of the bin
                ends = [np.append(p, np.inf)[b] for p, b in zip(points, bins_of(found[0], points), strict=True)]
                top, total = shares(np.stack(ends, axis=1), found[1])
                row = row.reshape(-1)
                top, total = [top[i] for i in row], total[row]
            res["contributions"] = top
            res["contribution_sum"] = total
            yield res

    # bounds of the paths' conditions: rows between the same bounds have the same contributions
    points = [np.unique([b for p in paths for f, lo, hi in zip(p.features, p.lo, p.hi, strict=True) if f == i for b in (lo, hi) if np.isfinite(b)]) for i in range(len(feats))]
    if not countable(points):
        points = None
        return src.mapInPandas(run, out_schema)
    # such rows come together in batches, a large cell dealt to many tasks; written first, as range bounds are sampled
    written = scratch_path(df.sparkSession, "attributed")
    with_cell(src, xcols, points).drop(*xcols).withColumn("_spread", F.xxhash64(*keep)).write.parquet(written)
    rows = df.sparkSession.read.parquet(written)
    n = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, "_cell", "_spread").sortWithinPartitions("_cell").mapInPandas(run, out_schema)
