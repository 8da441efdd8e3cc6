"""Split, evaluation, registry, scoring helpers."""

import math

from pyspark.sql import functions as F

from panelspark.functions.columns import interval_bounds
from panelspark.operators import registry as RG
from panelspark.operators.evaluation import class_metrics, class_report, regression_metrics
from panelspark.operators.split import group_split
from panelspark.operators.views import argmax_class, sorted_probabilities
from tests.conftest import rows


def test_group_split_disjoint_b10(spark):
    ents = spark.range(1000).select(F.col("id").cast("string").alias("e"))
    df = ents.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    out = group_split(df, "e")
    sides = out.groupBy("e").agg(F.countDistinct("side").alias("n")).filter("n > 1").count()
    assert sides == 0
    share = out.select("e", "side").distinct().filter("side = 'test'").count() / 1000
    assert abs(share - 0.2) < 0.05
    exact = group_split(df, "e", exact_count=True)
    assert exact.select("e", "side").distinct().filter("side = 'test'").count() == 200


def test_regression_metrics_b11(spark):
    y = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    p = [1.5, 2.0, 2.5, 4.0, 5.5, 5.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    m = regression_metrics(df, "y", "p").first()
    e = [a - b for a, b in zip(y, p)]
    mean_y = sum(y) / 6
    r2 = 1 - sum(x * x for x in e) / sum((a - mean_y) ** 2 for a in y)
    mu = sum(e) / 6
    std = math.sqrt(sum((x - mu) ** 2 for x in e) / 6)
    assert abs(m["mae"] - sum(abs(x) for x in e) / 6) < 1e-12
    assert abs(m["r2"] - r2) < 1e-12
    assert abs(m["residual_std"] - std) < 1e-12
    assert m["n_test"] == 6


def test_macro_f1_is_not_weighted_b11(spark):
    data = [("a", "a")] * 5 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(data, "y string, p string")
    m = class_metrics(df, "y", "p").first()
    rep = {r["cls"]: r for r in class_report(df, "y", "p").collect()}
    f1 = {"a": 2 * (5 / 6) * (5 / 6) / (5 / 6 + 5 / 6), "b": 2 * (2 / 3) * 1.0 / (2 / 3 + 1.0), "c": 0.0}
    for k, v in f1.items():
        assert abs(rep[k]["f1"] - v) < 1e-12
    assert abs(m["macro_f1"] - sum(f1.values()) / 3) < 1e-12
    weighted = (f1["a"] * 6 + f1["b"] * 2 + f1["c"] * 1) / 9
    assert abs(m["macro_f1"] - weighted) > 1e-3
    assert abs(m["accuracy"] - 7 / 9) < 1e-12


def test_gate_and_archive_a6(spark):
    gates = RG.gates_table(spark, {"gini": ("r2", 0.4), "mobility": ("r2", 0.15)})
    runs = spark.createDataFrame(
        [("gini", 1, "r2", 0.6), ("gini", 2, "r2", 0.1), ("gini", 3, "r2", 0.6), ("gini", 4, "r2", 0.1), ("mobility", 1, "r2", 0.2)],
        "target string, version int, metric string, value double",
    )
    st = {(r["target"], r["version"]): (r["stage"], r["passed"]) for r in RG.version_stages(runs, gates).collect()}
    assert st[("gini", 1)] == ("Archived", True)
    assert st[("gini", 2)] == ("Staging", False)
    assert st[("gini", 3)] == ("Production", True)
    assert st[("gini", 4)] == ("Staging", False)
    assert st[("mobility", 1)] == ("Production", True)


def test_status_upsert_leaves_other_targets(spark):
    status = spark.createDataFrame([("gini", 1), ("mobility", 7)], "target string, version int")
    new = spark.createDataFrame([("gini", 2)], "target string, version int")
    assert rows(RG.upsert_status(status, new)) == [("gini", 2), ("mobility", 7)]


def test_run_status_b15(spark):
    outcomes = spark.createDataFrame(
        [(1, "a", True), (1, "b", False), (1, "c", True), (2, "a", False), (2, "b", False), (2, "c", False), (3, "a", True), (3, "b", True), (3, "c", True)],
        "run int, target string, ok boolean",
    )
    got = dict(rows(RG.run_status(outcomes), "run", "status"))
    assert got == {1: "partial_success", 2: "failed", 3: "success"}


def test_interval_and_probabilities_a7(spark):
    df = spark.createDataFrame([(42.0, 5.0), (42.0, None)], "p double, s double")
    lo, hi = interval_bounds("p", "s")
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert (42.0 - 1.28 * 5.0, 42.0 + 1.28 * 5.0) in got
    assert (None, None) in got
    cls = ["High income", "Low income", "Lower middle income", "Upper middle income"]
    probs = spark.createDataFrame([(cls, [0.1, 0.2, 0.6, 0.1])], "c array<string>, p array<double>")
    r = probs.select(argmax_class("c", "p").alias("k"), sorted_probabilities("c", "p").alias("s")).first()
    assert r["k"] == "Lower middle income"
    assert abs(sum(x["p"] for x in r["s"]) - 1.0) < 1e-12


def test_run_targets_continues_after_failure_b15(spark):
    def boom():
        raise RuntimeError("no data")

    out = RG.run_targets(spark, 1, {"gini": lambda: None, "mobility": boom, "income_group": lambda: None})
    assert rows(out, "target", "ok") == [("gini", True), ("income_group", True), ("mobility", False)]
    assert rows(RG.run_status(out), "status") == [("partial_success",)]


def test_serving_version_latest_vs_production_f1(spark):
    st = spark.createDataFrame(
        [("gini", 1, "Archived"), ("gini", 2, "Production"), ("gini", 3, "Staging"), ("mobility", 1, "Staging")],
        "target string, version int, stage string",
    )
    assert rows(RG.serving_versions(st, "latest"), "target", "version") == [("gini", 3), ("mobility", 1)]
    assert rows(RG.serving_versions(st, "production"), "target", "version") == [("gini", 2)]


def test_nan_metric_does_not_pass_a_gate(spark):
    from panelspark.operators.registry import gates_table, version_stages

    runs = spark.createDataFrame([("gini", 1, "r2", 0.6), ("gini", 2, "r2", float("nan"))], "target string, version int, metric string, value double")
    got = {r["version"]: (r["passed"], r["stage"]) for r in version_stages(runs, gates_table(spark)).collect()}
    assert got == {1: (True, "Production"), 2: (False, "Staging")}


def test_registry_keeps_the_other_targets_and_survives_a_replay(spark, tmpdir_path):
    from panelspark.operators.registry import append_run, read_current

    def rows_of(*rows):
        return spark.createDataFrame(list(rows), "target string, version int")

    path = f"{tmpdir_path}/registry"
    append_run(rows_of(("gini", 1), ("mobility", 1)), path, 1)
    for _ in range(2):
        append_run(rows_of(("gini", 2)), path, 2)
    assert sorted(tuple(r) for r in read_current(spark, path).collect()) == [("gini", 2), ("mobility", 1)]


def test_forests_keep_the_nodes_of_rows_and_share_the_feature_table(spark, monkeypatch):
    from panelspark.operators import models as M
    from panelspark.plans import model_queries as Q

    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 3)) for i in range(200)], "a double, b double, y double").coalesce(1)
    rows_in = M.assembler(["a", "b"]).transform(df)
    est = M.rf_regressor("y", {"n_estimators": 5, "max_depth": 4, "min_samples_leaf": 3})
    assert est.getCacheNodeIds() and M.rf_classifier("y").getCacheNodeIds()
    plain = est.copy().setCacheNodeIds(False).fit(rows_in)
    assert est.fit(rows_in).toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]

    table = df.selectExpr("a as priority_level", "b as urgent_share", "y as gini_index_lag1", "a as region_code", "b as income_group_lag1_code", "y as gini_index", "a as acctbal",
                          "if(a = 3, 'test', 'train') as side")
    built = []
    monkeypatch.setattr(Q, "feature_table", lambda *_: built.append(1) or table)
    for name in ("MODEL_GINI", "MODEL_MOBILITY"):
        monkeypatch.setattr(Q, name, {**getattr(Q, name), "n_estimators": 2, "max_depth": 2})
    for target in ("gini", "mobility"):
        assert Q.trained(spark, "no folder", target)[2]["n_test"] > 0
    assert len(built) == 1


def _tabular(spark, n=3000):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 6, n).astype(float), "c": rng.random(n).round(3)})
    pdf["y"] = pdf.a * 2 + pdf.b**2 + rng.normal(size=n)
    pdf["k"] = [f"c{int(v) // 2}" for v in pdf.b + rng.integers(0, 3, n)]
    return spark.createDataFrame(pdf).repartition(3).persist()


def test_trees_over_cells_are_spark_mls_where_no_row_is_drawn(spark, monkeypatch):
    from panelspark.operators import forests
    from panelspark.operators import models as M

    monkeypatch.setattr(forests, "CHUNK_ROWS", 700)  # cells that span chunks
    monkeypatch.setattr(forests, "BLOCK_SUMS", 5000)  # a few rounds at a time
    df, features = _tabular(spark), ["a", "b", "c"]
    idx = M.label_indexer("k", "_l").fit(df)
    estimators = [
        (M.gbt_regressor("y", {"n_estimators": 5, "max_depth": 5, "learning_rate": 0.05}), df, 0),
        (M.rf_regressor("y", {"n_estimators": 1, "max_depth": 8, "min_samples_leaf": 3}).setBootstrap(False), df, 0),
        (M.rf_classifier("_l", {"n_estimators": 1, "max_depth": 4}).setBootstrap(False), idx.transform(df), len(idx.labels)),
    ]
    for est, table, classes in estimators:
        vectors = M.assembler(features).transform(table)
        plain, ours = est.fit(vectors), forests.train(est, table, features, classes)
        assert type(ours) is type(plain) and ours.treeWeights == plain.treeWeights
        assert (ours.totalNumNodes, ours.getMaxDepth()) == (plain.totalNumNodes, plain.getMaxDepth())
        assert max(abs(ours.featureImportances.toArray() - plain.featureImportances.toArray())) < 1e-12
        both = plain.transform(vectors).select(*df.columns, F.col("prediction").alias("p"), "features")
        assert ours.transform(both).filter(F.abs(F.col("p") - F.col("prediction")) > 1e-9).count() == 0


def test_large_tables_train_over_cells_with_every_row_drawn(spark, monkeypatch):
    import numpy as np
    import pytest

    from panelspark.operators import forests
    from panelspark.operators import models as M

    df, features = _tabular(spark), ["a", "b", "c"]
    monkeypatch.setattr(forests, "LARGE_ROWS", 1000)
    monkeypatch.setattr(M.Pipeline, "fit", None)  # not Spark ML's training
    gbt = M.fit_regressor(df, features, "y", "gbt", {"n_estimators": 30, "max_depth": 4, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8})
    rf = M.fit_regressor(df, features, "y", "rf", {"n_estimators": 25, "max_depth": 8, "min_samples_leaf": 3})
    classes = M.fit_classifier(df, features, "k", {"n_estimators": 25, "max_depth": 4, "subsample": 0.8})
    for m in (gbt, rf):
        assert regression_metrics(m.transform(df), "y", "prediction").first()["r2"] > 0.95
    assert class_metrics(M.score_classes(classes, df, "k"), "k", "predicted_label").first()["accuracy"] > 0.6
    assert [len(m.stages[1].treeWeights) for m in (gbt, rf)] == [30, 25] and len(classes.stages[2].treeWeights) == 25
    with pytest.raises(Exception, match="NaN or infinite"):
        M.fit_regressor(df.withColumn("y", F.when(F.col("b") == 1, F.lit(float("nan"))).otherwise(F.col("y"))), features, "y", "rf")
    # the roots' rows: Poisson of rate 1, and 80 of 100 rows each once; other rows for every tree
    path = forests.scratch_path(spark, "draws")
    for m, low, high in ((rf, 2800, 3200), (gbt, 2300, 2500)):
        m.write().overwrite().save(path)
        raw = [r[0] for r in spark.read.parquet(f"{path}/stages/1_{m.stages[1].uid}/data").filter("nodeData.id = 0").select("nodeData.rawCount").collect()]
        assert all(low < x < high for x in raw) and len(set(raw)) > 15
    w = forests.weights_of(1.0, True)(np.random.default_rng(1), 400_000)
    for k, p in enumerate([0.36788, 0.36788, 0.18394, 0.06131, 0.01533]):
        assert abs((w == k).mean() - p) < 0.004


def test_too_many_cells_go_to_spark_ml(spark, monkeypatch):
    from panelspark.operators import forests
    from panelspark.operators import models as M

    df = _tabular(spark)
    monkeypatch.setattr(forests, "LARGE_ROWS", 1000)
    monkeypatch.setattr(forests, "MAX_CELLS", 100)
    monkeypatch.setattr(forests, "_save", None)
    m = M.fit_regressor(df, ["a", "b", "c"], "y", "rf", {"n_estimators": 2, "max_depth": 3})
    assert m.transform(df).filter("prediction is null").count() == 0


def test_rows_between_the_same_thresholds_are_scored_once(spark, tmpdir_path, monkeypatch):
    from panelspark.operators import forests
    from panelspark.operators import models as M

    df, features = _tabular(spark), ["a", "b", "c"]
    monkeypatch.setattr(forests, "LARGE_ROWS", 1000)
    m = M.fit_regressor(df, features, "y", "rf", {"n_estimators": 3, "max_depth": 2, "min_samples_leaf": 3})
    m.write().overwrite().save(tmpdir_path)
    points = forests.model_points(spark, f"{tmpdir_path}/stages/1_{m.stages[1].uid}", 3)
    odd = df.select(F.when(F.col("b") > 0, F.col("a")).alias("a"), "b", F.when(F.col("b") == 2, F.lit(float("nan"))).otherwise(F.col("c")).alias("c"), "y", "k")
    odd = odd.unionByName(df.limit(5)).unionByName(spark.createDataFrame([(float(points[0][0]), 1.0, 0.5, 0.0, "x")], df.schema))
    seen = []
    transform = type(m).transform
    monkeypatch.setattr(type(m), "transform", lambda self, d: seen.append(d) or transform(self, d))
    plain, fast = transform(m, odd), M.predicted(m, odd, points)
    assert fast.columns == plain.columns
    key = ["a", "b", "c", "y", "k", "prediction"]
    assert plain.select(key).exceptAll(fast.select(key)).count() == 0 and fast.count() == odd.count()
    assert min(d.count() for d in seen) < 100  # rows that were scored
