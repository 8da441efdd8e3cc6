"""TreeSHAP against brute-force Shapley values of the path-dependent value function."""

import itertools
import math

import numpy as np
import pandas as pd

from panelspark.operators.attribution import _paths_of_tree, shap_values

# a depth-3 tree over 3 features; feature 0 is split twice on one path
NODES = pd.DataFrame(
    [
        # id, prediction, impurityStats, rawCount, left, right, feature, threshold
        (0, 0.0, [], 100, 1, 2, 0, 0.5),
        (1, 0.0, [], 60, 3, 4, 1, 1.0),
        (2, 0.0, [], 40, 5, 6, 0, 2.0),
        (3, 1.0, [], 20, -1, -1, -1, np.nan),
        (4, 5.0, [], 40, -1, -1, -1, np.nan),
        (5, -2.0, [], 30, 7, 8, 2, 0.0),
        (6, 7.0, [], 10, -1, -1, -1, np.nan),
        (7, 3.0, [], 10, -1, -1, -1, np.nan),
        (8, -4.0, [], 20, -1, -1, -1, np.nan),
    ],
    columns=["id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "featureIndex", "threshold"],
)


def tree_value(x, node, subset):
    r = NODES.set_index("id").loc[node]
    if r.leftChild < 0:
        return r.prediction
    left, right = int(r.leftChild), int(r.rightChild)
    f = int(r.featureIndex)
    if f in subset:
        return tree_value(x, left if x[f] <= r.threshold else right, subset)
    cl = NODES.set_index("id").loc[left].rawCount
    cr = NODES.set_index("id").loc[right].rawCount
    return (cl * tree_value(x, left, subset) + cr * tree_value(x, right, subset)) / (cl + cr)


def brute_shap(x, m=3):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for s in itertools.combinations(others, k):
                w = math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                phi[i] += w * (tree_value(x, 0, set(s) | {i}) - tree_value(x, 0, set(s)))
    return phi


def test_tree_shap_equals_brute_force():
    paths = _paths_of_tree(NODES, 1.0, None)
    xs = np.array([[0.0, 0.0, 0.0], [0.2, 3.0, -1.0], [1.0, 0.0, 1.0], [3.0, 5.0, -3.0], [1.5, 0.5, 0.0]])
    phi = shap_values(xs, paths, 1)[:, :, 0]
    base = tree_value(xs[0], 0, set())
    for row, x in enumerate(xs):
        np.testing.assert_allclose(phi[row], brute_shap(x), atol=1e-12)
        assert abs(base + phi[row].sum() - tree_value(x, 0, {0, 1, 2})) < 1e-12


def test_shares_of_a_path_are_worked_out_before_the_rows(monkeypatch):
    from panelspark.operators import attribution as A

    xs = np.random.default_rng(1).normal(size=(300, 3)) * 2
    xs[::17, 0] = np.nan
    paths = A.with_tables(_paths_of_tree(NODES, 0.5, None))
    assert all(p.table.shape == (len(p.features), 2 ** len(p.features)) for p in paths)
    monkeypatch.setattr(A, "TABLE_DEPTH", 0)  # the recursion over the rows
    plain = shap_values(xs, _paths_of_tree(NODES, 0.5, None), 1)
    monkeypatch.setattr(A, "_shares", None)
    np.testing.assert_array_equal(shap_values(xs, paths, 1), plain)


def test_nan_goes_right_like_spark():
    paths = _paths_of_tree(NODES, 1.0, None)
    x = np.array([[np.nan, 0.0, 0.0]])
    phi = shap_values(x, paths, 1)[0, :, 0]
    base = tree_value(np.zeros(3), 0, set())
    # NaN on feature 0 goes right twice -> leaf 6 (value 7)
    assert abs(base + phi.sum() - 7.0) < 1e-12


def test_contributions_add_up_to_prediction_on_spark_models(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from panelspark.operators.attribution import contributions, load_paths
    from panelspark.operators.models import fit_classifier, fit_regressor, score_classes
    from panelspark.plans.model_queries import FEATURES, feature_table
    from tests.conftest import SF_SMALL

    ft = feature_table(spark, SF_SMALL).persist()
    small_gbt = {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": "all"}
    for kind, params in [("gbt", small_gbt), ("rf", {"n_estimators": 6, "max_depth": 5, "min_samples_leaf": 3})]:
        m = fit_regressor(ft, FEATURES, "gini_index", kind, params)
        m.write().overwrite().save(f"{tmpdir_path}/{kind}")
        paths, base = load_paths(spark, f"{tmpdir_path}/{kind}/stages/1_{m.stages[1].uid}", kind)
        out = contributions(m.transform(ft), FEATURES, paths, base, keep=["entity", "time", "prediction"]).toPandas()
        assert (out.base_value + out.contribution_sum - out.prediction).abs().max() < 1e-9
        assert all(len(c) == 5 for c in out.contributions)
        mags = [[abs(x["value"]) for x in c] for c in out.contributions]
        assert all(m_ == sorted(m_, reverse=True) for m_ in mags)
    cls = fit_classifier(ft, FEATURES, "income_group", {"n_estimators": 5, "max_depth": 3, "subsample": 1.0})
    cls.write().overwrite().save(f"{tmpdir_path}/cls")
    paths, base = load_paths(spark, f"{tmpdir_path}/cls/stages/2_{cls.stages[2].uid}", "rf_classes")
    sc = score_classes(cls, ft, "income_group").withColumn("k", F.col("prediction").cast("int"))
    sc = sc.withColumn("pk", F.col("probability_array")[F.col("k")])
    out = contributions(sc, FEATURES, paths, base, keep=["entity", "pk"], class_col="k").toPandas()
    assert (out.base_value + out.contribution_sum - out.pk).abs().max() < 1e-9


def test_rows_between_the_same_bounds_are_attributed_once_a_batch(spark, monkeypatch):
    from panelspark.operators import attribution as A

    paths = _paths_of_tree(NODES, 0.5, None)
    xs = np.random.default_rng(2).normal(size=(400, 3)).round(2) * 2
    xs[::17, 0] = np.nan
    xs[1] = [0.5, 1.0, 0.0]  # on the thresholds
    xs[2] = [np.inf, 9.0, 9.0]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xs)], "id int, a double, b double, c double").coalesce(2)
    worked = spark.sparkContext.accumulator(0)

    def counting(x, p, n, f=A.shap_values):
        worked.add(len(x))
        return f(x, p, n)

    plain = A.shap_values(xs, paths, 1)[:, :, 0]
    monkeypatch.setattr(A, "shap_values", counting)
    got = A.contributions(df, ["a", "b", "c"], paths, np.array([1.0]), keep=["id"]).toPandas()
    assert sorted(got.id) == list(range(400)) and 0 < worked.value < 200
    for r in got.itertuples():
        assert abs(r.contribution_sum - plain[r.id].sum()) < 1e-12
        found = [(c["feature"], c["value"]) for c in r.contributions]
        assert sorted(found) == sorted(zip("abc", plain[r.id], strict=True))
