"""Registered model queries (M1-M7, A8-A11, C5-C7, K2, K3) on a feature
table built from the panel with the configured pipeline parameters.

Feature table: the customer x year panel through validation-free feature
building (time range, coverage >= 5 years, two-level impute, category
codes).  Targets: ``gini_index`` (boosted trees), the static account
balance (random forest, like the static mobility measures) and the income
group = nation name (random forest classifier; ``income_group_lag1_code``
leaks it exactly as in the original, see the leakage query).
Trained models are kept per session and data folder so the attribution
query reuses the boosted model instead of training it again; the models of a
folder share one persisted feature table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attribution import contributions, load_paths
from ..operators.evaluation import class_metrics, regression_metrics
from ..operators.features import build_features
from ..operators.forests import LARGE_ROWS, model_points
from ..operators.models import class_labels, fit_classifier, fit_regressor, predicted, score_classes, score_regression
from ..operators.split import group_split
from ..params import END_YEAR, MIN_YEARS_REQUIRED, MODEL_GINI, MODEL_INCOME_GROUP, MODEL_MOBILITY, START_YEAR
from ..schemas import DEFAULT_ROLES as R
from ..session import scratch_path
from .catalog import dims_panel, query, rounded

NUMERIC = ["priority_level", "urgent_share", "gini_index_lag1"]
CATEGORICAL = ["region", "income_group_lag1"]
FEATURES = NUMERIC + [c + "_code" for c in CATEGORICAL]

_MODELS: dict[tuple, tuple] = {}
_FEATURES: dict[tuple, DataFrame] = {}


def feature_table(spark, sf_dir) -> DataFrame:
    feats, _, _ = build_features(
        dims_panel(spark, sf_dir), START_YEAR, END_YEAR, MIN_YEARS_REQUIRED, NUMERIC, CATEGORICAL
    )
    return group_split(feats, R.entity)


def _key(spark, sf_dir, name):
    return (spark.sparkContext.applicationId, sf_dir, name)


def stage_dir(model, path: str) -> str:
    """Where the trees of a saved regression model are."""
    return f"{path}/stages/1_{model.stages[1].uid}"


def trained(spark, sf_dir, name: str):
    """(model, scored test rows, metrics dict) for 'gini', 'mobility' or 'income_group'."""
    key = _key(spark, sf_dir, name)
    if key in _MODELS:
        return _MODELS[key]
    at = _key(spark, sf_dir, "features")
    if at not in _FEATURES:
        _FEATURES[at] = feature_table(spark, sf_dir).persist()
    ft = _FEATURES[at]
    train = ft.filter(F.col("side") == "train")
    test = ft.filter(F.col("side") == "test")
    path = scratch_path(spark, f"model-{name}")
    if name == "income_group":
        model = fit_classifier(train, FEATURES, "income_group", MODEL_INCOME_GROUP)
        scored = score_classes(model, test.filter(F.col("income_group").isNotNull()), "income_group")
        m = class_metrics(scored, "income_group", "predicted_label").first().asDict()
        model.write().overwrite().save(path)  # S12
    else:
        label = "gini_index" if name == "gini" else "acctbal"
        kind, params = ("gbt", MODEL_GINI) if name == "gini" else ("rf", MODEL_MOBILITY)
        model = fit_regressor(train, FEATURES, label, kind, params)
        model.write().overwrite().save(path)  # S12
        points = model_points(spark, stage_dir(model, path), len(FEATURES)) if test.count() >= LARGE_ROWS else None
        pre = predicted(model, test, points)
        m = regression_metrics(pre.filter(F.col(label).isNotNull()), label, "prediction").first().asDict()
        scored = score_regression(model, test, m.get("residual_std"), scored=pre)
    _MODELS[key] = (model, scored, m, path)
    return _MODELS[key]


@query("gbt_regress")
def q_gbt_regress(spark, sf_dir):
    _, scored, _, _ = trained(spark, sf_dir, "gini")
    return rounded(scored.select(R.entity, R.time, "prediction", "interval_lo", "interval_hi"))


@query("rf_regress")
def q_rf_regress(spark, sf_dir):
    _, scored, _, _ = trained(spark, sf_dir, "mobility")
    return rounded(scored.select(R.entity, R.time, "prediction", "interval_lo", "interval_hi"))


@query("rf_classify")
def q_rf_classify(spark, sf_dir):
    from ..operators.views import sorted_probabilities

    model, scored, _, _ = trained(spark, sf_dir, "income_group")
    labels = class_labels(model)
    pairs = sorted_probabilities("_classes", "probability_array")
    out = scored.withColumn("_classes", F.array(*[F.lit(c) for c in labels])).withColumn("_ranked", pairs)
    return rounded(
        out.select(
            R.entity,
            R.time,
            "predicted_label",
            F.element_at("_ranked", 1)["p"].alias("top_probability"),
            F.aggregate("probability_array", F.lit(0.0), lambda a, x: a + x).alias("probability_sum"),
        )
    )


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    rows = []
    for name in ("gini", "mobility", "income_group"):
        _, _, m, _ = trained(spark, sf_dir, name)
        for k, v in m.items():
            if k in ("r2", "mae", "residual_std", "n_test", "accuracy", "macro_f1"):
                rows.append((name, k, None if v is None else float(v)))
    return spark.createDataFrame(rows, "target string, metric string, value double")


@query("attribution_topn")
def q_attribution_topn(spark, sf_dir):
    model, scored, _, path = trained(spark, sf_dir, "gini")
    paths, base = load_paths(spark, stage_dir(model, path), "gbt")
    out = contributions(scored, FEATURES, paths, base, keep=[R.entity, R.time, "prediction"])
    return out.select(
        R.entity,
        R.time,
        F.round(F.col("prediction"), 4).alias("prediction"),
        F.round(F.col("base_value"), 4).alias("base_value"),
        "contributions",
        F.round(F.col("base_value") + F.col("contribution_sum") - F.col("prediction"), 6).alias("additivity_gap"),
    )
