"""Tree models on the feature table.

Spark ML estimators: boosted trees and forests are trained with
distributed histogram aggregation over the partitions of the feature
table; scoring is ``PipelineModel.transform`` on a batch or a stream.
The forests keep the node that every row has reached in every tree (``cacheNodeIds``), so that a level does not
walk all trees from their roots again; the trees are the same.  From ``forests.LARGE_ROWS`` rows on the same ensembles are trained
over cells of equal bins (``forests``) and become Spark ML models.
Boosted multi-class trees are not in Spark ML (``GBTClassifier`` is binary
only), so the income-group model is a random forest classifier.  XGBoost's
L2 leaf penalty has no Spark ML counterpart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import interval_bounds
from ..params import INTERVAL_Z, MODEL_GINI, MODEL_INCOME_GROUP, MODEL_MOBILITY, RANDOM_SEED
from . import forests
from .joins import lookup


def label_indexer(column: str, out: str) -> StringIndexer:
    """Alphabetical label codes (label-encoder order)."""
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")


def assembler(features: Sequence[str]) -> VectorAssembler:
    """P10: features in configured order; nulls reach the trees as NaN (keep)."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def gbt_regressor(label: str, params: Mapping = MODEL_GINI, seed: int = RANDOM_SEED) -> GBTRegressor:
    """M2: boosted regression trees (rounds, depth, rate, row and column sampling)."""
    return GBTRegressor(
        featuresCol="features",
        labelCol=label,
        maxIter=int(params["n_estimators"]),
        maxDepth=int(params["max_depth"]),
        stepSize=float(params["learning_rate"]),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(params.get("colsample_bytree", "all")),
        seed=seed,
    )


def rf_regressor(label: str, params: Mapping = MODEL_MOBILITY, seed: int = RANDOM_SEED) -> RandomForestRegressor:
    """M3 / M4: random forest regression (trees, depth, minimum leaf size)."""
    return RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=int(params["n_estimators"]),
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        cacheNodeIds=True,
        seed=seed,
    )


def rf_classifier(label: str, params: Mapping = MODEL_INCOME_GROUP, seed: int = RANDOM_SEED) -> RandomForestClassifier:
    """M5: multi-class trees with a probability vector."""
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        numTrees=int(params["n_estimators"]),
        maxDepth=int(params["max_depth"]),
        subsamplingRate=float(params.get("subsample", 1.0)),
        cacheNodeIds=True,
        seed=seed,
    )


def _fitted(est, rows: DataFrame, features: Sequence[str], before: Sequence = (), after: Sequence = (), classes: int = 0) -> PipelineModel:
    """The pipeline of assembler and trees between fitted stages."""
    n = rows.count()
    if n >= forests.LARGE_ROWS:
        model = forests.train(est, PipelineModel(list(before)).transform(rows), features, classes, n)
        if model is not None:
            return PipelineModel([*before, assembler(features), model, *after])
    return Pipeline(stages=[*before, assembler(features), est, *after]).fit(rows)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", params: Mapping | None = None) -> PipelineModel:
    est = gbt_regressor(label, params or MODEL_GINI) if kind == "gbt" else rf_regressor(label, params or MODEL_MOBILITY)
    return _fitted(est, train.filter(F.col(label).isNotNull()), features)


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None) -> PipelineModel:
    """Label codes (A8) -> forest -> class names back (``predicted_label``)."""
    rows = train.filter(F.col(label).isNotNull())
    idx = label_indexer(label, "_label_idx").fit(rows)
    rf = rf_classifier("_label_idx", params or MODEL_INCOME_GROUP)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=idx.labels)
    return _fitted(rf, rows, features, [idx], [back], len(idx.labels))


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predicted(model: PipelineModel, df: DataFrame, points: Sequence[np.ndarray] | None = None) -> DataFrame:
    """``model.transform(df)`` of a regression model of assembler and trees.

    With the thresholds of its trees (``forests.model_points``), rows between the same thresholds, which all trees send to the
    same leaves, are scored once and look their prediction up.
    """
    if points is None or not forests.countable(points):
        return model.transform(df)
    features, out = model.stages[0].getInputCols(), model.stages[1].getPredictionCol()
    keyed = forests.with_cell(df, features, points)
    one = keyed.groupBy("_cell").agg(*[F.min(c).alias(c) for c in features])
    dealt = one.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "_cell")
    scored = lookup(keyed, model.transform(dealt).select("_cell", out), ["_cell"], "left")
    return model.stages[0].transform(scored).select(*model.transform(df).columns)


def score_regression(
    model: PipelineModel, df: DataFrame, residual_std: float | None, z: float = INTERVAL_Z, scored: DataFrame | None = None
) -> DataFrame:
    """M6 + C6: prediction and the 80 % interval (null without a residual std); ``scored``: ``predicted(model, df)`` if it is there."""
    out = model.transform(df) if scored is None else scored
    s = F.lit(residual_std).cast("double")
    lo, hi = interval_bounds("prediction", s, z)
    return out.withColumn("interval_lo", F.when(s.isNotNull(), lo)).withColumn("interval_hi", F.when(s.isNotNull(), hi))


def score_classes(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """M6 + C7 + K3: predicted label and the class -> probability map.

    The classifier's first stage indexes the training label; scoring rows need
    no label, so only the later stages run.
    """
    labels = class_labels(model)
    scored = PipelineModel(stages=model.stages[1:]).transform(df)
    probs = vector_to_array(F.col("probability"))
    return scored.withColumn(
        "probabilities", F.map_from_arrays(F.array(*[F.lit(c) for c in labels]), probs)
    ).withColumn("probability_array", probs)


def save_model(model: PipelineModel, path: str) -> None:
    """Model sink (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
