"""Model evaluation as aggregates.

Regression metrics are one aggregate per group (population residual std,
ddof 0).  Class metrics go through a confusion table ``groupBy(y, p)``
whose size is bounded by classes^2; macro F1 is the unweighted mean of the
per-class F1 (Spark ML's evaluator ``f1`` is the weighted one).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import MIN_TARGET_ROWS


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Mae, r2, residual_std (population), n per group, in one aggregate.

    ``r2 = 1 - SSE / SST`` with ``SST = n * var_pop(y)``; Spark's variance
    merges partial moments stably, so no second pass or join-back of the
    mean is needed (map-side partial aggregation, one shuffle on the groups).
    """
    e = F.col(y) - F.col(p)
    agg = (
        df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
        .groupBy(*by)
        .agg(
            F.avg(F.abs(e)).alias("mae"),
            F.sum(e * e).alias("_sse"),
            F.var_pop(F.col(y)).alias("_vy"),
            F.stddev_pop(e).alias("residual_std"),
            F.count(F.lit(1)).alias("n_test"),
        )
    )
    sst = F.col("_vy") * F.col("n_test")
    return agg.select(
        *by,
        "mae",
        F.when(sst > 0, F.lit(1.0) - F.col("_sse") / sst).alias("r2"),
        "residual_std",
        "n_test",
    )


def support_check(df: DataFrame, target: str, min_rows: int = MIN_TARGET_ROWS) -> DataFrame:
    """Non-null target rows and whether they reach the warning threshold."""
    return df.agg(F.count(F.col(target)).alias("n_target")).withColumn(
        "support_ok", F.col("n_target") >= F.lit(min_rows)
    )


def confusion(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion table (y, p, count): at most classes^2 rows per group."""
    return df.filter(F.col(y).isNotNull()).groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).count()


def _per_class(cm: DataFrame, by: Sequence[str]) -> DataFrame:
    """tp / support / n_pred per class from the confusion table in one aggregation.

    Each confusion cell credits its true class (support, tp on the diagonal)
    and its predicted class (n_pred): an explode into two rows, no self-join.
    """
    n = F.col("count")
    credits = F.array(
        F.struct(
            F.col("y").alias("cls"),
            F.when(F.col("y") == F.col("p"), n).otherwise(F.lit(0)).alias("tp"),
            n.alias("support"),
            F.lit(0).cast("long").alias("n_pred"),
        ),
        F.struct(
            F.col("p").alias("cls"),
            F.lit(0).cast("long").alias("tp"),
            F.lit(0).cast("long").alias("support"),
            n.alias("n_pred"),
        ),
    )
    return (
        cm.select(*by, F.explode(credits).alias("c"))
        .filter(F.col("c.cls").isNotNull())
        .groupBy(*by, F.col("c.cls").alias("cls"))
        .agg(F.sum("c.tp").alias("tp"), F.sum("c.support").alias("support"), F.sum("c.n_pred").alias("n_pred"))
    )


def _scores(t: DataFrame) -> DataFrame:
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(
        (F.col("precision") + F.col("recall")) > 0,
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(F.lit(0.0))
    return t.withColumn("f1", f1)


def class_report(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, F1, support (zero division -> 0.0)."""
    by = list(by)
    t = _scores(_per_class(confusion(df, y, p, by), by))
    return t.select(*by, "cls", "precision", "recall", "f1", F.col("support").cast("long"))


def class_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """A10: accuracy and macro F1 (unweighted over classes seen in y or p), n_test.

    All from the confusion table: accuracy = sum(tp) / sum(support).
    """
    by = list(by)
    t = _scores(_per_class(confusion(df, y, p, by), by))
    return t.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").cast("long").alias("n_test"),
    )
