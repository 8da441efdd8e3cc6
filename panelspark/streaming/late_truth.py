"""J1 and A9 on streams: predictions meet the truth that arrives later, or never.

Both streams carry a watermark; a prediction waits ``wait`` for a label of its key, a label that comes
earlier than its prediction, later than that or without one stays alone.  Full outer: what no row of the other side can reach any
more, as the watermark tells, leaves the state as a row with nulls, so state is bounded by the wait and the watermark.
The joined rows feed moments (counts and sums) that merge by adding: metrics of any set of days or
targets come from theirs, without rereading rows.

Rows of a null key, and of a null time, take no part; a prediction with several labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rates import WATERMARK

MOMENTS = ("n", "n_waiting", "n_orphans", "sum_abs", "sum_e", "sum_e2", "sum_y", "sum_y2")


def _timed(df: DataFrame, key: str, ts: str) -> DataFrame:
    kept = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return kept.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, WATERMARK)


def join_truth(
    predictions: DataFrame, labels: DataFrame, key: str, prediction_ts: str, label_ts: str, wait: str = "10 minutes"
) -> DataFrame:
    """Full outer join on ``key`` (named differently on the two sides or not) and ``prediction_ts <= label_ts <= prediction_ts + wait``;
    the label's key is ``label_<key>``."""
    p, y = _timed(predictions, key, prediction_ts), _timed(labels, key, label_ts).withColumnRenamed(key, f"label_{key}")
    near = (F.col(label_ts) >= F.col(prediction_ts)) & (F.col(label_ts) <= F.col(prediction_ts) + F.expr(f"INTERVAL {wait}"))
    return p.join(y, (F.col(key) == F.col(f"label_{key}")) & near, "full_outer")


def moments(joined: DataFrame, by: Sequence[str | Column], prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Per group: matched rows (n), predictions without truth, labels without a prediction, and sums of the errors and labels."""
    p, y = F.col(prediction), F.col(label)
    both, e = p.isNotNull() & y.isNotNull(), p - y
    zero = F.lit(0.0)
    return joined.groupBy(*by).agg(
        F.count_if(both).alias("n"),
        F.count_if(p.isNotNull() & y.isNull()).alias("n_waiting"),
        F.count_if(p.isNull() & y.isNotNull()).alias("n_orphans"),
        *[F.coalesce(F.sum(F.when(both, x)), zero).alias(name) for name, x in (("sum_abs", F.abs(e)), ("sum_e", e), ("sum_e2", e * e), ("sum_y", y), ("sum_y2", y * y))],
    )


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of larger groups from those of smaller ones."""
    return parts.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def metrics(parts: DataFrame) -> DataFrame:
    """Adds mae, r2 and residual_std (population) to moments; null without matched rows, r2 also without spread."""
    n = F.col("n")
    spread = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / n
    variance = F.col("sum_e2") / n - (F.col("sum_e") / n) * (F.col("sum_e") / n)
    any_row = n > 0
    return (
        parts.withColumn("mae", F.when(any_row, F.col("sum_abs") / n))
        .withColumn("r2", F.when(any_row, F.when(spread > 0, 1 - F.col("sum_e2") / spread)))
        .withColumn("residual_std", F.when(any_row, F.sqrt(F.greatest(variance, F.lit(0.0)))))
    )
