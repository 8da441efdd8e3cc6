"""Count-window drift reports on the scored-rows stream.

Every ``size`` scored rows (in arrival order: ts, then id) make one drift
report against the reference table.  ``foreachBatch`` per micro-batch:

1. read the kept remainder of the previous batch (the buffer) and add the
   batch;
2. number the rows densely in arrival order (``ordering.dense_index``:
   range-partitioned on the order, no single-partition window, a batch
   inside one hour spreads over all tasks) and cut them into blocks of
   ``size``;
3. one PSI job for all full blocks at once (``drift.psi_grouped``) appends
   the report rows;
4. only then the remainder is written as the new buffer (F15: no row is
   lost when the report fails).

Writes go to per-epoch folders, so a replayed epoch overwrites its own
output and the job survives lost executors and restarts.  The reference is
re-read per micro-batch, so a retrained feature table is picked up (D6).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import psi_grouped, reference_profile
from ..operators.ordering import dense_index
from ..params import DATASET_DRIFT_SHARE, DRIFT_REFERENCE_MIN_ROWS
from ..session import scratch_path


def _latest_epoch_dir(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Rows of the newest epoch folder (older than ``before``: a replayed epoch ignores its own output)."""
    try:
        t = spark.read.parquet(root)
    except AnalysisException as exc:
        # no buffer written yet; any other failure stops the batch, so that no row is lost
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if before is not None:
        t = t.filter(F.col("epoch") < F.lit(before))
    newest = t.agg(F.max("epoch")).first()[0]
    if newest is None:
        return None
    return t.filter(F.col("epoch") == F.lit(newest)).drop("epoch")


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "profile")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drift_batch_writer(
    reference: Callable[[], DataFrame],
    numeric: Sequence[str],
    categorical: Sequence[str],
    order: Sequence[str],
    reports_path: str,
    buffer_path: str,
    size: int = DRIFT_REFERENCE_MIN_ROWS,
):
    """The ``foreachBatch`` function of the count-window drift stream.

    ``order`` is the arrival order (timestamp, then a unique id); rows are
    numbered over ranges of it (see ``ordering.dense_index``).  The
    reference profile (bin edges and shares, small) is computed once and
    recomputed only when the reference table's files change (D6: a
    retrained feature table is picked up without re-binning it per batch).
    """
    cache: dict = {}

    def profile():
        ref = reference()
        version = hash(frozenset(ref.inputFiles()))
        if cache.get("version") != version:
            ranges, shares = reference_profile(ref, numeric, categorical)
            # one row per feature, and one per bin or category: written once
            cache["profile"] = tuple(_written(t) for t in (ranges, shares))
            cache["version"] = version
        return cache["profile"]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cols = list(dict.fromkeys([*order, *numeric, *categorical]))
        rows = batch.select(*cols)
        prev = _latest_epoch_dir(spark, buffer_path, before=epoch)
        n_reports_before = 0
        if prev is not None:
            meta = prev.agg(F.max("_reports_before")).first()[0]
            n_reports_before = int(meta or 0)
            rows = prev.select(*cols).unionByName(rows)
        numbered = dense_index(rows, order, "seq").withColumn("block", F.floor(F.col("seq") / F.lit(size)).cast("long"))
        numbered = numbered.persist()
        try:
            total = numbered.count()
            n_full = total // size
            full = numbered.filter(F.col("block") < F.lit(n_full))
            if n_full > 0:
                per = psi_grouped(None, full, "block", numeric, categorical, profile=profile())
                rep = per.groupBy("block").agg(
                    F.count(F.lit(1)).cast("int").alias("n_columns"),
                    F.sum(F.col("drifted").cast("int")).cast("int").alias("n_drifted"),
                    F.avg(F.col("drifted").cast("double")).alias("share_of_drifted_columns"),
                )
                rep = rep.select(
                    (F.col("block") + F.lit(n_reports_before)).alias("report_no"),
                    F.lit(size).cast("int").alias("n_rows"),
                    "n_columns",
                    "n_drifted",
                    "share_of_drifted_columns",
                    (F.col("share_of_drifted_columns") >= F.lit(DATASET_DRIFT_SHARE)).alias("dataset_drift"),
                )
                rep.write.mode("overwrite").parquet(f"{reports_path}/epoch={epoch}")
            rest = numbered.filter(F.col("block") >= F.lit(n_full)).select(*cols)
            rest.withColumn("_reports_before", F.lit(n_reports_before + n_full)).write.mode("overwrite").parquet(
                f"{buffer_path}/epoch={epoch}"
            )
        finally:
            numbered.unpersist()

    return write


def run_drift_stream(
    stream: DataFrame,
    reference: Callable[[], DataFrame],
    numeric: Sequence[str],
    categorical: Sequence[str],
    order: Sequence[str],
    root: str,
    size: int = DRIFT_REFERENCE_MIN_ROWS,
) -> DataFrame:
    """Runs the stream over what is available and returns the report table."""
    spark = stream.sparkSession
    writer = drift_batch_writer(reference, numeric, categorical, order, f"{root}/reports", f"{root}/buffer", size)
    q = (
        stream.writeStream.foreachBatch(writer)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    try:
        return spark.read.parquet(f"{root}/reports").drop("epoch")
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        # fewer rows than one report
        return spark.createDataFrame(
            [],
            "report_no long, n_rows int, n_columns int, n_drifted int, share_of_drifted_columns double, dataset_drift boolean",
        )


def buffered_rows(spark: SparkSession, root: str) -> int:
    """Rows kept for the next report (the remainder)."""
    prev = _latest_epoch_dir(spark, f"{root}/buffer")
    return 0 if prev is None else prev.count()
