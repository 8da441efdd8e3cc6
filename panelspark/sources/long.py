"""Long-table and panel sources and sinks.

Landed tables are parquet; the long sink partitions by source, the panel
and feature sinks by time, so later readers prune partitions by the filter
they push down.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULT_ROLES, LONG, Roles
from ..session import scratch_path

log = logging.getLogger("panelspark.sources")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_long(spark: SparkSession, path: str, schema: T.StructType = LONG, fmt: str = "parquet") -> DataFrame:
    """Long-table scan with an explicit schema; an absent source is an
    empty table with the long schema (and a warning), not an error."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            log.warning("%s not found, continuing without it", path)
            return empty(spark, schema)
        raise


def first_existing(spark: SparkSession, paths: Sequence[str], reader: Callable[[str], DataFrame], schema: T.StructType) -> DataFrame:
    """The first readable path wins (manual override before the default
    source); if none can be read, an empty table with the output schema."""
    for p in paths:
        try:
            df = reader(p)
            df.schema  # noqa: B018 - resolves the path now
            return df
        except AnalysisException:
            log.warning("source %s not readable, trying the next one", p)
    return empty(spark, schema)


def best_effort(spark: SparkSession, reader: Callable[[], DataFrame], schema: T.StructType = LONG) -> tuple[DataFrame, str]:
    """Any failure of a source, also while it is read, becomes an empty long table
    plus a status.  The rows are landed here, so that reading them later cannot fail."""
    try:
        df = reader()
        path = scratch_path(spark, "landed")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), "ok"
    except Exception as exc:  # noqa: BLE001 - a failing source must not stop the run
        log.warning("source failed, writing an empty table: %s", exc)
        return empty(spark, schema), f"failed: {type(exc).__name__}"


def check_long(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """S9 (validation part): missing column raises; columns in long order; null values dropped."""
    missing = set(roles.long_columns) - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns {sorted(missing)}")
    return df.select(*roles.long_columns).dropna(subset=[roles.value])


def write_long(df: DataFrame, path: str, roles: Roles = DEFAULT_ROLES, mode: str = "overwrite") -> None:
    """Long sink, partitioned by source."""
    check_long(df, roles).write.mode(mode).partitionBy(roles.source).parquet(path)


def write_panel(df: DataFrame, path: str, time: str = "time", entity: str = "entity", mode: str = "overwrite") -> None:
    """Panel / feature sink, partitioned by time, rows sorted by (time, entity) inside each file (K1).

    Hash on (time, entity), not on time alone: a year is spread over all
    tasks instead of landing in one, and each task writes one sorted file
    per year it holds.
    """
    out = df.repartition(time, entity) if entity in df.columns else df
    sort_cols = [time, entity] if entity in df.columns else [time]
    out.sortWithinPartitions(*sort_cols).write.mode(mode).partitionBy(time).parquet(path)


def append_metrics(spark: SparkSession, rows: Sequence[tuple], path: str) -> None:
    """Append metric rows (target, version, metric, value) to the metrics table."""
    from ..schemas import METRICS

    spark.createDataFrame(list(rows), METRICS).write.mode("append").parquet(path)


def with_status(df: DataFrame, status: str) -> DataFrame:
    return df.withColumn("_source_status", F.lit(status))
