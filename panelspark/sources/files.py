"""Delimited and JSON file sources.

The separator of a delimited file is found from its own header line (a folder
may mix them), headers are trimmed and lower-cased.
The text ``NA`` stays a value (Spark's CSV reader has no NA list unless
one is given); numeric columns are coerced with ``try_cast`` afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_header


def sniff_separators(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by separator: ';' if the file's header line has one, else ','.

    The header is the first row of the split that starts at byte 0 of the
    file.  One row per file comes back (the driver lists the files anyway).
    """
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("n"), "value"
    )
    first = lines.filter(F.col("at") == 0).groupBy("file").agg(F.min_by("value", "n").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        out.setdefault(";" if ";" in r["header"] else ",", []).append(r["file"])
    return out


def read_delimited(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Delimited scan with sniffed separator; headers trimmed and lower-cased.

    All columns are read as text (no inference pass); an unexpected shape
    (a required column missing) gives an empty frame with the found columns.
    """
    parts = []
    for sep, files in sniff_separators(spark, path).items():
        df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(files)
        parts.append(df.toDF(*[clean_header(c) for c in df.columns]))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in required) or "value string")
    df = parts[0]
    for other in parts[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    if required and not set(required) <= set(df.columns):
        return df.limit(0)
    return df


def read_cohorts(spark: SparkSession, path: str, column_map: dict[str, str]) -> DataFrame:
    """Cohort CSV; missing required columns raise; columns renamed by the map."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = set(column_map) - set(df.columns)
    if missing:
        raise ValueError(f"cohort file lacks the expected columns {sorted(missing)} (found {df.columns})")
    return df.withColumnsRenamed(column_map)


def pooled(df: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Keep pooled rows (parent 'avg', child 'all') when both columns exist."""
    if parent in df.columns and child in df.columns:
        return df.filter((F.col(parent) == "avg") & (F.col(child) == "all"))
    return df


ENTITY_META_TYPE = "id STRING, name STRING, incomeLevel STRUCT<value: STRING>, region STRUCT<value: STRING>"


def read_entity_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Entity metadata (one JSON object per line): drop rows without id and
    rows whose group is null or 'Aggregates'."""
    raw = spark.read.schema(ENTITY_META_TYPE).json(path)
    return raw.filter(
        F.col("id").isNotNull()
        & (F.col("id") != "")
        & F.col("incomeLevel.value").isNotNull()
        & (F.col("incomeLevel.value") != "Aggregates")
    ).select(
        F.col("id").alias("entity"),
        F.col("name").alias("entity_name"),
        F.col("incomeLevel.value").alias("income_group"),
        F.col("region.value").alias("region"),
    )
