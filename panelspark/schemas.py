"""Explicit schemas and column-role parameters.

Every operator takes column names, so one long observation table of any
origin (statistical sources, the driver's TPC-H-like tables, a stream) runs
through the same code.  ``Roles`` carries those names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Column names of a long observation table and of the panel built from it."""

    entity: str = "entity"
    entity_name: str = "entity_name"
    time: str = "time"
    indicator: str = "indicator"
    value: str = "value"
    source: str = "source"

    @property
    def long_columns(self) -> list[str]:
        return [self.entity, self.entity_name, self.time, self.indicator, self.value, self.source]


DEFAULT_ROLES = Roles()


def long_schema(entity_type: T.DataType = T.StringType(), roles: Roles = DEFAULT_ROLES) -> T.StructType:
    """Long observation: entity, entity_name, time, indicator, value, source."""
    return T.StructType(
        [
            T.StructField(roles.entity, entity_type, True),
            T.StructField(roles.entity_name, T.StringType(), True),
            T.StructField(roles.time, T.IntegerType(), True),
            T.StructField(roles.indicator, T.StringType(), True),
            T.StructField(roles.value, T.DoubleType(), True),
            T.StructField(roles.source, T.StringType(), True),
        ]
    )


LONG = long_schema()

# Entity dimension snapshot (one row per entity).
ENTITY_DIM = T.StructType(
    [
        T.StructField("entity", T.StringType(), True),
        T.StructField("entity_name", T.StringType(), True),
        T.StructField("income_group", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
    ]
)

# Static per-entity measures (cohort file, latest cohort kept).
STATIC_MEASURES = T.StructType(
    [
        T.StructField("entity", T.StringType(), True),
        T.StructField("entity_name", T.StringType(), True),
        T.StructField("intergen_income_elasticity", T.DoubleType(), True),
        T.StructField("intergen_rank_correlation", T.DoubleType(), True),
    ]
)

# Code map: source code -> entity key (J5); overrides are a second table of the same shape.
CODE_MAP = T.StructType(
    [
        T.StructField("code", T.StringType(), True),
        T.StructField("entity", T.StringType(), True),
    ]
)

CATEGORY_MAP = T.StructType(
    [
        T.StructField("feature", T.StringType(), False),
        T.StructField("category", T.StringType(), True),
        T.StructField("code", T.IntegerType(), False),
    ]
)

MEDIAN_MAP = T.StructType(
    [
        T.StructField("feature", T.StringType(), False),
        T.StructField("median", T.DoubleType(), False),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("target", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("metric", T.StringType(), False),
        T.StructField("value", T.DoubleType(), True),
    ]
)

GATES = T.StructType(
    [
        T.StructField("target", T.StringType(), False),
        T.StructField("metric", T.StringType(), False),
        T.StructField("min", T.DoubleType(), False),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("target", T.StringType(), False),
        T.StructField("registered_name", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("stage", T.StringType(), False),
        T.StructField("metric", T.StringType(), True),
        T.StructField("metric_value", T.DoubleType(), True),
        T.StructField("gate_min", T.DoubleType(), True),
        T.StructField("passed", T.BooleanType(), False),
    ]
)

DRIFT_REPORT = T.StructType(
    [
        T.StructField("report_ts", T.TimestampType(), False),
        T.StructField("report_name", T.StringType(), False),
        T.StructField("n_current", T.LongType(), False),
        T.StructField("n_columns", T.IntegerType(), False),
        T.StructField("n_drifted", T.IntegerType(), False),
        T.StructField("share_of_drifted_columns", T.DoubleType(), True),
        T.StructField("dataset_drift", T.BooleanType(), False),
    ]
)


RUN_REPORT = T.StructType(
    [
        T.StructField("step", T.StringType(), False),
        T.StructField("reason", T.StringType(), False),
        T.StructField("key", T.StringType(), True),
        T.StructField("n", T.LongType(), False),
    ]
)
