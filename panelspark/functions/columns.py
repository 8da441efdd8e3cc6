"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def to_number(c: str | Column) -> Column:
    """Numeric coercion, bad text and NaN -> null (``try_cast`` so ANSI mode does not raise)."""
    col = F.col(c) if isinstance(c, str) else c
    return clean_double(col.try_cast("double"))


def clean_double(c: str | Column) -> Column:
    """NaN is no value: null."""
    col = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(col), col)


def to_int(c: str | Column) -> Column:
    """Whole numbers, also written as ``2021.0``; anything else -> null."""
    col = F.col(c) if isinstance(c, str) else c
    number = col.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def priority_coalesce(columns: Sequence[str]) -> Column:
    """First non-null value across the columns in priority order."""
    if not columns:
        return F.lit(None).cast("double")
    return F.coalesce(*[F.col(c) for c in columns])


def provenance(columns: Sequence[str]) -> Column:
    """Name of the first non-null column (the column name, not a source name)."""
    expr = F.lit(None).cast("string")
    for c in reversed(list(columns)):
        expr = F.when(F.col(c).isNotNull(), F.lit(c)).otherwise(expr)
    return expr


def category_for_training(c: str) -> Column:
    """C4 (training side): null -> UNKNOWN; empty text stays its own category."""
    return F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))


def category_for_scoring(c: str) -> Column:
    """C4 (scoring side): null or empty -> UNKNOWN."""
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(UNKNOWN))


def impute_scoring(c: str, median: Column | None) -> Column:
    """Omitted numeric -> stored median, else 0.0."""
    parts = [F.col(c).cast("double")]
    if median is not None:
        parts.append(median)
    parts.append(F.lit(0.0))
    return F.coalesce(*parts)


def interval(pred: str | Column, residual_std: str | Column, z: float = 1.28) -> Column:
    """``[p - z*s, p + z*s]``; null without a residual std."""
    p = F.col(pred) if isinstance(pred, str) else pred
    s = F.col(residual_std) if isinstance(residual_std, str) else residual_std
    return F.when(s.isNotNull(), F.array(p - F.lit(z) * s, p + F.lit(z) * s))


def interval_bounds(pred: str | Column, residual_std: str | Column, z: float = 1.28) -> tuple[Column, Column]:
    p = F.col(pred) if isinstance(pred, str) else pred
    s = F.col(residual_std) if isinstance(residual_std, str) else residual_std
    return p - F.lit(z) * s, p + F.lit(z) * s


def report_stamp(ts: str | Column) -> Column:
    """Timestamp to ``yyyymmddThhmmssZ`` (session time zone is UTC in jobs)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(col, "yyyyMMdd'T'HHmmss'Z'")


def ntz_literal(value) -> Column:
    """A naive datetime (as Spark returns TIMESTAMP_NTZ) back as a TIMESTAMP_NTZ literal.

    Goes through text, so neither the Python process's zone nor the session
    zone can shift it.
    """
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def gate_passed(metric_value: str | Column, gate_min: str | Column) -> Column:
    """Gate present, metric present and metric >= min; null or NaN anywhere -> False."""
    v = F.col(metric_value) if isinstance(metric_value, str) else metric_value
    m = F.col(gate_min) if isinstance(gate_min, str) else gate_min
    return F.coalesce(clean_double(v) >= clean_double(m), F.lit(False))


def gate_stage(passed: str | Column) -> Column:
    p = F.col(passed) if isinstance(passed, str) else passed
    return F.when(p, F.lit("Production")).otherwise(F.lit("Staging"))


def clean_header(name: str) -> str:
    """C8 for schema names: headers trimmed and lower-cased."""
    return name.strip().lower()
