"""Code mapping with override precedence (J5) and the dropped-code report.

``coalesce(override, standard)`` over two left joins; rows no map covers
are dropped and reported per code with their row count (left anti join).
Code maps are lists of country-like codes; each side is broadcast only
after a bounded count proves it small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import assert_unique, small_side

def map_codes(
    df: DataFrame,
    code: str,
    standard: DataFrame,
    overrides: DataFrame | None = None,
    out: str = "entity",
) -> tuple[DataFrame, DataFrame]:
    """Returns (mapped rows with ``out``, dropped codes with ``n_rows``).

    ``standard`` and ``overrides`` have columns (code, entity); overrides win.
    A code listed twice in one of them raises (it would double the rows).
    """
    assert_unique(standard, ["code"], "code map")
    std = small_side(standard.select(F.col("code").alias("_c_std"), F.col("entity").alias("_e_std")))
    j = df.join(std, F.col(code) == F.col("_c_std"), "left")
    if overrides is not None:
        assert_unique(overrides, ["code"], "code overrides")
        ovr = small_side(overrides.select(F.col("code").alias("_c_ovr"), F.col("entity").alias("_e_ovr")))
        j = j.join(ovr, F.col(code) == F.col("_c_ovr"), "left")
        mapped_col = F.coalesce(F.col("_e_ovr"), F.col("_e_std"))
    else:
        mapped_col = F.col("_e_std")
    j = j.withColumn(out, mapped_col).drop("_c_std", "_e_std", "_c_ovr", "_e_ovr")
    mapped = j.filter(F.col(out).isNotNull())
    dropped = j.filter(F.col(out).isNull()).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n_rows"))
    return mapped, dropped


def map_codes_dict(df: DataFrame, code: str, standard: dict[str, str], overrides: dict[str, str] | None = None, out: str = "entity"):
    """Same with fixed dictionaries (e.g. the source's non-ISO codes) as literal maps."""
    spark = df.sparkSession
    std = spark.createDataFrame(list(standard.items()), "code string, entity string")
    ovr = spark.createDataFrame(list((overrides or {}).items()), "code string, entity string") if overrides else None
    return map_codes(df, code, std, ovr, out)
