"""Training artifacts read back by scoring (S11) and the scoring front (M6: C5 + J7).

The category map (feature, category, code) and the median map (feature,
median) are small parquet tables written next to the feature table; the
scoring job reads them back and joins / inlines them.  Medians are one row
per feature (inlined as literals); category maps go through ``encode``,
which leaves the broadcast decision to the measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import impute_scoring
from ..operators.features import encode


def write_artifacts(maps: DataFrame, medians: DataFrame, path: str) -> None:
    maps.write.mode("overwrite").parquet(f"{path}/categorical_mappings")
    medians.write.mode("overwrite").parquet(f"{path}/feature_medians")


def read_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict[str, float]]:
    """(category map or None, medians dict); absent artifacts -> unseen codes (-1) and 0.0 fallbacks."""
    maps = _if_present(spark, f"{path}/categorical_mappings")
    medians = _if_present(spark, f"{path}/feature_medians")
    # one row per feature
    return maps, {} if medians is None else {r["feature"]: r["median"] for r in medians.collect()}


def _if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none; a damaged one raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def prepare_scoring(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    maps: DataFrame | None,
    medians: dict[str, float],
) -> DataFrame:
    """C5 + C4 + J7: omitted numerics -> stored median else 0.0; categories -> codes, unseen -> -1."""
    out = df
    for c in numeric:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
        med = F.lit(medians[c]) if c in medians else None
        out = out.withColumn(c, impute_scoring(c, med))
    for c in categorical:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    if maps is None:
        for c in categorical:
            out = out.withColumn(f"{c}_code", F.lit(-1))
        return out
    return encode(out, maps, categorical, scoring=True)
