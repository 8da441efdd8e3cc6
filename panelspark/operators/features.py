"""Panel -> feature table: time range, coverage, missing columns, two-level
median impute, category encoding, persisted medians and category maps.

Shuffle plan: after the pivot the panel holds one row per entity and time,
so every per-entity step (coverage count, entity medians, row lag) is a
window over ``partitionBy(entity)`` whose partitions are bounded by the
number of distinct times.  All those windows share one exchange on the
entity.  Global medians go through ``quantiles.exact_medians``, which keeps
memory bounded per task (no value map of a whole column in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import UNKNOWN, category_for_scoring, category_for_training, clean_double
from ..schemas import DEFAULT_ROLES, MEDIAN_MAP, Roles
from ..session import scratch_path
from .joins import lookup
from .ordering import dense_index
from .quantiles import exact_medians


def time_range(panel: DataFrame, start: int, end: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Inclusive time range (pushed to the scan / pruned on a time-partitioned table)."""
    return panel.filter(F.col(roles.time).between(start, end))


def coverage_filter(panel: DataFrame, min_times: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A2 + J6: keep entities with at least ``min_times`` distinct times.

    A window count over the entity (bounded partitions) instead of an
    aggregate + semi join: one exchange, shared with later entity windows.
    """
    w = Window.partitionBy(roles.entity)
    return (
        panel.withColumn("_n_times", F.size(F.collect_set(F.col(roles.time)).over(w)))
        .filter(F.col("_n_times") >= min_times)
        .drop("_n_times")
    )


def dropped_entities(panel: DataFrame, min_times: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Entities removed by the coverage test, with their count of times."""
    return (
        panel.groupBy(roles.entity)
        .agg(F.count_distinct(roles.time).alias("n_times"))
        .filter(F.col("n_times") < min_times)
    )


def add_missing_columns(panel: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """A configured column absent from the panel is added as all-null."""
    out = panel
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(dtype))
    return out


def impute_two_level(
    panel: DataFrame,
    columns: Sequence[str],
    roles: Roles = DEFAULT_ROLES,
    global_medians: dict[str, float | None] | None = None,
) -> tuple[DataFrame, dict[str, float | None]]:
    """A3 + A4 + C3 + W2: fill with the entity median, then with the global
    median of the entity-filled column (F7: order matters).

    Returns the filled panel and the global medians used in the second
    step (a column that is null everywhere stays null and its median is None).
    """
    cols = list(columns)
    w = Window.partitionBy(roles.entity)
    filled = panel.select(
        *[F.col(c) for c in panel.columns if c not in cols],
        *[F.coalesce(clean_double(c), F.median(clean_double(c)).over(w)).alias(c) for c in cols],
    )
    if global_medians is None:
        # read by the median pass and again by the fill: written once
        path = scratch_path(panel.sparkSession, "filled")
        filled.write.parquet(path)
        filled = panel.sparkSession.read.schema(filled.schema).parquet(path)
        global_medians = exact_medians(filled, cols)
    out = filled.select(
        *[F.col(c) for c in filled.columns if c not in cols],
        *[
            (F.coalesce(F.col(c), F.lit(global_medians[c])) if global_medians.get(c) is not None else F.col(c)).alias(c)
            for c in cols
        ],
    )
    return out.select(*panel.columns), global_medians


def median_map(panel: DataFrame, columns: Sequence[str], medians: dict[str, float | None] | None = None) -> DataFrame:
    """A4 + S11: persisted medians (after both fills); all-null column -> 0.0."""
    spark = panel.sparkSession
    if medians is None:
        medians = exact_medians(panel, list(columns))
    rows = [(c, float(medians[c]) if medians.get(c) is not None else 0.0) for c in columns]
    return spark.createDataFrame(rows, MEDIAN_MAP)


def category_maps(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, distinct categories sorted, dense code from 0; null -> UNKNOWN.

    Binary string order equals Python's sorted() on str (code points).  The
    distinct pairs are numbered over range partitions of (feature, category)
    (``ordering.dense_index``), so a high-cardinality column is not ranked in
    one task; a code is the pair's number minus its feature's first number
    (a table with one row per feature).
    """
    pairs = [F.struct(F.lit(c).alias("feature"), category_for_training(c).alias("category")) for c in columns]
    # one pass over the panel: (feature, category) pairs, de-duplicated map-side
    stacked = panel.select(F.explode(F.array(*pairs)).alias("s")).select("s.feature", "s.category").distinct()
    numbered = dense_index(stacked, ["feature", "category"], "_seq")
    first = numbered.groupBy("feature").agg(F.min("_seq").alias("_first"))  # one row per feature column
    return numbered.join(F.broadcast(first), on="feature", how="inner").select(
        "feature", "category", (F.col("_seq") - F.col("_first")).cast("int").alias("code")
    )


def encode(
    df: DataFrame,
    maps: DataFrame,
    columns: Sequence[str],
    scoring: bool = False,
) -> DataFrame:
    """Category -> code.  Training: total map; scoring: unseen -> -1, null or '' -> UNKNOWN.

    The map has one row per category; it is broadcast when its measured size
    allows, else joined with salts (``joins.lookup``).
    """
    out = df
    for c in columns:
        clean = category_for_scoring(c) if scoring else category_for_training(c)
        m = maps.filter(F.col("feature") == F.lit(c)).select(
            F.col("category").alias(f"_{c}_key"), F.col("code").alias(f"{c}_code")
        )
        out = lookup(out.withColumn(f"_{c}_key", clean), m, [f"_{c}_key"], "left")
        out = out.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(-1))).drop(f"_{c}_key")
        if not scoring:
            out = out.withColumn(c, clean)
    return out


def build_features(
    panel: DataFrame,
    start_year: int,
    end_year: int,
    min_years: int,
    numeric: Sequence[str],
    categorical: Sequence[str],
    roles: Roles = DEFAULT_ROLES,
    rules=None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E1 features: validate -> time range -> coverage -> missing columns ->
    impute -> medians -> encode.  Returns (features, category map, median map)."""
    from .quality import validate

    if rules is not None:
        panel, _ = validate(panel, rules)
    panel = time_range(panel, start_year, end_year, roles)
    panel = coverage_filter(panel, min_years, roles)
    panel = add_missing_columns(panel, numeric)
    panel = add_missing_columns(panel, [c for c in categorical], "string")
    panel, _ = impute_two_level(panel, numeric, roles)
    meds = median_map(panel, numeric)
    maps = category_maps(panel, categorical)
    feats = encode(panel, maps, categorical)
    return feats, maps, meds


__all__ = [
    "UNKNOWN",
    "time_range",
    "coverage_filter",
    "dropped_entities",
    "add_missing_columns",
    "impute_two_level",
    "median_map",
    "category_maps",
    "encode",
    "build_features",
]
