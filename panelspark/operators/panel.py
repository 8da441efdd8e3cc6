"""Long observations -> entity x time panel (merge stage).

Shuffle plan at scale: the long table is aggregated by (entity, time) with
map-side partial averages (one shuffle, skew-safe because a hot entity is
split over its times and pre-combined before the exchange).  The resulting
panel has at most one row per entity and time, so the per-entity steps that
follow (row lag, dimension join, static measures) work on bounded groups.
Dimensions (names, snapshot, static measures) are keyed by entity and
joined with a sort-merge join unless a bounded count proves them small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import priority_coalesce, provenance, to_int, to_number, clean_double
from ..params import GINI_PRIORITY, SOURCE_PRIORITY, SOURCE_SCALE
from ..schemas import DEFAULT_ROLES, Roles
from .joins import assert_unique


def rank_of(source: Column, priority: Sequence[str]) -> Column:
    """Position of a source in the priority list (unknown sources last)."""
    expr = F.lit(len(priority))
    for i, name in reversed(list(enumerate(priority))):
        expr = F.when(source == F.lit(name), F.lit(i)).otherwise(expr)
    return expr


def union_sources(frames: Sequence[DataFrame], roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Union all of long tables by name, with an explicit ``source_rank``.

    Spark keeps no row order, so the priority of a source is a column.
    """
    if not frames:
        raise ValueError("union_sources needs at least one frame")
    out = frames[0].select(*roles.long_columns)
    for f in frames[1:]:
        out = out.unionByName(f.select(*roles.long_columns))
    return out.withColumn("source_rank", rank_of(F.col(roles.source), SOURCE_PRIORITY))


def clean_long(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """P1 + P2: coerce time and value, drop rows with a null key or value."""
    return (
        df.withColumn(roles.time, to_int(F.col(roles.time)))
        .withColumn(roles.value, to_number(F.col(roles.value)))
        .dropna(subset=[roles.entity, roles.time, roles.indicator, roles.value])
    )


def source_factor(source: Column, scale: Mapping[str, float] = SOURCE_SCALE) -> Column:
    """The unit factor of a source (1.0 when none is configured)."""
    factor = F.lit(1.0)
    for src, k in scale.items():
        factor = F.when(source == F.lit(src), F.lit(float(k))).otherwise(factor)
    return factor


def rescale_by_source(
    df: DataFrame, scale: Mapping[str, float] = SOURCE_SCALE, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Per-source unit factor (e.g. a 0-1 index to 0-100)."""
    return df.withColumn(roles.value, F.col(roles.value) * source_factor(F.col(roles.source), scale))


def pivot_mean(long: DataFrame, indicators: Sequence[str], roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A1: long -> wide, mean of duplicates, one column per given indicator.

    The value list is given, so there is no extra pass to find it and the
    schema is fixed.  One groupBy with conditional averages: partial
    aggregation happens before the shuffle.  Cells with no value in any of
    the indicators do not appear (the indicator filter is pushed to the scan).
    """
    inds = list(indicators)
    value = clean_double(roles.value)
    aggs = [F.avg(F.when(F.col(roles.indicator) == F.lit(i), value)).alias(i) for i in inds]
    return (
        long.filter(F.col(roles.indicator).isin(inds) & value.isNotNull())
        .filter(F.col(roles.entity).isNotNull() & F.col(roles.time).isNotNull())
        .groupBy(roles.entity, roles.time)
        .agg(*aggs)
    )


def split_indicators(indicators: Sequence[str], prefix: str = "gini_index") -> tuple[list[str], list[str]]:
    """Split indicator names by prefix: (rest, prefixed)."""
    rest = [i for i in indicators if not i.startswith(prefix)]
    pref = [i for i in indicators if i.startswith(prefix)]
    return rest, pref


def coalesce_with_provenance(
    panel: DataFrame,
    priority: Sequence[str] = GINI_PRIORITY,
    out: str = "gini_index",
    source_col: str = "gini_source",
) -> DataFrame:
    """C1 + C2: priority coalesce over the present columns, provenance = winning column name."""
    present = [c for c in priority if c in panel.columns]
    return panel.withColumn(source_col, provenance(present)).withColumn(out, priority_coalesce(present))


def entity_names(long: DataFrame, roles: Roles = DEFAULT_ROLES, priority: Sequence[str] = SOURCE_PRIORITY) -> DataFrame:
    """First non-null name per entity in source priority order.

    Order inside a source is (time, name) (own choice; the original keeps
    file order).
    """
    rank = F.col("source_rank") if "source_rank" in long.columns else rank_of(F.col(roles.source), priority)
    return (
        long.filter(F.col(roles.entity_name).isNotNull() & F.col(roles.entity).isNotNull())
        .groupBy(roles.entity)
        .agg(
            F.min_by(
                F.col(roles.entity_name), F.struct(rank.alias("r"), F.col(roles.time), F.col(roles.entity_name))
            ).alias(roles.entity_name)
        )
    )


def full_outer_panel(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join of two panels on (entity, time)."""
    return left.join(right, on=list(keys), how="full_outer")


def attach(
    panel: DataFrame,
    dim: DataFrame | None,
    key: str,
    columns: Sequence[str],
    check_unique: bool = True,
    null_type: str = "string",
) -> DataFrame:
    """Left join of a per-entity dimension to every time of the entity.

    Absent dimension -> the columns are added as nulls (J4).  Duplicate keys
    raise (they would fan out panel rows).
    """
    if dim is None:
        out = panel
        for c in columns:
            out = out.withColumn(c, F.lit(None).cast(null_type))
        return out
    side = dim.select(key, *columns)
    if check_unique:
        assert_unique(side, [key], "dimension")
    return panel.join(side, on=key, how="left")


def row_lag(panel: DataFrame, column: str, out: str | None = None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Previous present row of the entity (a row lag, not year - 1)."""
    w = Window.partitionBy(roles.entity).orderBy(roles.time)
    return panel.withColumn(out or f"{column}_lag1", F.lag(F.col(column), 1).over(w))


def latest_nonnull(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """A5: latest non-null value per column and key (nulls skipped per column).

    Ties on ``order`` are broken by the value itself (own choice).
    """
    aggs = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).alias(c) for c in columns
    ]
    return df.groupBy(key).agg(*aggs)


def build_panel(
    long: DataFrame,
    indicators: Sequence[str],
    dimension: DataFrame | None = None,
    dimension_columns: Sequence[str] = ("income_group", "region"),
    static: DataFrame | None = None,
    static_columns: Sequence[str] = ("intergen_income_elasticity", "intergen_rank_correlation"),
    roles: Roles = DEFAULT_ROLES,
    lag_column: str = "income_group",
) -> DataFrame:
    """E1 merge: pivot, coalesce Gini variants, names, snapshot + lag, static measures."""
    rest, gini = split_indicators(indicators)
    wide = pivot_mean(long, list(rest) + list(gini), roles)
    if gini:
        wide = coalesce_with_provenance(wide, [g for g in GINI_PRIORITY if g in gini] + [g for g in gini if g not in GINI_PRIORITY])
        wide = wide.drop(*[g for g in gini if g != "gini_index"])
    names = entity_names(long, roles)
    wide = wide.join(names, on=roles.entity, how="left")
    wide = attach(wide, dimension, roles.entity, list(dimension_columns))
    if lag_column in wide.columns:
        wide = row_lag(wide, lag_column, roles=roles)
    wide = attach(wide, static, roles.entity, list(static_columns), null_type="double")
    return wide
