"""Entity-grouped train/test split (M1) and target rows.

Threshold mode (default): an entity is in the test side when the first 8
hex digits of ``md5('<seed>:<entity>')`` mod 10000 fall below
``test_size * 10000``.  Per-row, no shuffle, no entity on both sides, the
same in every engine.  Exact-count mode puts exactly
``ceil(test_size * n_entities)`` entities in the test side (the count rule
of a group shuffle split) by selecting the hash threshold with the
distributed exact rank selection: no global sort, no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import RANDOM_SEED, TEST_SIZE
from .quantiles import value_at_rank


def entity_hash(entity: str | Column, seed: int = RANDOM_SEED, digits: int = 8) -> Column:
    col = F.col(entity) if isinstance(entity, str) else entity
    h = F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def split_side(entity: str | Column, seed: int = RANDOM_SEED, test_size: float = TEST_SIZE) -> Column:
    """'test' or 'train' for a row, from its entity only."""
    bucket = entity_hash(entity, seed) % F.lit(10000)
    return F.when(bucket < F.lit(int(round(test_size * 10000))), F.lit("test")).otherwise(F.lit("train"))


def target_rows(df: DataFrame, target: str) -> DataFrame:
    """Rows with a non-null target."""
    return df.filter(F.col(target).isNotNull())


def group_split(
    df: DataFrame,
    entity: str,
    target: str | None = None,
    seed: int = RANDOM_SEED,
    test_size: float = TEST_SIZE,
    exact_count: bool = False,
) -> DataFrame:
    """Adds ``side``; rows of one entity always land on the same side."""
    rows = target_rows(df, target) if target else df
    if not exact_count:
        return rows.withColumn("side", split_side(entity, seed, test_size))
    # 13 hex digits = 52 bits: exact as a double, so the selected threshold is exact
    ents = rows.select(F.col(entity).alias("_e")).distinct().withColumn("_h", h_of("_e", seed))
    n_ent = ents.count()
    n_test = math.ceil(test_size * n_ent)
    if n_test <= 0:
        return rows.withColumn("side", F.lit("train"))
    threshold = value_at_rank(ents.select(F.col("_h").cast("double").alias("_h")), "_h", n_test - 1)
    return rows.withColumn("side", F.when(h_of(entity, seed).cast("double") <= F.lit(threshold), "test").otherwise("train"))


def h_of(entity: str, seed: int) -> Column:
    return entity_hash(entity, seed, digits=13)
