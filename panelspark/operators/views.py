"""Dashboard-style views (P12, K1, K3, A12 in ``drift.availability``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SERIES = 8  # fixed value: at most 8 entities in a comparison chart


def entity_series(panel: DataFrame, entities: Sequence, measure: str, entity: str = "entity", time: str = "time") -> DataFrame:
    """P12 + K1: time series of one measure for chosen entities (at most 8), ordered."""
    chosen = list(entities)
    if len(chosen) > MAX_SERIES:
        raise ValueError(f"at most {MAX_SERIES} entities per chart, got {len(chosen)}")
    return (
        panel.filter(F.col(entity).isin(chosen))
        .select(entity, time, measure)
        .orderBy(entity, time)
    )


def top_entities(df: DataFrame, entity: str, n: int = MAX_SERIES) -> list:
    """The n entities with the most rows (ties: smaller key first); a top-k, not a subset rule."""
    rows = df.groupBy(entity).count().orderBy(F.col("count").desc(), F.col(entity)).limit(n).collect()
    return [r[entity] for r in rows]


def sorted_probabilities(classes: str, probs: str) -> F.Column:
    """K3: (class, probability) pairs in descending probability order."""
    pairs = F.arrays_zip(F.col(classes).alias("cls"), F.col(probs).alias("p"))
    return F.array_sort(pairs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))


def argmax_class(classes: str, probs: str) -> F.Column:
    """K3: the class of the largest probability (first on ties)."""
    return F.element_at(sorted_probabilities(classes, probs), 1)["cls"]
