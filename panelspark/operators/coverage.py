"""A2 and J6 across loads: the times an entity was seen at, as bit maps that merge.

A map holds 63 times a word, so an entity has a row per 63 years it was seen in (one, as a rule), whatever the rows of the load;
maps of several loads merge by OR, without rereading rows, and a load that comes twice changes nothing.

Null entities and times are not seen; an empty load has no map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_ROLES, Roles

WORD = 63


def seen(load: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """(entity, word, bits) of one load, combined map-side."""
    time = F.col(roles.time).cast("bigint")
    rows = load.filter(F.col(roles.entity).isNotNull() & time.isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(time, F.lit(WORD)).cast("int"))
    return rows.groupBy(roles.entity, F.floor(time / WORD).cast("bigint").alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged(*maps: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    both = maps[0]
    for more in maps[1:]:
        both = both.unionByName(more)
    return both.groupBy(roles.entity, "word").agg(F.bit_or("bits").alias("bits"))


def covered(maps: DataFrame, at_least: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """(entity, n_times) of the entities seen at ``at_least`` different times or more."""
    counted = maps.groupBy(roles.entity).agg(F.sum(F.bit_count("bits")).alias("n_times"))
    return counted.filter(F.col("n_times") >= at_least)
