"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The white space of the corpus word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

# Rows a small side may have before it is joined by a shuffle instead of a broadcast
# (a row of the tables joined this way has at most some hundred bytes).
BROADCAST_ROWS = 100_000
SALTS = 64


def col(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared checkpoint folder and read back: later stages
    neither recompute it nor depend on an executor that may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_results(df: DataFrame, results: Sequence[tuple[str, Column]]) -> list[Column]:
    """The columns of ``df`` that no result replaces, then the results: a result
    column takes the place of an input column of the same name."""
    names = {n.lower() for n, _ in results}
    return [col(c) for c in df.columns if c.lower() not in names] + [c.alias(n) for n, c in results]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join of ``df`` with a table of one row per key, whose keys have
    the names ``keys`` on both sides and whose other names are new.

    The small side is counted (it should be staged) and broadcast up to
    ``max_rows`` rows.  Above that the rows of ``df`` get a salt and the small
    side a copy per salt, so that a key with a third of all rows is dealt to
    ``SALTS`` shares; both ways give the same rows.
    """
    right = small.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[col(c) for c in small.columns if c not in keys])
    on = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    if small.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(right), on, how).drop(*[f"__k{i}" for i in range(len(keys))])
    (salt,) = fresh(df, "__salt")
    left = df.withColumn(salt, F.pmod(F.xxhash64(*[col(c) for c in df.columns if c not in keys]), F.lit(SALTS)))
    right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return left.join(right, [col(salt) == F.col("__s"), *on], how).drop(salt, "__s", *[f"__k{i}" for i in range(len(keys))])
