"""Join helpers: broadcasts behind a measured size, salted joins beyond it, uniqueness.

``small_side`` measures a scanned side (bounded read) and adds the broadcast
hint below ``BROADCAST_BYTES``.  ``lookup`` is for a side that is itself the result of a
big computation: it is written once, measured, and either broadcast or joined with
salts, so that a key that holds a third of the rows is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# Own choice: bytes (as text) a side may have to be shipped to every task.
BROADCAST_BYTES = 32 * 1024 * 1024
# A row read to measure a side counts at least so many bytes.
_ROW_BYTES = 32
SALTS = 32


def measured(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> int | None:
    """Bytes of the rows as text if they are <= max_bytes, else None (reads at most max_bytes / 32 rows)."""
    rows = df.limit(max_bytes // _ROW_BYTES + 1)
    size = F.greatest(F.length(F.to_json(F.struct("*"))), F.lit(_ROW_BYTES))
    total = rows.agg(F.sum(size)).first()[0] or 0
    return int(total) if total <= max_bytes else None


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the side is measured small, the plain frame otherwise."""
    return F.broadcast(df) if measured(df, max_bytes) is not None else df


def lookup(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` joined with a computed side of one row per key (same column names in ``on``)."""
    on = list(on)
    path = scratch_path(df.sparkSession, "lookup")
    side.write.parquet(path)
    side = df.sparkSession.read.schema(side.schema).parquet(path)
    if measured(side, max_bytes) is not None:
        return df.join(F.broadcast(side), on=on, how=how)
    others = [F.col(c) for c in df.columns if c not in on]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, on=[*on, "_salt"], how=how).drop("_salt")


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Duplicate keys in a dimension would fan out rows of the fact side."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{what}: key {keys} is not unique, e.g. {dup[0].asDict()}")
