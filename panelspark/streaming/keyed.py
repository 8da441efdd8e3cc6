"""Keyed state and timers (T4 and D4 per target, T6 open outages on a stream).

``count_windows`` cuts the rows of every key into windows of a fixed number in arrival order
and emits a window when it is full; what is left waits in the key's list state, the number of windows
in its value state.  ``silences`` keeps the last event of every key and one timer behind it; a
row moves the timer, and only when the watermark passes it is the key reported as silent.

State lives in the RocksDB state store and is checkpointed by Spark with the sources' offsets, so a restarted query goes on
where the last micro-batch ended: no row is lost or counted twice.  A key's rows of one micro-batch are
ordered in memory up to ``SORT_ROWS``, beyond that in sorted runs on the task's disk, merged block by block, and windows
leave in frames of that size, so a key's rows need not fit a worker; state per key is
at most a window less one row, or one row.

Rows of a null key form a key of their own (count windows) or are passed over (silences); rows with a null order
column come first in their micro-batch.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack, contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .rates import WATERMARK, run_to_table

SORT_ROWS = 250_000
_BLOCK_ROWS = 4096
_RUN = "__run"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which list state and timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _sorted(frame: pd.DataFrame, by: Sequence[str]) -> pd.DataFrame:
    return frame.sort_values(list(by), kind="stable", na_position="first", ignore_index=True)


def _merged(files: list, by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted runs as one: rows up to the first place where a run's loaded block ends come before all rows not loaded."""
    held, left = None, set(range(len(files)))
    while True:
        loaded = set() if held is None else set(held[_RUN])
        parts = [] if held is None else [held]
        for i in sorted(left - loaded):
            try:
                parts.append(pickle.load(files[i]).assign(**{_RUN: i}))  # noqa: S301 - written by this task
            except EOFError:
                left.discard(i)
        if not parts:
            return
        held = _sorted(pd.concat(parts, ignore_index=True), [*by, _RUN])
        ends = held[_RUN].drop_duplicates(keep="last")
        cut = min((at + 1 for at, i in ends.items() if i in left), default=len(held))
        yield held.iloc[:cut].drop(columns=_RUN)
        held = held.iloc[cut:] if cut < len(held) else None


def in_order(frames: Iterable[pd.DataFrame], by: Sequence[str], most: int = SORT_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in the order of ``by`` (nulls first, ties as they come), no more than about ``most`` in memory."""
    with ExitStack() as stack:
        folder, files, waiting, n = None, [], [], 0
        for frame in frames:
            for at in range(0, len(frame), most):
                piece = frame.iloc[at : at + most]
                if waiting and n + len(piece) > most:
                    if folder is None:
                        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
                        folder = stack.enter_context(tempfile.TemporaryDirectory(prefix="panelspark-runs-", dir=local if os.path.isdir(local) else None))
                    files.append(stack.enter_context(open(f"{folder}/{len(files)}", "w+b")))
                    run = _sorted(pd.concat(waiting, ignore_index=True), by)
                    for start in range(0, len(run), _BLOCK_ROWS):
                        pickle.dump(run.iloc[start : start + _BLOCK_ROWS].copy(), files[-1])
                    files[-1].seek(0)
                    waiting, n = [], 0
                waiting.append(piece)
                n += len(piece)
        rest = _sorted(pd.concat(waiting, ignore_index=True), by) if waiting else None
        if not files:
            if rest is not None:
                yield rest
            return
        last = stack.enter_context(open(f"{folder}/{len(files)}", "w+b"))
        for start in range(0, len(rest), _BLOCK_ROWS):
            pickle.dump(rest.iloc[start : start + _BLOCK_ROWS].copy(), last)
        last.seek(0)
        del rest, waiting
        yield from _merged([*files, last], list(by))


class CountWindows(StatefulProcessor):
    """Windows of ``size`` rows of a key, in the order of ``order`` within a micro-batch."""

    def __init__(self, key: str, key_type: T.DataType, order: Sequence[str], kept: T.StructType, size: int):
        self.key, self.key_type, self.order, self.kept, self.size = key, key_type, list(order), kept, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getValueState("windows", T.StructType([T.StructField("n", T.LongType())]))
        self.waiting = handle.getListState("waiting", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.kept.names
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        done = self.windows.get()[0] if self.windows.exists() else 0
        for part in in_order((r[names] for r in rows), self.order):
            for start in range(0, len(part), SORT_ROWS):
                held += part.iloc[start : start + SORT_ROWS].itertuples(index=False, name=None)
                full = len(held) // self.size
                if full:
                    out = pd.DataFrame(held[: full * self.size], columns=names)
                    out.insert(0, "window_no", done + out.index // self.size)
                    out.insert(0, self.key, key[0])
                    yield out
                    done, held = done + full, held[full * self.size :]
        rest = [tuple(None if pd.isna(v) else v for v in r) for r in held]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.windows.update((done,))

    def close(self) -> None:
        pass


def count_windows(stream: DataFrame, key: str, order: Sequence[str], values: Sequence[str], size: int) -> DataFrame:
    """Rows of full windows: key, window_no (from 0 by key), the order columns and ``values``."""
    fields = {f.name: f for f in stream.schema.fields}
    kept = T.StructType([T.StructField(c, fields[c].dataType, True) for c in dict.fromkeys([*order, *values])])
    out = T.StructType([T.StructField(key, fields[key].dataType, True), T.StructField("window_no", T.LongType()), *kept.fields])
    processor = CountWindows(key, fields[key].dataType, order, kept, size)
    rows = stream.select(key, *kept.names)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "None")


class Silences(StatefulProcessor):
    """A key's last event and one event-time timer ``gap_ms`` behind it."""

    def __init__(self, key: str, gap_ms: int):
        self.key, self.gap_ms = key, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType()), T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, n = self.last.get() if self.last.exists() else (None, 0)
        for frame in rows:
            newest = int(frame["us"].max())
            n += len(frame)
            us = newest if us is None else max(us, newest)
        # one timer a key: whatever waited before this row is called off
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((us, n))
        self.handle.registerTimer(us // 1000 + self.gap_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, n = self.last.get()
        yield pd.DataFrame({self.key: [key[0]], "last_us": [us], "n_events": [n]})

    def close(self) -> None:
        pass


def silences(events: DataFrame, key: str, ts: str = "ts", gap_minutes: int = 3, watermark: str = WATERMARK) -> DataFrame:
    """Keys without an event for ``gap_minutes`` as the watermark sees it: key, last_seen, n_events (so far).

    A row that arrives late, but before the watermark has passed the end of the silence, calls the alarm off."""
    kind = {f.name: f for f in events.schema.fields}[key].dataType
    timed = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    out = T.StructType([T.StructField(key, kind), T.StructField("last_us", T.LongType()), T.StructField("n_events", T.LongType())])
    rows = timed.select(key, ts, F.unix_micros(ts).alias("us"))
    found = rows.groupBy(key).transformWithStateInPandas(Silences(key, gap_minutes * 60_000), out, "Append", "EventTime")
    return found.select(key, F.date_format(F.timestamp_micros("last_us"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "n_events")


def run_keyed(df: DataFrame, root: str) -> DataFrame:
    """Runs a keyed query over what is available into a table under ``root`` and reads it (again: goes on there)."""
    spark = df.sparkSession
    with rocksdb(spark):
        run_to_table(df, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{root}/out")
