"""S5 beyond one row: JSON-stat files read in byte ranges, so that a cube is dealt to many tasks.

A range alone does not say whether it begins inside a string or how deep.  Every range therefore
tells its quotes and its change of depth for both beginnings (one row a range); sums over the ranges before
give its true beginning, a second pass finds the members of the top object, and the cells of ``value`` are read by
ranges of their own.  A cell belongs to the range that holds the byte after its comma.  Dense arrays
number their cells by the commas before a range.  A task takes as many ranges as make up ``TASK_BYTES``, one after
the other and those of a file side by side, and reads ``id``, ``size`` and ``dimension`` once a file.

One cube a file, in any order of members, on any file system that the tasks can open by its address.
Null cells and cells without a place in the cube are skipped, as in ``payloads.flatten_jsonstat``;
a file without ``value`` has no rows; codes without a label are their own label.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 32 * 1024 * 1024
TASK_BYTES = 32 * 1024 * 1024
_KEY_BYTES = 4096
_RESULT = "path string, flat bigint, codes map<string,string>, labels map<string,string>, value double"
_ESCAPED = re.compile(rb"\\.", re.S)
_LAST_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


def _read(path: str, start: int, end: int) -> bytes:
    where, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    with where.open_input_file(name) as f:
        f.seek(start)
        return f.read(max(end - start, 0))


def _plain(path: str, start: int, end: int) -> np.ndarray:
    """The bytes of a range, those after a backslash (and it) blanked."""
    before = _read(path, max(start - 64, 0), start)
    odd = (len(before) - len(before.rstrip(b"\\"))) % 2
    b = bytearray(_ESCAPED.sub(b"..", (b"\\" if odd else b"") + _read(path, start, end)))
    return np.frombuffer(bytes(b[1:] if odd else b), np.uint8)


def _steps(b: np.ndarray, inside: int) -> np.ndarray:
    """Change of depth at every byte, none inside strings."""
    out = (np.cumsum(b == ord('"')) + inside) % 2 == 0
    return np.where(out, np.isin(b, (123, 91)).astype(np.int64) - np.isin(b, (125, 93)), 0)


def _lexed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for r in part.itertuples():
            b = _plain(r.path, r.start, r.end)
            rows.append((r.path, r.start, r.end, int((b == ord('"')).sum()), int(_steps(b, 0).sum()), int(_steps(b, 1).sum())))
        yield pd.DataFrame(rows, columns=["path", "start", "end", "quotes", "outside", "inside"])


def _members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the lists and objects of the top object begin and end."""
    for part in parts:
        rows = []
        for r in part.itertuples():
            b = _plain(r.path, r.start, r.end)
            step = _steps(b, int(r.q))
            depth = int(r.depth) + np.cumsum(step)
            for i in np.flatnonzero(((step == 1) & (depth == 2)) | ((step == -1) & (depth == 1))):
                at = int(r.start + i)
                key = _LAST_KEY.search(_read(r.path, max(at - _KEY_BYTES, 0), at)) if step[i] == 1 else None
                rows.append((r.path, at, None if key is None else json.loads(b'"' + key[1] + b'"'), bool(b[i] == 91)))
        yield pd.DataFrame(rows, columns=["path", "at", "key", "dense"])


def _commas(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        n = [_read(r.path, r.start, r.end).count(b",") for r in part.itertuples()]
        yield part.assign(commas=np.array(n, "int64"))


def _own(path: str, start: int, end: int, first: int, last: int) -> tuple[bytes, int]:
    """The whole cells that begin in a range of those between ``first`` and ``last``, and how
    many commas of the range lie before the first of them."""
    lead, passed = int(start > first), 0
    text = _read(path, start - lead, end)
    if lead:
        cut = text.find(b",", 0, len(text) - 1)
        if cut < 0:
            return b"", 0
        text, passed = text[cut + 1 :], int(cut > 0)
    while end < last and not text.endswith(b","):  # the last cell goes on in the next range
        more = _read(path, end, min(end + _KEY_BYTES, last))
        cut = more.find(b",")
        text += more if cut < 0 else more[: cut + 1]
        end += len(more) if cut < 0 else cut + 1
    return text.strip().removesuffix(b","), passed


def _dimensions(path: str, members: dict) -> tuple[list, list[int], list[list], list[list]]:
    ids, sizes, dims = (json.loads(_read(path, members[k]["at"], members[k]["to"] + 1)) for k in ("id", "size", "dimension"))
    codes, labels = [], []
    for name in ids:
        cat = (dims.get(name) or {}).get("category") or {}
        label, index = cat.get("label") or {}, cat.get("index")
        listed = sorted(index, key=index.get) if isinstance(index, dict) else list(index) if index else list(label)
        codes.append(listed)
        labels.append([label.get(c, c) for c in listed])
    return ids, [int(n) for n in sizes], codes, labels


def _cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, described = None, None
    for part in parts:
        for r in part.to_pylist():
            members = {m["key"]: m for m in r["members"]}
            text, passed = _own(r["path"], r["start"], r["end"], r["first"], r["last"])
            if not text:
                continue
            if r["dense"]:
                found = json.loads(b"[" + text + b"]")
                flat = r["before"] + passed + np.arange(len(found), dtype="int64")
            else:
                cells = json.loads(b"{" + text + b"}")
                found, flat = list(cells.values()), np.fromiter((int(k) for k in cells), "int64", len(cells))
            value = np.array([np.nan if x is None else float(x) for x in found])
            if of != r["path"]:
                of, described = r["path"], _dimensions(r["path"], members)
            ids, sizes, codes, labels = described
            keep = np.array([x is not None for x in found]) & (flat >= 0) & (flat < np.prod(np.array(sizes, dtype=object)))
            flat, value = flat[keep], value[keep]
            stride, of_code, of_label = 1, [], []
            for size, code, label in reversed(list(zip(sizes, codes, labels, strict=True))):
                place = pa.array((flat // stride) % size)
                padded = lambda xs, size=size: pa.array([*xs, *[None] * (size - len(xs))][:size], pa.string())
                of_code.insert(0, padded(code).take(place))
                of_label.insert(0, padded(label).take(place))
                stride *= size
            offsets = pa.array(np.arange(len(flat) + 1, dtype="int32") * len(ids))
            # columns side by side, read row by row
            order = pa.array(np.arange(len(flat) * len(ids)).reshape(len(ids), len(flat)).T.ravel())
            keys = pa.array(ids * len(flat), pa.string())
            maps = [pa.MapArray.from_arrays(offsets, keys, pa.concat_arrays(xs).take(order)) for xs in (of_code, of_label)]
            path = pa.array([r["path"]] * len(flat), pa.string())
            yield pa.RecordBatch.from_arrays([path, pa.array(flat), *maps, pa.array(value)], ["path", "flat", "codes", "labels", "value"])


def read_jsonstat(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, flat, codes, labels, value): one row per present cell of every file under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").cast("bigint").alias("length")).filter("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0
    # dealt by the bytes they stand for, not merged by size: the rows are only addresses
    at_once = max(-(-total // max(range_bytes, TASK_BYTES)), 2 * spark.sparkContext.defaultParallelism)
    tasks = max(int(min(-(-total // range_bytes), at_once, 100_000)), 1)
    stretch = F.floor(F.col("start") / max(range_bytes, TASK_BYTES // 8))

    def dealt(df: DataFrame, first: str, last: str) -> DataFrame:
        start = F.explode(F.sequence(F.expr(first), F.expr(last) - 1, F.lit(range_bytes)))
        return df.select("*", start.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, F.expr(last))).repartition(tasks)

    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    lexed = dealt(files, "0L", "length").mapInPandas(_lexed, "path string, start bigint, end bigint, quotes bigint, outside bigint, inside bigint")
    state = lexed.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    state = state.withColumn("step", F.when(F.col("q") == 0, F.col("outside")).otherwise(F.col("inside")))
    state = state.select("path", "start", "end", "q", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth")).repartition(tasks)
    events = state.mapInPandas(_members, "path string, at bigint, key string, dense boolean")
    pairs = events.withColumn("to", F.lead("at").over(Window.partitionBy("path").orderBy("at"))).filter(F.col("key").isNotNull())
    wanted = pairs.filter(F.col("key").isin("id", "size", "dimension", "value"))
    cubes = wanted.groupBy("path").agg(
        F.collect_list(F.struct("key", "at", "to")).alias("members"),
        *[F.max(F.when(F.col("key") == "value", F.expr(c))).alias(n) for c, n in (("at + 1", "first"), ("to", "last"), ("dense", "dense"))],
    )
    cubes = cubes.filter((F.size("members") == 4) & (F.col("last") > F.col("first")))
    ranges = dealt(cubes, "first", "last").select("path", "start", "end", "first", "last", "dense", "members")
    counted = ranges.mapInPandas(_commas, T.StructType([*ranges.schema.fields, T.StructField("commas", T.LongType())]))
    placed = counted.withColumn("before", F.coalesce(F.sum("commas").over(before), F.lit(0)))
    beside = placed.drop("commas").repartition(tasks, "path", stretch).sortWithinPartitions("path", "start")
    return beside.mapInArrow(_cells, _RESULT)
