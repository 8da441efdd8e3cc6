"""Exact duplicate strings: bytes covered by a 100-byte string that starts earlier.

Prefix doubling ranks every position by the pair of ranks at growing offsets and
sorts the pairs in every round; a corpus has too many positions to sort them all
even once.  So one suffix stands for the strings that reach over it: of the
``LENGTH`` - ``GRAM`` + 1 grams in a string the one with the least hash, the leftmost of
equals.  Equal strings choose the same gram at the same offset, whatever lies around
them.  Neighbouring strings with the same choice make a run, and ranks grow by it:

1. rank at ``GRAM`` bytes: runs are sorted by the name of their gram; a gram that
   appears once in the corpus is unique, and its strings are done;
2. rank of the pair (gram, bytes of the whole run): every run but the first of equal
   ones is past the threshold with all its strings;
3. what is left are first runs whose gram has other surroundings elsewhere: their
   strings are ranked at the threshold itself, by their ``LENGTH`` bytes.

A task drops runs that equal an earlier one of its own before the shuffle, so a
passage in a third of all documents arrives a few times per task.  Surroundings of one
gram are compared in one task up to ``MANY`` of them; above that their strings are
dealt out one by one.  Both ways give the same result.  Names are 64-bit hashes, always
used in pairs.

Documents are written once with a row number, and what is found of them goes back by
files per part of that table, so the texts are never shuffled.

Defined results: null and empty texts have no bytes; null ids come after all others;
rows with equal ids are the same document, whose strings are earlier only at an earlier
start; an empty table gives an empty result.  Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import col, staged
from .tokens import _files

LENGTH = 100
GRAM = 25
MANY = 4096
_BLOCK = 1 << 18  # bytes hashed together; longer texts go in pieces
_RUNS = 500_000  # runs held by a task before they are sent
_ROWS = 40_000  # runs resolved together

_P = 0x9E3779B97F4A7C15
_FORTH = np.multiply.accumulate(np.array([1] + [_P] * (_BLOCK + 1024), np.uint64))
_BACK = np.multiply.accumulate(np.array([1] + [pow(_P, -1, 1 << 64)] * (_BLOCK + 1024), np.uint64))
_PLACE = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _prefixes(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _FORTH[: len(b)], out=out[1:])
    return out


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (text number, offset, bytes); pieces of a long text overlap by a string less one byte."""
    block: list[tuple[int, int, bytes]] = []
    held = 0
    for i, raw in enumerate(texts):
        if len(raw) < length:
            continue
        step = _BLOCK - length
        for at in range(0, max(1, len(raw) - length + 1), step):
            piece = raw[at : at + step + length - 1]
            if held + len(piece) > _BLOCK:
                yield block
                block, held = [], 0
            block.append((i, at, piece))
            held += len(piece)
    if block:
        yield block


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of strings with one chosen gram: ``doc`` (number of the text), ``p`` (first
    start), ``n`` (starts), ``h`` and ``c`` (names of the gram and of the run's bytes)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "p", "n", "h", "c")}
    for block in _pieces(texts, length):
        b = np.frombuffer(b"".join(x for _, _, x in block), np.uint8)
        size = np.array([len(x) for _, _, x in block])
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(block)), size)
        within = np.arange(len(b)) - begin[piece]
        prefix = _prefixes(b)
        g = _mix((prefix[gram:] - prefix[:-gram]) * _BACK[: len(b) - gram + 1])
        low = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        width, reach = length - gram + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        chosen = (low & _PLACE).astype(np.int64)
        start = np.flatnonzero(within[: len(chosen)] + length <= size[piece[: len(chosen)]])
        if not len(start):
            continue
        of = chosen[start]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(of) != 0)]))
        first, n = start[new], np.diff(np.append(new, len(start)))
        # runs of neighbouring starts only, so the last start is first + n - 1
        c = (prefix[first + n - 1 + length] - prefix[first]) * _BACK[first]
        out["doc"].append(np.array([i for i, _, _ in block])[piece[first]])
        out["p"].append(within[first] + np.array([at for _, at, _ in block])[piece[first]])
        out["n"].append(n)
        out["h"].append(g[of[new]])
        out["c"].append(_mix(c ^ _mix(n.astype(np.uint64))))
    empty = {"h": np.uint64, "c": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, empty.get(k, np.int64)) for k, v in out.items()}


def later(keys: list[np.ndarray], none: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which rows have an earlier one (id, nulls last, then start) with the same keys."""
    if not len(p):
        return np.zeros(0, bool)
    order = np.lexsort((p, d, none, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = (none[first] != none[order]) | (d[first] != d[order]) | (p[first] != p[order])
    return out


def _merged(doc: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of neighbouring starts put together; the rows are in order of (doc, p)."""
    if not len(p):
        return doc, p, n
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (p[1:] != p[:-1] + n[:-1])])
    at = np.flatnonzero(new)
    return doc[at], p[at], np.add.reduceat(n, at)


def _ids(d: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    none = d.isna().to_numpy(bool)
    return none, d.fillna(0).to_numpy(np.int64)


def _raw(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


_RUN = "key bigint, c bigint, d bigint, id bigint, p bigint, n bigint, done boolean"


def _send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of the texts; of equal runs in hand only the first, the others as done."""
    held: list[dict[str, np.ndarray]] = []
    count = 0

    def flush() -> pd.DataFrame:
        a = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        done = later([a["h"], a["c"]], a["none"], a["d"], a["p"])
        rest = ~done
        doc, p, n = _merged(a["id"][done], a["p"][done], a["n"][done])
        # done rows get a key that no gram shares with many others
        spread = _mix(doc.astype(np.uint64) * np.uint64(_P) + p.astype(np.uint64))
        zero = np.zeros(len(p), np.int64)
        d = pd.array(np.concatenate([a["d"][rest], zero]), "Int64")
        d[np.concatenate([a["none"][rest], np.zeros(len(p), bool)])] = pd.NA
        return pd.DataFrame({
            "key": np.concatenate([a["h"][rest], spread]).view(np.int64), "c": np.concatenate([a["c"][rest].view(np.int64), zero]), "d": d,
            "id": np.concatenate([a["id"][rest], doc]), "p": np.concatenate([a["p"][rest], p]), "n": np.concatenate([a["n"][rest], n]),
            "done": np.concatenate([np.zeros(int(rest.sum()), bool), np.ones(len(p), bool)]),
        })

    for batch in batches:
        none, d = _ids(batch["d"])
        ids, raw = batch["id"].to_numpy(np.int64), _raw(batch["t"])
        for i in range(0, len(raw), 500):
            a = runs(raw[i : i + 500])
            doc = a.pop("doc") + i
            held.append(a | {"id": ids[doc], "d": d[doc], "none": none[doc]})
            count += len(doc)
            if count >= _RUNS:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def _reader(folder: str, columns: list[str]):
    """Rows found for a part of the written documents, as arrays in order of (id, p),
    read by the tasks that read the part."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    fs, root = _files(folder)
    last: dict[int, dict[str, np.ndarray]] = {}

    def of(part: int) -> dict[str, np.ndarray]:
        if part not in last:
            last.clear()
            path = f"{root}/part={part}"
            if fs.get_file_info(path).type.name == "Directory":
                table = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=columns).sort_by([("id", "ascending"), ("p", "ascending")])
            else:
                table = pa.table({c: pa.array([], pa.int64()) for c in columns})
            last[part] = {c: table[c].to_numpy() for c in columns}
        return last[part]

    return of


def _by_part(found: DataFrame, name: str) -> str:
    """Writes rows with ``id`` to one folder per part of the written documents."""
    path = scratch_path(found.sparkSession, name)
    part = F.shiftright("id", 33).cast("int")
    found.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(path)
    return path


def _with_rows(folder: str, columns: list[str], batches: Iterator[pd.DataFrame]):
    """(id, d, raw text, arrays of its rows) of every text."""
    of = _reader(folder, columns)
    for batch in batches:
        ids, d, raw = batch["id"].to_numpy(np.int64), batch["d"].tolist(), _raw(batch["t"])
        for part in dict.fromkeys((ids >> 33).tolist()):
            rows = of(part)
            here = np.flatnonzero((ids >> 33) == part)
            lo, hi = (np.searchsorted(rows["id"], ids[here], side=side).tolist() for side in ("left", "right"))
            for i, a, b in zip(here.tolist(), lo, hi, strict=True):
                yield int(ids[i]), d[i], raw[i], {c: v[a:b] for c, v in rows.items()}


def _resolve(batch: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """Starts of strings that come earlier in another run of the same gram."""
    none, d = _ids(batch["d"])
    h, p, n = batch["key"].to_numpy(np.int64), batch["p"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
    names = np.empty(int(n.sum()), np.uint64)
    to = np.cumsum(n)
    raw = batch["bytes"].tolist()
    i = 0
    while i < len(raw):
        j, held = i, 0
        while j < len(raw) and (j == i or held + len(raw[j]) <= _BLOCK):
            held += len(raw[j])
            j += 1
        b = np.frombuffer(b"".join(raw[i:j]), np.uint8)
        prefix = _prefixes(b)
        size = np.array([len(x) for x in raw[i:j]])
        begin = np.cumsum(size) - size
        at = np.arange(int(n[i:j].sum())) + np.repeat(begin - (np.cumsum(n[i:j]) - n[i:j]), n[i:j])
        names[to[i] - n[i] : to[j - 1]] = _mix((prefix[at + length] - prefix[at]) * _BACK[at])
        i = j
    row = np.repeat(np.arange(len(n)), n)
    start = p[row] + np.arange(len(row)) - np.repeat(to - n, n)
    twice = later([h[row], names], none[row], d[row], start)
    row, start = row[twice], start[twice]
    row, start, count = _merged(row, start, np.ones(len(start), np.int64))
    return pd.DataFrame({"id": batch["id"].to_numpy(np.int64)[row], "p": start, "n": count})


def repeated(docs: DataFrame, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(written, found): the documents with their row number (id, d, t), and the
    starts of strings that appear earlier: row number ``id``, first start ``p``, ``n`` starts."""
    spark = docs.sparkSession
    written = staged(docs.withColumn("id", F.monotonically_increasing_id()), "texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = written.mapInPandas(_send, _RUN).repartition(n, "key")
    equal = Window.partitionBy("key", "c").orderBy(F.col("d").asc_nulls_last(), "p")
    gram = Window.partitionBy("key")
    # rank() counts rows of the same place as one; the number of first runs tells a unique gram
    ranked = sent.withColumn("rank", F.rank().over(equal)).withColumn("around", F.sum((F.col("rank") == 1).cast("bigint")).over(gram))
    past = F.col("done") | (F.col("rank") > 1)
    marks = ranked.filter(past | (F.col("around") > 1)).select("id", "d", "p", "n", "key", past.alias("past"), "around")
    marks = staged(marks, "string-marks")
    open_ = _by_part(marks.filter("NOT past").select("id", "p", "n", "key", "around"), "string-runs")
    columns = ["id", "p", "n", "key", "around"]

    def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for id_, d, raw, rows in _with_rows(open_, columns, batches):
            for p, k, key, around in zip(rows["p"].tolist(), rows["n"].tolist(), rows["key"].tolist(), rows["around"].tolist(), strict=True):
                if around <= many:
                    out.append((key, d, id_, p, k, raw[p : p + k - 1 + LENGTH]))
            if len(out) >= _ROWS:
                yield pd.DataFrame(out, columns=["key", "d", "id", "p", "n", "bytes"]).astype({"d": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "d", "id", "p", "n", "bytes"]).astype({"d": "Int64"})

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for id_, d, raw, rows in _with_rows(open_, columns, batches):
            hot = rows["around"] > many
            if hot.any():
                starts = np.concatenate([np.arange(p, p + k) for p, k in zip(rows["p"][hot].tolist(), rows["n"][hot].tolist(), strict=True)])
                names = [hashlib.blake2b(raw[s : s + LENGTH], digest_size=16).digest() for s in starts.tolist()]
                yield pd.DataFrame({"name": names, "d": pd.array([None if pd.isna(d) else int(d)] * len(starts), "Int64"), "id": id_, "p": starts})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come in order of the gram; what is held is compared where a gram ends
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= _ROWS:
                whole = held["key"] != held["key"].iloc[-1]
                if whole.any():
                    yield _resolve(held[whole].reset_index(drop=True))
                    held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            yield _resolve(held)

    bytes_ = written.mapInPandas(surroundings, "key bigint, d bigint, id bigint, p bigint, n bigint, bytes binary")
    few = bytes_.repartition(n, "key").sortWithinPartitions("key").mapInPandas(compare, "id bigint, p bigint, n bigint")
    found = marks.filter("past").select("id", "p", "n").union(few)
    if marks.filter((F.col("around") > many) & ~F.col("past")).limit(1).count():
        each = staged(written.mapInPandas(strings, "name binary, d bigint, id bigint, p bigint"), "strings")
        first = each.groupBy("name").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "p")).alias("f"))
        rest = each.join(first, "name").filter(~(F.col("f.d").eqNullSafe(F.col("d")) & (F.col("f.p") == F.col("p"))))
        found = found.union(rest.select("id", "p", F.lit(1).cast("bigint").alias("n")))
    return written, found


def _spans(rows: dict[str, np.ndarray], size: int) -> np.ndarray:
    """Removed runs (start, end), maximal, in order."""
    p, end = rows["p"], rows["p"] + rows["n"] - 1 + LENGTH
    if not len(p):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(p, kind="stable")
    p, reach = p[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], p[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)
    return np.stack([p[new], np.minimum(reach[last], size)], axis=1)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", many: int = MANY, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and, on demand, ``kept`` (the remaining bytes)."""
    written, found = repeated(docs.select(col(doc_id).alias("d"), col(text).alias("t")), many)
    folder = _by_part(found, "strings-found")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(batch: pd.DataFrame) -> Iterator[tuple]:
            for _, _, raw, mine in _with_rows(folder, ["id", "p", "n"], iter([batch])):
                spans = _spans(mine, len(raw)).tolist()
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                yield len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), *([left] if with_text else [])

        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
        for batch in batches:
            out = pd.DataFrame(list(rows(batch)), columns=names)
            out.insert(0, doc_id, batch["d"].to_numpy())
            yield out

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return written.mapInPandas(cut, schema)
