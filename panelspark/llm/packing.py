"""Packing documents into sequences of a fixed number of tokens, by bin completion.

Every document becomes its token ids and an end id; only longer ones than a sequence are cut, into
full pieces behind a first one of the rest.  A packing depends on the lengths alone, and a
length is between 1 and the capacity, so what is searched is the table of lengths and their
numbers (one row per length, however many documents there are).  The result is a list of
fillings, each with the number of sequences made of it; a piece finds its place
from its rank among the pieces of its length, which comes from prefix sums over tasks.

Bin completion: the largest length left gets a filling of the room beside it.  Fillings come in the
order of their waste; one that could take a left length in the place of none, one or two of its own
without more room is dominated and passed over (so a length that fills the room exactly is the only one).
A filling is used as often as the numbers allow, the last ``FEW`` pieces one sequence at a time.  The branches are explored depth first; one ends
where its waste, with the room that no left length can fill, would take as many sequences as the best packing known, which at
first is that of best fit on decreasing lengths.  The search ends at the lower bound (of
the sum and of what can't share a sequence), or after ``NODES`` decisions with the best packing found.

Defined results: null and empty texts are the end id alone; rows with null or equal ids are packed like
others; an empty table gives no row; other columns are not read.  Sequence numbers are gapless from 0.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, staged

CAPACITY = 2048
END_ID = 0
# Decisions of the branch and bound, fillings tried for one, and pieces left from which a filling is used once a
# decision, so that the search is whole.
NODES = 6_000
FILLINGS = 12
FEW = 48
# Distinct pieces of text a worker remembers, and characters encoded together.
REMEMBERED = 800_000
_TEXT_BLOCK = 1 << 23
# A space is a safe place to cut a text if what follows is surely no space itself: the tokenizer's pattern
# then starts a piece at it.  Other spaces stay inside a piece, which is always right.
_UNSURE = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
_UNSURE_SPACE = re.compile(f" (?=[{_UNSURE}]|$)")
_SURE_SPACE = re.compile(f" (?=[^{_UNSURE}])")


class Encoder:
    """Ids of texts under a byte-level vocabulary whose pieces start at a space, each distinct piece encoded once for a while."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level vocabulary writes every byte as one character
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        # pieces at a text's beginning, and pieces behind a space; 0 is no piece, 1 the end of a document
        self.first: dict[str, int] = {"": 0}
        self.later: dict[str, int] = {}
        self.n = 2
        self.flat = np.zeros(1 << 16, np.uint32)
        self.flat[0] = self.end_id
        self.starts = np.zeros(1 << 14, np.int64)
        self.starts[2] = 1

    def _ids(self, pieces: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without added tokens, each behind ``space``, one after another, and their numbers."""
        if space:
            # the pattern cuts at these spaces in any text, so one text holds all pieces; a token's bytes tell whose it is
            ids = np.array(self.tokenizer.encode_batch_fast([space + space.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
            at = np.cumsum(self.n_bytes[ids])
            upto = np.searchsorted(at, ends) + 1
            if len(at) and (at[upto - 1] == ends).all():
                return ids, np.diff(upto, prepend=0)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([space + p for p in pieces], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _learn(self, known: dict[str, int], pieces: list[str], space: str) -> None:
        known.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        for i in range(0, len(pieces), 20_000):
            ids, length = self._ids(pieces[i : i + 20_000], space)
            used, more = int(self.starts[self.n]), len(length)
            total = used + len(ids)
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
            if self.n + more >= len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), more + 1), np.int64)])
            self.flat[used:total] = ids
            self.starts[self.n + 1 : self.n + 1 + more] = used + np.cumsum(length)
            self.n += more

    def _numbers(self, known: dict[str, int], words: pa.Array, space: str) -> np.ndarray:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in known]
        if new:
            self._learn(known, new, space)
        of = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        return of[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and the starts (one more than texts)."""
        whole = {i: t for i, t in enumerate(texts) if any(a in t for a in self.added)}
        ids, at = self._by_pieces(["" if i in whole else t for i, t in enumerate(texts)])
        if not whole:
            return ids, at
        own = [ids[at[i] : at[i + 1]] for i in range(len(texts))]
        for i, t in whole.items():
            own[i] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, self.end_id], np.uint32)
        return np.concatenate(own), np.cumsum([0, *map(len, own)])

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > REMEMBERED:
            self._forget()
        if any(map(_UNSURE_SPACE.search, texts)):
            lists = pa.array([_SURE_SPACE.split(t) for t in texts], pa.large_list(pa.large_string()))
        else:
            lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = lists.flatten()
        begin = lists.offsets.to_numpy().astype(np.int64)
        begin -= begin[0]
        is_first = np.zeros(len(flat), bool)
        is_first[begin[:-1]] = True
        number = np.empty(len(flat), np.int64)
        number[begin[:-1]] = self._numbers(self.first, flat.take(pa.array(begin[:-1])), "")
        number[~is_first] = self._numbers(self.later, flat.filter(pa.array(~is_first)), " ")
        number = np.insert(number, begin[1:], 1)
        start = np.where(number > 0, self.starts[number], 0)
        length = np.where(number > 0, self.starts[number + 1] - self.starts[number], 0)
        to = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(to[-1]) + np.repeat(start - to[:-1], length)]
        return ids, to[np.concatenate([[0], begin[1:] + np.arange(1, len(begin))])]


_encoders: dict[tuple[str, int], Encoder] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones behind a first one of the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and the task's number with the piece's rank among those of its length there."""
    part, rank = "__part", "__rank"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, end_id) not in _encoders:
            _encoders[tokenizer, end_id] = Encoder(tokenizer, end_id)
        encoder, task, seen = _encoders[tokenizer, end_id], TaskContext.get().partitionId(), {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < _TEXT_BLOCK and i < len(texts) - 1:
                    continue
                ids, at = encoder.encode(texts[first : i + 1])
                ids, rows = ids.astype("<u4"), []
                for d in range(i + 1 - first):
                    for n, (s, length) in enumerate(cut(int(at[d + 1] - at[d]), capacity)):
                        r = seen[length] = seen.get(length, -1) + 1
                        rows.append((first + d, n, s, length, zlib.crc32(ids[at[d] + s : at[d] + s + length]), r))
                of, n, s, length, crc, r = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of)), pa.array(n, pa.int32()), pa.array(s, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(n), pa.int32()), pa.array(r, pa.int64())],
                    names=[doc_id, "piece", "start", "length", "ids_crc32", part, rank],
                )
                first, size = i + 1, 0

    kind = docs.schema[doc_id].dataType.simpleString()
    quoted = doc_id.replace("`", "``")
    return docs.select(col(doc_id), col(text)).mapInArrow(
        encode, f"`{quoted}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, {part} int, {rank} bigint"
    )


@dataclass
class Filling:
    """``times`` sequences that each hold ``lengths`` ((length, copies), from the largest)."""

    lengths: list[tuple[int, int]]
    times: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum, and for every bound k by the lengths above capacity - k, which
    share with none of at least k, and those above half, which don't share with one another."""
    by = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        by[length] = n
    number, total = np.cumsum(by), np.cumsum(by * np.arange(capacity + 1))
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        alone = int(number[-1] - number[capacity - k])
        large = int(number[capacity - k] - number[half])
        room = large * capacity - int(total[capacity - k] - total[half])
        small = int(total[half] - total[k - 1])
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best fit on decreasing lengths, equal pieces together: rooms are kept by size, each with its fillings."""
    rooms: dict[int, list[Filling]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in rooms if r >= length):
            # the tightest rooms first; what they still hold beyond one copy comes back as a smaller room
            at: int | None = room
            while left and at is not None and at >= length:
                groups, after = rooms.pop(at, []), []
                while groups and left:
                    g = groups.pop()
                    n = min(g.times, left)
                    if n < g.times:
                        groups.append(Filling(g.lengths, g.times - n))
                    own = dict(g.lengths)
                    own[length] = own.get(length, 0) + 1
                    after.append(Filling(sorted(own.items(), reverse=True), n))
                    left -= n
                if groups:
                    rooms[at] = groups
                if after:
                    rooms.setdefault(at - length, []).extend(after)
                at = at - length if after else None
        if left:
            fit = capacity // length
            full, rest = divmod(left, fit)
            for copies, times in ((fit, full), (rest, 1)):
                if copies and times:
                    rooms.setdefault(capacity - copies * length, []).append(Filling([(length, copies)], times))
    return [g for groups in rooms.values() for g in groups]


def _fillings(lengths: list[int], left: list[int], room: int, slack: int, most: int) -> Iterator[list[tuple[int, int]]]:
    """At most ``most`` undominated fillings of ``room`` by ``left[i]`` pieces of ``lengths[i]`` (decreasing), those of least waste first
    and up to a waste of ``slack``; a filling is a list of (index, copies), larger lengths first."""
    usable = [i for i in range(bisect_left(lengths, -room, key=lambda x: -x), len(lengths)) if left[i]]
    if not usable:
        yield []
        return
    if lengths[usable[0]] == room:
        yield [(usable[0], 1)]  # it dominates every other filling
        return
    mask = (1 << (room + 1)) - 1
    # reach[j]: sums that usable[j:] can make
    reach = [1] * (len(usable) + 1)
    for j in range(len(usable) - 1, -1, -1):
        length = lengths[usable[j]]
        sums, n, step = reach[j + 1], min(left[usable[j]], room // length), 1
        while n:
            take = min(step, n)
            sums |= (sums << (take * length)) & mask
            n -= take
            step *= 2
        reach[j] = sums
    here = 0
    for i in usable:
        here |= 1 << lengths[i]

    def dominated(found: list[tuple[int, int]], waste: int) -> bool:
        """Whether a left length could stand for none, one or two of the filling's pieces within the waste."""
        free = here
        for i, copies in found:
            if left[i] == copies:
                free &= ~(1 << lengths[i])
        single = [lengths[i] for i, _ in found]
        pairs = {a + b for n, a in enumerate(single) for b in single[n + (found[n][1] < 2) :]}
        window = (1 << waste) - 1
        return any(free >> (s + 1) & window for s in {0, *single, *pairs}) or any(free >> s & 1 for s in pairs if s not in single)

    def grow(j: int, rest: int, found: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        if not rest:
            yield list(found)
            return
        for k in range(j, len(usable)):
            if not reach[k] >> rest & 1:
                return
            length = lengths[usable[k]]
            if length > rest:
                continue
            for copies in range(min(left[usable[k]], rest // length), 0, -1):
                after = rest - copies * length
                if reach[k + 1] >> after & 1:
                    found.append((usable[k], copies))
                    yield from grow(k + 1, after, found)
                    found.pop()

    given = tried = 0
    for waste in range(min(slack, room - 1) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        for found in grow(0, room - waste, []):
            tried += 1
            if not dominated(found, waste):
                yield found
                given += 1
            if given == most or tried == 4 * most:
                return


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, fillings: int = FILLINGS) -> list[Filling]:
    """A packing of ``counts`` (pieces by length) in as few sequences as the search finds."""
    counts = {length: n for length, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    n_best = sum(f.times for f in best)
    least = lower_bound(counts, capacity)
    total = sum(length * n for length, n in counts.items())
    lengths = sorted(counts, reverse=True)
    left = [counts[length] for length in lengths]
    path: list[tuple[int, list[tuple[int, int]], int]] = []
    budget = nodes

    def top(at: int) -> int:
        while at < len(left) and not left[at]:
            at += 1
        return at

    def choices(at: int, waste: int) -> Iterator[list[tuple[int, int]]]:
        left[at] -= 1
        now = list(left)
        left[at] += 1
        return _fillings(lengths, now, capacity - lengths[at], max((n_best - 1) * capacity - total - waste, 0), fillings)

    # depth first with an explicit stack: a step is (position, its untried fillings, waste, sequences and pieces before it)
    at = top(0)
    n_left = sum(left)
    stack = [(at, choices(at, 0), 0, 0, 0)]
    while stack and budget > 0 and n_best > least:
        at, untried, waste, used, done = stack[-1]
        if len(path) == len(stack):  # the filling tried last did not do: take it back
            undo_at, filling, times = path.pop()
            left[undo_at] += times
            for i, copies in filling:
                left[i] += copies * times
        filling = next(untried, None)
        if filling is None:
            stack.pop()
            continue
        budget -= 1
        lost = capacity - lengths[at] - sum(lengths[i] * c for i, c in filling)
        need = {at: 1}
        for i, c in filling:
            need[i] = need.get(i, 0) + c
        times = min(left[i] // c for i, c in need.items())
        if n_left - done <= FEW:
            times = 1
        if lost:
            # as often as the waste allows, so that the rest may be filled in another way
            spare = (n_best - 1) * capacity - total - waste
            if lost > spare:
                path.append((at, filling, 0))
                continue
            times = max(1, min(times, spare // lost))
        for i, c in need.items():
            left[i] -= c * times
        path.append((at, filling, times))
        waste, used, done = waste + lost * times, used + times, done + times * sum(need.values())
        after, last = top(at), len(left) - 1
        if after == len(left):
            if used < n_best:
                n_best = used
                best = [Filling(sorted(_merged([(lengths[a], 1), *((lengths[i], c) for i, c in f)]), reverse=True), n) for a, f, n in path if n]
            stack.append((after, iter(()), waste, used, done))
            continue
        # room that no left length can fill is wasted in any case
        while not left[last]:
            last -= 1
        sure, i = 0, after
        while i < len(left) and capacity - lengths[i] < lengths[last]:
            sure += (capacity - lengths[i]) * left[i]
            i += 1
        if waste + sure > (n_best - 1) * capacity - total:
            stack.append((after, iter(()), waste, used, done))
            continue
        stack.append((after, choices(after, waste), waste, used, done))
    return best


def _merged(lengths: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: dict[int, int] = {}
    for length, n in lengths:
        out[length] = out.get(length, 0) + n
    return list(out.items())


def slots(packing: list[Filling]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, copies a sequence, offset of the first copy) in the order of ranks."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for f in packing:
        offset = 0
        for length, copies in f.lengths:
            rows.setdefault(length, []).append((ranks.get(length, 0), sequence, copies, offset))
            ranks[length] = ranks.get(length, 0) + copies * f.times
            offset += length * copies
        sequence += f.times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    nodes: int = NODES,
    fillings: int = FILLINGS,
) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = staged(pieces(docs, tokenizer, text, doc_id, capacity, end_id), "pieces")
    by_task = staged(cut_up.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row per length
    where = slots(complete(counts, capacity, nodes, fillings))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    bases = by_task.select(
        F.col("__part").alias("__p"), F.col("length").alias("__l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")
    )
    ranked = cut_up.join(bases, (F.col("__part") == F.col("__p")) & (F.col("length") == F.col("__l")))
    names = [c for c in cut_up.columns if not c.startswith("__")]
    sequence, offset = fresh(cut_up, "sequence_id", "offset")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__base").to_numpy() + batch.column("__rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order], append=-1)) + 1
            first = 0
            for end in ends:
                rows = order[first:end]
                first = end
                size = int(length[rows[0]])
                slot = where[size][np.searchsorted(where[size][:, 0], rank[rows], side="right") - 1]
                nth = rank[rows] - slot[:, 0]
                seq[rows] = slot[:, 1] + nth // slot[:, 2]
                off[rows] = slot[:, 3] + nth % slot[:, 2] * size
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(off)], names=[*names, sequence, offset])

    kind = docs.schema[doc_id].dataType.simpleString()
    quoted = doc_id.replace("`", "``")
    return ranked.select(*[col(c) for c in names], "__base", "__rank").mapInArrow(
        place, f"`{quoted}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, {sequence} bigint, {offset} bigint"
    )
