"""Packing, the conversation trie and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm import convtrie, negatives, packing
from panelspark.llm.tokens import public_tokenizer

from tests.llm.corpus import clashing, frame


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def _same(df, expected):
    assert sorted((tuple(r) for r in df.collect()), key=_key) == sorted(expected, key=_key)


# ---- packing


def _optimum(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + items[k] <= capacity}.values():
            go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def _count(packed) -> Counter:
    out = Counter()
    for f in packed:
        for length, copies in f.lengths:
            out[length] += copies * f.times
    return out


def test_bin_completion_is_optimal_on_small_tables():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([10, 20, 37, 100])
        items = [rng.randint(1, rng.choice([capacity, capacity // 2 + 1, capacity // 3 + 1])) for _ in range(rng.randint(1, 10))]
        packed = packing.complete(dict(Counter(items)), capacity)
        assert _count(packed) == Counter(items)
        assert all(sum(a * b for a, b in f.lengths) <= capacity for f in packed)
        n = sum(f.times for f in packed)
        assert n == _optimum(items, capacity) >= packing.lower_bound(dict(Counter(items)), capacity)


@pytest.mark.parametrize("top", [2048, 900])
def test_bin_completion_beats_best_fit_on_large_tables(top):
    rng = random.Random(2)
    counts = dict(Counter(min(top, max(2, int(rng.lognormvariate(6.3, 0.8)))) for _ in range(5000)))
    packed, plain = packing.complete(counts), packing.best_fit(counts, 2048)
    assert _count(packed) == _count(plain) == Counter(counts)
    assert packing.lower_bound(counts, 2048) <= sum(f.times for f in packed) <= sum(f.times for f in plain)
    assert sum(f.times for f in packed) <= 1.002 * packing.lower_bound(counts, 2048)


def test_tables_without_pieces_and_with_full_ones():
    assert packing.complete({}) == []
    assert sum(f.times for f in packing.complete({2048: 1_000_000, 1024: 3})) == 1_000_002
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert packing.cut(1, 2048) == [(0, 1)]


ODD = [
    "", "  ", " a", "a  b", "a \n b", "x y z  　w", "it's  we're 'll", "tab\t\tb c\n\n d", " ", "\n", "a ", "a  <|endoftext|> b", "<|endoftext|>",
    "end <|endofte", "é  ü ﻿ z \x1c q", "\x85 a \x85 b", "1 23  456 a1", "é ́x ​ y", "\U0001f600 \U0001f600", "so   \r\n  much\fspace",
]


def test_packing_encoder_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizer(spark, "byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids, at = packing.Encoder(path).encode(ODD)
    for i, text in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0], repr(text)


@pytest.mark.parametrize("make", [frame, clashing])
def test_pack(spark, make):
    from tokenizers import Tokenizer

    path = public_tokenizer(spark, "byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = make(spark)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for n, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            expected.append((r["doc_id"], n, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    packed = packing.pack(docs, path).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = [tuple(None if x != x else int(x) for x in r) for r in packed[names].itertuples(index=False)]
    assert sorted(got, key=_key) == sorted(expected, key=_key)
    assert sorted(set(packed.sequence_id)) == list(range(packed.sequence_id.nunique()))
    for _, one in packed.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum()[:-1]] and one.length.sum() <= 2048
    assert packed.sequence_id.nunique() == packing.lower_bound(dict(Counter(packed.length)), 2048)


def test_pack_an_empty_table(spark):
    assert packing.pack(frame(spark, []), public_tokenizer(spark, "byte_bpe_50k.json")).collect() == []


# ---- trie

CONV = "conv_id bigint, turn bigint, role string, text string"


def brute_trie(rows, group=100, most=6):
    def key(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())

    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    original = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=key)] for c, rs in by.items()}
    members, built = defaultdict(list), {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = original.get(c - c % group, [])[:h] + own[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1] if p else "") + sum(saved[k] for k in kids[p])
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _conversations():
    rng, rows = random.Random(1), []
    for c in [*range(30), 100, 101, 150, 205, 207, 208, *range(300, 320)]:
        for i in range(40 if c == 5 else rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else ("user", "assistant")[i % 2]
            text = f"t{c % 3}{i}" if rng.random() < 0.85 else rng.choice(["x", "y\U0001f600", None, ""])
            rows.append((c, i if rng.random() > 0.05 else None, role, text))
    return [*rows, (None, 1, "user", "b"), rows[3], rows[3], (206, 0, None, None), (400, 0, "user", "z" * 50_000)]


@pytest.mark.parametrize("chunk", [4096, 4])
def test_prefix_trie(spark, chunk):
    rows = _conversations()
    _same(convtrie.prefix_trie(spark.createDataFrame(rows, CONV), chunk=chunk), brute_trie(rows))


def test_prefix_trie_of_copies_and_clashing_names(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(700, 760) for t in range(3)]
    df = spark.createDataFrame([(*r, 1, "o", 5) for r in rows], CONV + ", a int, owner string, `n` int")
    _same(convtrie.prefix_trie(df), brute_trie(rows))


def test_prefix_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    assert convtrie.prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    c = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 > 0)
    _same(convtrie.prefix_trie(spark.createDataFrame([(c, 0, "user", "gone")], CONV)), brute_trie([(c, 0, "user", "gone")]))


def test_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for a, b, f in df.select("a", "b", convtrie.fattest(df.a, df.b)).collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


# ---- hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_negatives(rows, relabel=7):
    kept = []
    for place, (i, v, y) in enumerate(rows):
        if y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i is not None and i % relabel == 0 else y
        kept.append((place, i, y, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]))
    out = []
    rank = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for place, i, y, v in kept:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, z) for p, j, z, w in kept if p != place]
        for ps, pid, _ in sorted((r for r in scored if r[2] == y), key=rank)[:5]:
            fits = [r for r in scored if r[2] != y and 50 * ps <= 100 * r[0] <= 95 * ps]
            out += [(i, pid, n, nid, ps, ns) for n, (ns, nid, _) in enumerate(sorted(fits, key=rank)[:3], 1)]
    return out


def _vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.2, 0.3) for _ in range(9)], rng.randint(0, 3)) for i in range(160)]
    rows += [(i, rows[3][1], i % 4) for i in range(160, 230)]  # one vector many times
    rows += [
        (50, rows[50][1], rows[50][2]), (50, rows[50][1], rows[50][2]),  # repeated anchor
        (None, rows[8][1], 1), (231, None, 1), (232, [0.1, None] + [0.0] * 7, 1), (233, [float("nan")] * 9, 2),
        (234, [float("inf")] * 9, 2), (235, rows[9][1], None), (236, [], 1), (237, [1.0, 2.0], 1), (250, [-1.0] * 9, 1), (300, [0.0] * 9, 2),
    ]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "anchor_block": 2, "run": 3}])
def test_hard_negatives(spark, sizes):
    rows = _vectors()
    df = spark.createDataFrame(rows, VECTORS)
    _same(negatives.hard_negatives(df, relabel=7, **sizes), brute_negatives(rows))


def test_hard_negatives_of_awkward_tables(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), relabel=7).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 2)], VECTORS)).collect() == []
    rows = _vectors()[:60]
    wide = spark.createDataFrame([(*r, 1, b"x", 2) for r in rows], VECTORS + ", block int, matrix binary, `place` int")
    _same(negatives.hard_negatives(wide, relabel=7), brute_negatives(rows))
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], VECTORS))


def test_strassen():
    rng = np.random.default_rng(3)
    for m, k, n in [(1, 1, 1), (9, 64, 30), (33, 17, 65), (0, 5, 7), (40, 1, 40), (64, 64, 64)]:
        a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
        assert (negatives.strassen(a, b) == a @ b).all()
