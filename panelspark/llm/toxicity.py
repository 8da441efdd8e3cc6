"""Toxicity scores from a bidirectional gated recurrent network.

A word enters the network as a hashed word vector (whose first entry starts as the
word's log-odds in the training sample) beside the mean of hashed vectors of its
character trigrams.  Two gated recurrent layers read a window of ``WINDOW`` words
from both ends, attention pools their states, and a linear unit gives a logit.  A
text is scored by all its overlapping windows (every ``STRIDE`` words); its score
is that of the highest.

Training is numpy on the driver, over a sample of labelled rows bounded by
``MAX_POSITIVE``, ``MAX_NEGATIVE`` and ``MAX_BYTES`` a text, taken in the order of a
hash of the id; only the text and the label are read.  Labels are of documents, so each
epoch learns from the window a document is judged by.  A fifth of the sample is
kept apart to place the cut-off.  Scoring is ``mapInPandas`` with the weights (about 2 MB) as a
broadcast variable, window by window in blocks, so that a text of any length is
scored whole.

Defined results: null and empty texts are one window without words; labels that are
null, or whose document is missing, teach nothing; without both classes in the
sample every score is the share of positive labels; repeated rows score alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

WINDOW, STRIDE = 32, 16
MAX_POSITIVE, MAX_NEGATIVE, MAX_BYTES = 1200, 1800, 32_768
HELD_OUT_MODULUS = 5
EPOCHS, BATCH, RATE = 12, 64, 0.01

WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 13
D_WORD, D_CHAR, HIDDEN, ATTENTION = 8, 8, 8, 8
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLOCK = 1 << 19  # characters of texts read together
_WINDOWS = 2048  # windows run together
_REMEMBERED = 300_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Words:
    """Distinct words as inputs: a word bucket, and character buckets in a row (``chars`` cut by ``ends``)."""

    word: np.ndarray
    chars: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(words: pa.Array) -> Words:
        bare = pc.utf8_lower(pc.ascii_trim(words, characters=_MARKS))
        raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in bare.to_pylist()]
        if not raw:
            return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        b = np.frombuffer(b"".join(raw) + b"\x00\x00", np.uint8).astype(np.uint64)
        length = np.array([len(r) for r in raw])
        ends = np.cumsum(length)
        starts = ends - length
        tri = b[:-2] * np.uint64(0x9E3779B1) + b[1:-1] * np.uint64(0x85EBCA77) * np.uint64(257) + b[2:] * np.uint64(0xC2B2AE3D) * np.uint64(65537)
        # the last two places of a word would reach into the next one
        inside = np.ones(len(tri), bool)
        inside[ends - 1] = False
        inside[np.maximum(ends - 2, starts)] = length < 3
        tri ^= tri >> np.uint64(29)
        tri *= np.uint64(0xBF58476D1CE4E5B9)
        tri ^= tri >> np.uint64(32)
        inside &= np.arange(len(tri)) < ends[-1]
        position = np.arange(len(tri)) - np.repeat(starts, length)
        powers = np.multiply.accumulate(np.full(int(length.max()), np.uint64(0x9E3779B97F4A7C15)))
        word = np.add.reduceat(b[:-2] * powers[position], starts)
        word ^= word >> np.uint64(33)
        word *= np.uint64(0xFF51AFD7ED558CCD)
        word ^= word >> np.uint64(33)
        kept = np.flatnonzero(inside)
        per = np.add.reduceat(inside.astype(np.int64), starts)
        return Words((word % np.uint64(WORD_BUCKETS)).astype(np.int64), (tri[kept] % np.uint64(CHAR_BUCKETS)).astype(np.int64), np.cumsum(per))


def split(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts by their number among them, and the end of each text."""
    lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    flat = lists.flatten().dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - int(lists.offsets[0].as_py())
    empty = pc.index(flat.dictionary, "").as_py() if len(flat.dictionary) else -1
    if empty >= 0:
        full = index != empty
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        index = index[full]
    return flat.dictionary, index, ends


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every window over the words of each text, and the text it is of."""
    begin = np.concatenate([[0], ends[:-1]])
    n = ends - begin
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(ends)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[doc] + nth * STRIDE
    return start, np.minimum(WINDOW, ends[doc] - start), doc


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    cut: float = 0.0

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        d, h = D_WORD + D_CHAR, HIDDEN
        p = {
            "word": rng.normal(0, 0.1, (WORD_BUCKETS, D_WORD)),
            "char": rng.normal(0, 0.1, (CHAR_BUCKETS, D_CHAR)),
            "wa": rng.normal(0, 0.3, (2 * h, ATTENTION)),
            "va": rng.normal(0, 0.3, ATTENTION),
            "wo": rng.normal(0, 0.3, 2 * h),
            "bo": np.zeros(1),
        }
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, d**-0.5, (d, 3 * h))
            p[f"u{way}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            p[f"b{way}"] = np.zeros(3 * h)
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: Words) -> np.ndarray:
        """Input vector of every distinct word, and one of zeros for the places past a window's end."""
        n = len(words.word)
        out = np.zeros((n + 1, D_WORD + D_CHAR), np.float32)
        if n:
            out[:n, :D_WORD] = self.p["word"][words.word]
            begin = np.concatenate([[0], words.ends[:-1]])
            per = np.maximum(words.ends - begin, 1)[:, None]
            out[:n, D_WORD:] = np.add.reduceat(self.p["char"][words.chars], begin, axis=0) / per
        return out

    def run(self, at: np.ndarray, proj: dict[str, np.ndarray], keep: bool = False):
        """Logits of windows ``at`` (windows x places; the number past the last word is
        no word).  ``proj``: projected inputs by direction.  ``keep`` returns the states too."""
        h = HIDDEN
        n, t_max = at.shape
        mask = (at != len(proj["f"]) - 1).astype(np.float32)
        states = np.zeros((t_max, n, 2 * h), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for way, order in (("f", range(t_max)), ("b", range(t_max - 1, -1, -1))):
            u, now = self.p[f"u{way}"], np.zeros((n, h), np.float32)
            lo = 0 if way == "f" else h
            for t in order:
                x = proj[way][at[:, t]]
                hu = now @ u
                gates = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                m = mask[:, t : t + 1]
                new = now + m * (1 - z) * (c - now)
                if keep:
                    trace[way].append((t, now, z, r, c, hu[:, 2 * h :], m))
                now = new
                states[t, :, lo : lo + h] = now
        att = np.tanh(states @ self.p["wa"])
        score = att @ self.p["va"] + (mask.T - 1) * 1e9
        score -= score.max(axis=0)
        weight = np.exp(score)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, states, att, weight, pooled, trace) if keep else logit

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: (x @ self.p[f"x{way}"] + self.p[f"b{way}"]).astype(np.float32) for way in "fb"}

    def gradients(self, at: np.ndarray, y: np.ndarray, words: Words) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows with labels ``y`` and its gradients."""
        h, p = HIDDEN, self.p
        x = self.inputs(words)
        proj = self.project(x)
        logit, states, att, weight, pooled, trace = self.run(at, proj, keep=True)
        prob = _sigmoid(logit)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d_logit = (prob - y).astype(np.float32) / len(y)
        g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", d_score, att)
        d_att = d_score[:, :, None] * p["va"] * (1 - att * att)
        g["wa"] = np.einsum("tnh,tna->ha", states, d_att)
        d_states = d_states + d_att @ p["wa"].T
        d_x = np.zeros_like(x)
        for way in "fb":
            lo = 0 if way == "f" else h
            u, d_now = p[f"u{way}"], np.zeros((at.shape[0], h), np.float32)
            g_u, d_proj = np.zeros_like(u), np.zeros_like(proj[way])
            for t, before, z, r, c, hc, m in reversed(trace[way]):
                d_new = d_now + d_states[t, :, lo : lo + h]
                dm = m * d_new
                d_c = dm * (1 - z) * (1 - c * c)
                d_z = dm * (before - c) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g_u += before.T @ d_hu
                d_now = d_new - dm * (1 - z) + d_hu @ u.T
                np.add.at(d_proj, at[:, t], np.concatenate([d_z, d_r, d_c], axis=1))
            d_proj[-1] = 0  # no word
            g[f"u{way}"], g[f"x{way}"], g[f"b{way}"] = g_u, x.T @ d_proj, d_proj.sum(axis=0)
            d_x += d_proj @ p[f"x{way}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words.word, d_x[:-1, :D_WORD])
        per = np.diff(np.concatenate([[0], words.ends]))
        np.add.at(g["char"], words.chars, np.repeat(d_x[:-1, D_WORD:] / np.maximum(per, 1)[:, None], per, axis=0))
        return loss, g


def _places(index: np.ndarray, start: np.ndarray, length: np.ndarray, none: int) -> np.ndarray:
    """The words of windows, one row each, ``none`` past their end."""
    step = np.arange(WINDOW)
    inside = step < length[:, None]
    at = np.full((len(start), WINDOW), none)
    if len(index):
        at = np.where(inside, index[np.minimum(start[:, None] + step, len(index) - 1)], none)
    return at


def logits(net: Network, index: np.ndarray, ends: np.ndarray, proj: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every window, and the text it is of."""
    start, length, doc = windows(ends)
    none = len(proj["f"]) - 1
    out = np.empty(len(start), np.float32)
    for i in range(0, len(start), _WINDOWS):
        s = slice(i, i + _WINDOWS)
        out[s] = net.run(_places(index, start[s], length[s], none), proj)
    return out, doc


def train(texts: list[str], toxic: np.ndarray, apart: np.ndarray, weight_negative: float, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fits the network on the texts that are not ``apart``, and the cut-off on those that are."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    vocabulary, index, ends = split(texts)
    words = Words.of(vocabulary)
    start, length, doc = windows(ends)
    fit = np.flatnonzero(~apart)
    y = toxic.astype(np.float32)
    # log-odds of words by the documents of the fitted part that have them, drawn to 0 where they are few
    of_word = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    seen = np.unique(np.stack([of_word, words.word[index]]), axis=1) if len(index) else np.zeros((2, 0), np.int64)
    seen = seen[:, ~apart[seen[0]]]
    n1 = np.bincount(seen[1], weights=y[seen[0]], minlength=WORD_BUCKETS)
    n0 = np.bincount(seen[1], weights=1 - y[seen[0]], minlength=WORD_BUCKETS)
    t1, t0 = y[fit].sum(), (1 - y[fit]).sum()
    odds = np.log((n1 + 2) / (t1 + 4)) - np.log((n0 + 2) / (t0 + 4))
    net.p["word"][:, 0] = np.clip(odds * (n1 + n0) / (n1 + n0 + 10), -3, 3)
    none = len(words.word)
    strong = np.append(net.p["word"][words.word, 0], -9.0)
    value = np.empty(len(start), np.float32)
    for i in range(0, len(start), _WINDOWS):
        s = slice(i, i + _WINDOWS)
        value[s] = strong[_places(index, start[s], length[s], none)].max(axis=1)
    first = np.searchsorted(doc, np.arange(len(ends)))
    last = np.searchsorted(doc, np.arange(len(ends)), side="right")
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            value, _ = logits(net, index, ends, net.project(net.inputs(words)))
        top = np.array([first[d] + int(value[first[d] : last[d]].argmax()) for d in fit])
        other = np.array([rng.integers(first[d], last[d]) for d in fit if not y[d]])
        chosen = np.concatenate([top, other]).astype(np.int64)
        rng.shuffle(chosen)
        rate = RATE * (0.5 if epoch > epochs * 2 // 3 else 1.0)
        for i in range(0, len(chosen), BATCH):
            w = chosen[i : i + BATCH]
            at = _places(index, start[w], length[w], none)
            used, near = np.unique(at, return_inverse=True)
            used = used[used != none]
            near = near.reshape(at.shape)  # no word is the greatest number, so it stays the last
            begin = np.concatenate([[0], words.ends[:-1]])
            per = words.ends[used] - begin[used]
            chars = words.chars[np.repeat(begin[used], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)]
            some = Words(words.word[used], chars, np.cumsum(per))
            _, g = net.gradients(near, y[doc[w]], some)
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * v
                s *= 0.999
                s += 0.001 * v * v
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    value, _ = logits(net, index, ends, net.project(net.inputs(words)))
    best = np.maximum.reduceat(value, first)
    judged = apart if apart.any() and 0 < y[apart].sum() < apart.sum() else np.ones(len(y), bool)
    net.cut = cut_off(best[judged], y[judged], weight_negative)
    return net


def cut_off(value: np.ndarray, y: np.ndarray, weight_negative: float) -> float:
    """The logit with the best F1 of positives, negatives weighted to their share in the corpus."""
    order = np.argsort(-value, kind="stable")
    hit = np.cumsum(y[order])
    miss = np.cumsum((1 - y[order]) * weight_negative)
    f1 = 2 * hit / (hit + miss + y.sum())
    i = int(f1.argmax())
    low = value[order[i + 1]] if i + 1 < len(order) else value[order[i]] - 1
    return float((value[order[i]] + low) / 2)


class Scorer:
    """Scores texts with remembered words."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.proj = {way: np.zeros((1 << 14, 3 * HIDDEN), np.float32) for way in "fb"}

    def _learn(self, new: list[str]) -> None:
        x = self.net.project(self.net.inputs(Words.of(pa.array(new, pa.large_string()))))
        first = len(self.known)
        for i, w in enumerate(new, first):
            self.known[w] = i
        for way, held in self.proj.items():
            if len(held) < len(self.known):
                self.proj[way] = held = np.concatenate([held, np.zeros((max(len(held), len(new)), held.shape[1]), np.float32)])
            held[first : len(self.known)] = x[way][:-1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > _REMEMBERED:
            self._forget()
        vocabulary, index, ends = split(texts)
        words = vocabulary.to_pylist()
        new = [w for w in words if w and w not in self.known]
        if new:
            self._learn(new)
        number = np.fromiter((self.known.get(w, 0) for w in words), np.int64, len(words))
        none = self.net.project(np.zeros((1, D_WORD + D_CHAR), np.float32))
        proj = {way: np.concatenate([self.proj[way][number], none[way]]) for way in "fb"}
        value, doc = logits(self.net, index, ends, proj)
        top = np.maximum.reduceat(value, np.searchsorted(doc, np.arange(len(ends))))
        return _sigmoid((top - self.net.cut).astype(np.float64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_MODULUS)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Network | float:
    """The network, or the share of positive labels where one class is missing."""
    known = labels.select(col(doc_id).alias("d"), col(label).alias("y")).filter("d IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("d")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("d")
    pick = [known.filter(F.col("y") == y).orderBy(order, "d").limit(n) for y, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    sample = pick[0].union(pick[1])  # at most MAX_POSITIVE + MAX_NEGATIVE rows
    rows = docs.select(col(doc_id).alias("d"), col(text).alias("t")).filter(F.octet_length("t") <= MAX_BYTES)
    taken = rows.join(F.broadcast(sample), "d").groupBy("d", "y").agg(F.min("t").alias("t")).toPandas().sort_values(["d", "y"])
    y = taken["y"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        return counts.get(1, 0) / max(sum(counts.values()), 1)
    apart = np.array([int(d) % HELD_OUT_MODULUS == 1 if isinstance(d, (int, np.integer)) else i % HELD_OUT_MODULUS == 1 for i, d in enumerate(taken["d"])])
    ratio = (counts[0] / max((y == 0).sum(), 1)) / (counts[1] / max((y == 1).sum(), 1))
    return train(taken["t"].tolist(), y, apart, ratio)


def score(docs: DataFrame, model: Network | float, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all but the text's own copy) with ``score`` and ``predicted``."""
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[col(c) for c in cols]).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        scorer = Scorer(net) if isinstance(net, Network) else None
        for batch in batches:
            texts, out, first, size = batch.iloc[:, -1].tolist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= _BLOCK or i == len(texts) - 1:
                    some = texts[first : i + 1]
                    out.append(scorer.score(some) if scorer else np.full(len(some), net))
                    first, size = i + 1, 0
            value = np.concatenate(out) if out else np.zeros(0)
            result = batch.iloc[:, :-1].copy()
            result.columns = cols
            result["score"] = value
            result["predicted"] = (value >= 0.5).astype(np.int32)
            yield result

    return docs.select(*[col(c) for c in cols], col(text).alias("__text")).mapInPandas(run, schema)
