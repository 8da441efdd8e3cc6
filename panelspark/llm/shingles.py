"""Word shingles of texts as arrays of 64-bit hashes, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SIZE = 5
# Texts are hashed together up to this many bytes; a longer text goes alone.
_BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and hashes of the words of a UTF-8 text."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    length = np.diff(np.append(starts, len(b)))
    longest = int(length.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    at = np.arange(starts[0], len(b)) - np.repeat(starts, length)
    value = (b[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers[at]
    value[space[starts[0] :]] = 0
    return starts, mix(np.add.reduceat(value, starts - starts[0]))


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbouring words."""
    count = len(h) - n + 1
    x = np.full(count, np.uint64(int(n) * int(_P) % (1 << 64)))
    for k in range(n):
        x = mix(x ^ h[k : k + count])
    return x


def shingles(texts: Sequence[str | None], size: int = SIZE) -> Iterator[np.ndarray]:
    """For every text the hashes of its shingles in order.  A text of fewer words
    than ``size``, but not none, is one shingle."""
    group: list[bytes] = []
    held = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if group and held + len(raw) > _BLOCK:
            yield from _group(group, size)
            group, held = [], 0
        group.append(raw)
        held += len(raw) + 1
    if group:
        yield from _group(group, size)


def _group(raws: list[bytes], size: int) -> Iterator[np.ndarray]:
    starts, h = word_hashes(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    cuts = np.searchsorted(starts, ends)
    every = _joined(h, size) if len(h) >= size else h[:0]
    first = 0
    for last in cuts:
        n = last - first
        yield every[first : last - size + 1] if n >= size else _joined(h[first:last], n) if n else h[:0]
        first = last
