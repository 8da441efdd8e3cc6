"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeated_strings(rows, length=100):
    """rows of (doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, sha256 of the rest)."""
    docs = [(d is None, d or 0, (t or "").encode()) for d, t in rows]
    seen = {}
    for none, d, b in docs:
        for p in range(len(b) - length + 1):
            key = b[p : p + length]
            seen[key] = min(seen.get(key, (none, d, p)), (none, d, p))
    out = []
    for none, d, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < (none, d, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((None if none else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def base_secrets(text):
    """(n_assign, n_access, n_hex, base spans joined)."""
    t = text or ""
    name = "".join
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [[], [], []]
    spans[0] = [m.span() for m in assign.finditer(t) if len(m[2]) >= 8]
    spans[1] = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    spans[2] = [m.span() for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 32]
    every = sorted((a, k, b) for k, found in enumerate(spans) for a, b in found)
    kinds = ("assign", "access", "hex")
    return (*map(len, spans), name(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in every)))


def crc(text):
    return zlib.crc32((text or "").encode())


def similar(rows, threshold=0.8, size=5):
    """Class of every text by plain Jaccard similarity of its word shingles."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else {()})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def contaminated(text, items):
    """Whether words under windows of 13 of the items are a twentieth of the words or more."""

    def cut(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = set()
    for item in items:
        w = cut(item)
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))} if w else set()
    w = cut(text)
    hit = {j for x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x for j in range(i, i + len(x))}
    return bool(hit) and 20 * len(hit) >= len(w)
