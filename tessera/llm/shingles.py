"""Word shingles as 64-bit hashes, computed with numpy over a whole batch of texts."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
#: Bytes that end a word: space and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ _U(seed)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and the number of words of each text.

    Words are runs of bytes that are not ASCII white space, with A-Z in lower case. A word's hash is a
    polynomial over its own bytes with the last byte at power 0, so that equal words hash alike anywhere.
    """
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) + 1 for b in blobs], dtype=np.int64)
    raw = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) and end[0] == 0:
        end = end[1:]
    ends = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.empty(0, dtype=np.uint64), counts
    length = end - start
    top = int(length.max())
    low, h = _LOWER[raw], np.zeros(len(start), dtype=np.uint64)
    powers = _powers(min(top, 64))
    for i in range(min(top, 64)):  # the i-th byte from the end of each word that has one
        at = np.flatnonzero(length > i)
        h[at] += (low[end[at] - 1 - i] + _U(1)) * powers[i]
    for w in np.flatnonzero(length > 64):  # rare long words: the rest of their bytes
        part = low[start[w] : end[w] - 64][::-1] + _U(1)
        h[w : w + 1] += np.sum(part * _powers(len(part)), dtype=np.uint64, keepdims=True) * _powers(65)[64:]
    return mix(h ^ (length.astype(np.uint64) << _U(40))), counts


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; fewer words than n make one shingle."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    salt = [mix(np.array([k + 1], dtype=np.uint64), 0xA5A5A5A5)[0] | _U(1) for k in range(n)]
    for c in counts:
        w = words[at : at + c]
        at += c
        if c == 0:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        m = min(n, c)
        total = np.zeros(c - m + 1, dtype=np.uint64)
        for k in range(m):
            total += w[k : c - m + 1 + k] * salt[k]
        out.append(np.unique(mix(total, m)))
    return out


def minhashes(sets: list[np.ndarray], k: int, seed: int = 7) -> np.ndarray:
    """k minimum hashes of each set that is not empty, as rows; empty sets get the largest value."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, size=k, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 2**63, size=k, dtype=np.uint64)
    out = np.full((len(sets), k), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i, s in enumerate(sets):
        for lo in range(0, len(s), 4096):
            part = s[lo : lo + 4096]
            h = part[None, :] * a[:, None] + b[:, None]
            h ^= h >> _U(32)
            np.minimum(out[i], h.min(axis=1), out=out[i])
    return out
