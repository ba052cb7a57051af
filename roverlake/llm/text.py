"""Whole-batch text kernels in numpy: words, hashes and shingles of many texts at once.

A batch of texts is one byte buffer with offsets (the Arrow layout), so each
kernel is a handful of array passes and no Python loop over words. ``pieces``
cuts a batch so that the temporary arrays stay small; a text is never cut.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
# Any odd 64-bit constants do; these are the fractional bits of the golden
# ratio and the two multipliers of the public-domain splitmix64 finaliser.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """An independent 64-bit hash of each element for each seed."""
    with np.errstate(over="ignore"):
        return mix(x + GOLDEN * np.uint64((seed + 1) & 0xFFFFFFFF))


def uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(texts: pa.Array, size: int = PIECE_BYTES):
    """Cut a batch into runs of whole texts of about ``size`` bytes: (first, last+1)."""
    _, off = buffers(texts)
    first = 0
    n = len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


class _Powers:
    """p^i and p^-i modulo 2^64, grown on demand (p odd, so it has an inverse)."""

    def __init__(self) -> None:
        self.p = int(MIX1) | 1
        self.inv = pow(self.p, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES)
            for name, base in (("up", self.p), ("down", self.inv)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


POWERS = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; equal bytes give equal hashes."""
    up, down = POWERS.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes()[data] * up[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    """ASCII letters, digits, underscore and every byte of a longer UTF-8 sequence."""
    ok = np.zeros(256, bool)
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
        ok[c] = True
    ok[128:] = True
    return ok


class Words:
    """The words of a batch of texts, lower-cased: runs of letters and digits."""

    __slots__ = ("data", "offsets", "starts", "ends", "doc", "hashes", "first")

    def __init__(self, texts: pa.Array, keep: np.ndarray | None = None, lower: bool = True) -> None:
        if lower:
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.combine_chunks()
            texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        self.data, self.offsets = buffers(texts)
        n = len(self.data)
        inside = (_word_bytes() if keep is None else keep)[self.data]
        left = np.empty(n, bool)
        left[1:] = ~inside[:-1]
        edge = self.offsets[:-1][self.offsets[:-1] < n]
        if n:
            left[0] = True
        left[edge] = True
        right = np.empty(n, bool)
        right[:-1] = ~inside[1:]
        if n:
            right[-1] = True
        right[edge[edge > 0] - 1] = True
        self.starts = np.flatnonzero(inside & left)
        self.ends = np.flatnonzero(inside & right) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        #: first word of each text, and one past the last at the end
        self.first = np.searchsorted(self.doc, np.arange(len(self.offsets)))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of ``size`` words inside one text."""
    h, n = words.hashes, len(words.hashes)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(words.doc[:n - size + 1] == words.doc[size - 1:])
    return run_hashes(h, at, size), at


def run_hashes(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[at:at+size] for each position."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out + h[at + k] + GOLDEN * np.uint64(k + 1))
    return out


def word_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles; a text of fewer than ``size`` words (but one
    at least) has a single shingle of all its words."""
    hashes, at = shingles(words, size)
    doc = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return hashes, doc
    extra, owner = [], []
    for k in range(1, size):
        some = short[counts[short] == k]
        extra.append(seeded(run_hashes(words.hashes, words.first[some], k), k))
        owner.append(some)
    hashes = np.concatenate([hashes, *extra])
    doc = np.concatenate([doc, *owner])
    order = np.argsort(doc, kind="stable")
    return hashes[order], doc[order]


def occurrence(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) with counts: (text, key, count), sorted by text then key."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    if not len(k):
        return d, k, np.empty(0, np.int64)
    new = np.empty(len(k), bool)
    new[0] = True
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], k[at], np.diff(np.append(at, len(k)))
