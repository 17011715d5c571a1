"""Vectorised text kernels: words, shingles, minimum hashes, union-find. Numpy only; no Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed in one go; longer texts are cut at white space.
CHUNK = 1 << 18
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_R = 0x9E3779B97F4A7C15
_PLACE = [int(x) | 1 for x in _RNG.integers(1, 2**63, 16, dtype=np.uint64)]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i up to n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", _R), ("down", pow(_R, -1, 2**64))):
            row = np.full(size, base, dtype=U)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data; first: positions at which a text begins."""
    solid = ~_WS[data]
    gap = ~solid
    fresh = np.zeros(len(data) + 1, bool)
    fresh[first] = True
    fresh[-1] = True
    start = solid.copy()
    start[1:] &= gap[:-1] | fresh[1:-1]
    stop = solid.copy()
    stop[:-1] &= gap[1:] | fresh[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[e] - total[s]) * down[s]
    return s, mix(h + (e - s).astype(U) * U(_PLACE[0]))


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, CHUNK bytes at a time."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            back = np.flatnonzero(_WS[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # a word longer than a chunk
                while end < n and not _WS[data[end]]:
                    more = np.flatnonzero(_WS[data[end : end + CHUNK]])
                    end = end + int(more[0]) if len(more) else min(n, end + CHUNK)
                word = hashlib.blake2b(data[at:end].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(word, U))
                at = end
                continue
        out.append(_hash_words(data[at:end], np.zeros(1, np.int64))[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def doc_words(column: pa.Array, lower: bool) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order; a word is a longest run without bytes 9-13 and 32."""
    raw, off = text_bytes(column)
    n, i = len(column), 0
    while i < n:
        j = i + 1
        while j < n and off[j + 1] - off[i] <= CHUNK:
            j += 1
        data = raw[off[i] : off[j]]
        if lower:
            data = _LOWER[data]
        if j == i + 1 and len(data) > CHUNK:
            yield _long(data)
        elif not len(data):
            for _ in range(i, j):
                yield np.zeros(0, U)
        else:
            s, h = _hash_words(data, off[i:j] - off[i])
            cut = np.searchsorted(s, off[i : j + 1] - off[i])
            for k in range(j - i):
                yield h[cut[k] : cut[k + 1]]
        i = j


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct shingles of a text; of fewer words, the whole sequence as one; of none, none."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.zeros(n - k + 1, U)
    for i in range(k):
        out += words[i : n - k + 1 + i] * U(_PLACE[i + 1])
    return np.unique(mix(out + U(k if n < size else 0)))


class MinHash:
    """Minimum hashes of shingle sets under n independent functions."""

    def __init__(self, n: int, seed: int = 1):
        r = np.random.Generator(np.random.PCG64(seed))
        self.a = r.integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)
        self.b = r.integers(0, 2**63, n, dtype=np.uint64) * U(2)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), U(2**64 - 1))
        for i in range(0, len(s), 512):
            np.minimum(out, (s[i : i + 512, None] * self.a + self.b).min(axis=0), out=out)
        return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b join it with."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new
