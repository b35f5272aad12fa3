"""Vectorised byte kernels shared by the Arrow-batch operators of this subpackage.

Every kernel works on the concatenated UTF-8 bytes of a slice of documents and an offsets array, in slices of
bounded size, so memory follows ``SLICE_BYTES`` (or the longest single document), never the Arrow batch.
Words are maximal runs of bytes outside {0x20, 0x09-0x0D}; no kernel ever joins bytes of two documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
#: Long texts are hashed in pieces of this many bytes, cut at a word separator.
BLOCK_BYTES = 1 << 21

U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_P, BLOCK_BYTES + 1)
_IPOW = _powers(_PINV, BLOCK_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, rows, bytes, offsets) for runs of rows of about ``limit`` bytes; null reads as the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j - i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """The words of a slice: document index, start and end byte, 64-bit hash; ``first`` has each document's first word."""

    __slots__ = ("doc", "end", "first", "hash", "start")

    def __init__(self, buf: np.ndarray, off: np.ndarray, hashed: bool = True):
        n = len(buf)
        inside = ~SPACE[buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.hash = span_hashes(buf, self.start, self.end) if hashed else None


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.  Spans are ascending and disjoint."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(end, base + BLOCK_BYTES, "right"))
        if j <= i:  # one span longer than a block: hash its pieces and chain them
            h = 0
            for at in range(base, int(end[i]), BLOCK_BYTES):
                piece = buf[at : min(at + BLOCK_BYTES, int(end[i]))]
                h = mix1(h * _P + int((_BYTE[piece] * _POW[: len(piece)]).sum(dtype=np.uint64)) + len(piece))
            out[i] = h
            i += 1
            continue
        part = buf[base : int(end[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POW[: len(part)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _IPOW[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay inside a document, with the index of their first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h *= U(_P)
        h += hashes[j : n - k + 1 + j]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(left[: n - k + 1] >= k)
    return mix(h[at]), at


def shingle_sets(words: Words, k: int):
    """The sorted distinct k-word shingle hashes of each document of a slice; fewer than k words form one shingle."""
    h, at = windows(words.hash, words.first, k)
    count = np.diff(words.first)
    edge = np.searchsorted(at, words.first)
    for d in range(len(count)):
        if count[d] >= k:
            yield np.unique(h[edge[d] : edge[d + 1]])
        elif count[d]:
            x = int(count[d]) * 0x1000193
            for w in words.hash[words.first[d] : words.first[d + 1]]:
                x = mix1(x * _P + int(w))
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def lengths_to_offsets(n) -> np.ndarray:
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return out


def list_array(values: pa.Array, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(lengths_to_offsets(sizes).astype(np.int32)), values)
