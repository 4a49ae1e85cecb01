"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 buffer of an Arrow string column, so one
pass over a batch costs a handful of numpy operations per byte and never
builds a Python object per word.  Batches are cut into chunks of whole
documents (``CHUNK_BYTES`` of text at a time, one longer document alone), so
memory is bounded by the longest document.

Null texts count as empty.  A word is a maximal run of bytes other than
``[\\x20\\x09-\\x0D]``; A-Z is lower-cased before hashing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Longest table of powers that a worker keeps.
KEPT_POWERS = 1 << 22

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(0x5EED)
#: Random odd 64-bit value of each byte, and the bases of the rolling hashes.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept, but for those of a very long text."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                have[done : done + step] = have[:step] * np.uint64(pow(int(base), done, 1 << 64))
                done += step
        if size <= KEPT_POWERS:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """Whole documents of a batch: rows ``first:last``, their bytes and bounds."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        yield Chunk(i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    per_doc: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray


def words(chunk: Chunk, lower: bool = True) -> Words:
    """Words of a chunk in order; ``bounds`` are the word indexes of each document."""
    data, size = chunk.data, len(chunk.data)
    if size == 0:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(chunk.n, np.int64), np.zeros(chunk.n + 1, np.int64), zero.astype(np.uint64))
    inside = ~_SPACE[data]
    before = np.zeros(size, dtype=bool)
    before[1:] = inside[:-1]
    cut = chunk.bounds[:-1]
    before[cut[cut < size]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(size, dtype=bool)
    after[:-1] = inside[1:]
    cut = chunk.bounds[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(start, chunk.bounds)
    with np.errstate(over="ignore"):
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(_BASE, size), out=sums[1:])
        h = mix((sums[end] - sums[start]) * powers(_BASE_INV, size)[start])
    return Words(start, end, np.diff(bounds), bounds, h)


def word_hash(word: str | bytes, lower: bool = True) -> int:
    """The hash that :func:`words` gives one word."""
    data = word.encode() if isinstance(word, str) else word
    chunk = Chunk(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return int(words(chunk, lower).hash[0])


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of one document, and their document.

    A document with fewer words (but at least one) gives its whole sequence as
    one gram.
    """
    n = len(w.hash)
    docs = np.repeat(np.arange(len(w.per_doc)), w.per_doc)
    out_h: list[np.ndarray] = []
    out_d: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        if n >= size:
            h = np.zeros(n - size + 1, dtype=np.uint64)
            for k in range(size):
                h = h * _GRAM + w.hash[k : n - size + 1 + k]
            same = docs[: n - size + 1] == docs[size - 1 :]
            out_h.append(h[same])
            out_d.append(docs[: n - size + 1][same])
        for d in np.flatnonzero((w.per_doc > 0) & (w.per_doc < size)):
            h1 = np.zeros(1, dtype=np.uint64)
            for x in w.hash[w.bounds[d] : w.bounds[d + 1]]:
                h1 = h1 * _GRAM + x
            out_h.append(h1 + w.per_doc[d].astype(np.uint64))
            out_d.append(np.array([d]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(out_h)), np.concatenate(out_d)


def gram_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each document, concatenated, and bounds."""
    h, d = grams(w, size)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(len(w.per_doc) + 1))


def binary_array(blob: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binary array over contiguous bytes of ``blob`` cut at ``bounds`` (elements)."""
    ends = (bounds * blob.itemsize).astype(np.int64)
    if ends[-1] < (1 << 31) - 1:
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(blob))])
    return pa.array([blob[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)], pa.binary())
