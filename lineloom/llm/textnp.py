"""Vectorised word hashing over Arrow string columns.

Texts are read straight from Arrow's buffers in blocks of about a megabyte, so
memory stays near 30 bytes per byte of block (or of one longer text).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
AS_IS = np.arange(256, dtype=np.uint8)
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
_POWERS = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have


def give_back() -> None:
    """Hands freed memory to the system; Python workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about ``limit`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(raw: np.ndarray, off: np.ndarray, second: bool = False, space: np.ndarray = _SPACE, fold: np.ndarray = _LOWER):
    """Per word of the block: hash (A-Z lower-cased), start, end; and the word offsets of each text.

    With ``second``, an independent second hash comes after the first; ``space``
    tells which bytes are outside words, ``fold`` maps bytes before hashing.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.uint64)
        e = np.zeros(0, np.int64)
        return ((z, z) if second else (z,)) + (e, e, np.zeros(len(off), np.int64))
    solid = ~space[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    edges = off[1:-1]
    before[edges[edges < n]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    hashes = []
    if len(start):
        low = fold[raw].astype(np.uint64)
        low += np.uint64(1)
        low *= solid
        first = np.zeros(n, np.int64)
        first[start] = start
        place = np.arange(n) - np.maximum.accumulate(first)
        length = (end - start).astype(np.uint64)
        place[~solid] = 0
        longest = int(length.max())
        with np.errstate(over="ignore"):
            for base in (_B1, _B2)[: 2 if second else 1]:
                sums = np.add.reduceat(low * _powers(base, longest)[place], start)
                hashes.append(mix(sums ^ (length * _M2)))
    else:
        hashes = [np.zeros(0, np.uint64)] * (2 if second else 1)
    return (*hashes, start, end, np.searchsorted(start, off))


def chain(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive words from each index in ``first``."""
    with np.errstate(over="ignore"):
        acc = np.zeros(len(first), np.uint64)
        for k in range(size):
            acc = acc * _B2 + h[first + k]
        return mix(acc ^ np.uint64(size))
