"""Word and shingle hashes of whole texts, computed by numpy over Arrow's own buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PART = 1 << 19
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = 0xD1342543DE82EF95


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [_BASE] * (n - 1), np.uint64), dtype=np.uint64)


_POW = _powers(4096)


def powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = _powers(2 * n)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the n + 1 offsets of their ends."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return bytes_, ends - ends[0]


def _hash_part(data: np.ndarray, inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the words whose first bytes ``first`` marks; ``inside``: bytes of words."""
    own = data[inside]
    if not len(own):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(first[inside])
    lengths = np.diff(np.append(starts, len(own)))
    place = np.arange(len(own)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_BYTE[own] * powers(int(lengths.max()))[place], starts) + lengths.astype(np.uint64))


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and the accented capitals U+00C0 to U+00DE in UTF-8 bytes."""
    out = LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = True, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes outside ``spaces``, A-Z lower-cased) and the n + 1 offsets of each text's words.

    Worked off in parts of half a megabyte, cut at white space, so memory beside the
    hashes stays bounded unless one word is longer.
    """
    inside = ~spaces[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    first[edges] = inside[edges]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=sums[1:])
    hashes, at = [], 0
    while at < len(data):
        to = min(len(data), at + PART)
        while to < len(data) and inside[to] and not first[to]:
            to += 1
        part = data[at:to]
        hashes.append(_hash_part(LOWER[part] if lower else part, inside[at:to], first[at:to]))
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), sums[ends]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; one of the whole sequence if it is shorter, none if it is empty."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            total = U(n)
            for w in words.tolist():
                total = mix(np.array([total * U(0x9E3779B97F4A7C15) + U(w)], np.uint64))[0]
            return np.array([total], np.uint64)
        sums = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            sums = sums * U(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
        return mix(sums)
