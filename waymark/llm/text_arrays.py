"""Texts of one Arrow batch as flat numpy arrays.

The operators of this package that work on bytes or words share these helpers. A batch is
never copied per document: all texts lie in one byte array, cut by offsets. Words follow the
rule ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are turned into arrays at once. A single longer text is one piece.
PIECE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything but ASCII letters and the bytes of other alphabets.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of text, or one longer row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; a missing text is empty."""
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a multiply and xor-shift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    """Hashes of any byte range of an array in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n, _BASE, dtype=np.uint64)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data] * powers, out=self._sums[1:])
        inverse = np.full(n + 1, _INVERSE, dtype=np.uint64)
        inverse[0] = 1
        self._inverse = np.multiply.accumulate(inverse, out=inverse)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of every word; words never cross documents.

    ``separators`` marks the byte values that end a word.
    """
    solid = ~separators[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = solid[edges]
    inner = edges[edges > 0] - 1
    last[inner] = solid[inner]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(texts: pa.Array, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word, in order, and the n + 1 word offsets of the rows."""
    data, offsets = flat(texts)
    low = _LOWER[data]
    starts, ends, doc = words(low, offsets, separators)
    return PrefixHash(low).of(starts, ends), np.searchsorted(doc, np.arange(len(texts) + 1))


def windows(values: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each run of ``size`` values inside a row, and the row offsets of the runs.

    A row with fewer values, but at least one, gives the hash of its whole sequence.
    """
    counts = np.diff(offsets)
    full = np.maximum(counts - size + 1, 0)
    runs = np.where(counts > 0, np.maximum(full, 1), 0)
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(runs, out=out[1:])
    begin = np.repeat(offsets[:-1] - out[:-1], runs) + np.arange(out[-1])
    step = np.uint64(0xA24BAED4963EE407)
    hashes = np.zeros(len(begin), dtype=np.uint64)
    short = np.repeat(counts < size, runs)
    length = np.repeat(np.minimum(counts, size), runs)
    for i in range(size):
        at = begin + i
        if short.any():
            ok = i < length
            hashes[ok] = (hashes[ok] ^ values[at[ok]]) * step + (hashes[ok] >> np.uint64(29))
        else:
            hashes = (hashes ^ values[at]) * step + (hashes >> np.uint64(29))
    return mixed(hashes + length.astype(np.uint64)), out
