"""Words of many texts at once, with numpy on the bytes of an Arrow column.

A word is a maximal run of bytes that are not separators; A-Z count as a-z. Every word gets a
64-bit hash from prefix sums of ``code(byte) * base ** position``, so no Python object is made
per word. Texts are worked on in pieces of a fixed size cut between words, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = 1 << 18
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values (the finalizer of splitmix64)."""
    x = values ^ (values >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODES = mixed(_LOWER.astype(np.uint64) + np.uint64(1))

# Separators as tables over byte values.
_bytes = np.arange(256)
BLANKS = (_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D))
NON_WORDS = (
    (_bytes <= 0x2F)
    | ((_bytes >= 0x3A) & (_bytes <= 0x40))
    | ((_bytes >= 0x5B) & (_bytes <= 0x60))
    | ((_bytes >= 0x7B) & (_bytes <= 0x7F))
)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_scale = {}


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _PIECE:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if not _scale:
        _scale["powers"] = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)
    return _scale["powers"]


def hashed(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the stretches ``first`` to ``last`` of a sequence of 64-bit codes."""
    powers, inverses = _scales(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=sums[1:])
    value = (sums[last] - sums[first]) * inverses[first]
    return mixed(value ^ (last - first).astype(np.uint64))


@dataclass
class Words:
    """Words of a column: byte places in ``data``, hashes, and for text ``i`` its words
    ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about ``_PIECE`` bytes that end at separators."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + _PIECE)
        while end < n:
            places = np.flatnonzero(separators[data[begin:end]])
            if len(places) and places[-1] > 0:
                end = begin + int(places[-1])
                break
            end = min(n, end + _PIECE)
        yield begin, end
        begin = end


def words(column: pa.Array, separators: np.ndarray = NON_WORDS) -> Words:
    data, offsets = texts(column)
    inside_byte = ~separators
    starts, ends, hashes = [], [], []
    for begin, end in cuts(data, separators):
        piece = data[begin:end]
        inside = inside_byte[piece]
        edges = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
        before = np.empty(len(piece), bool)
        before[0], before[1:] = False, inside[:-1]
        before[edges] = False
        after = np.empty(len(piece), bool)
        after[-1], after[:-1] = False, inside[1:]
        after[edges[edges > 0] - 1] = False
        first = np.flatnonzero(inside & ~before)
        last = np.flatnonzero(inside & ~after) + 1
        starts.append(first + begin)
        ends.append(last + begin)
        hashes.append(hashed(_CODES[piece], first, last))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts = join(starts, np.int64)
    return Words(
        data,
        offsets,
        starts,
        join(ends, np.int64),
        join(hashes, np.uint64),
        np.searchsorted(starts, offsets),
    )


def hash_of(word: str) -> int:
    """The hash that ``words`` gives a single word."""
    return int(words(pa.array([word]), np.zeros(256, bool)).hashes[0])


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece's first string column ``text`` has about ``size`` bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(lengths) - lengths) // size
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            if len(part):
                yield batch.slice(int(part[0]), len(part))


def shingles(found: np.ndarray, length: int = 5) -> np.ndarray:
    """Hashes of the runs of ``length`` words; a shorter text that has words is one run."""
    n = len(found)
    if n == 0:
        return found
    width = min(n, length)
    base = np.uint64(_BASE)
    value = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        value = value * base + found[k : k + n - width + 1]
    return mixed(value ^ np.uint64(width))
