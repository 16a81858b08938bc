"""Vectorised byte-level text helpers shared by the Arrow-based operators.

Texts are handled as the UTF-8 bytes that Arrow already holds: a block of documents is one uint8 array plus offsets,
so splitting into words, hashing words and hashing shingles are a few numpy passes over the block, not a loop over
characters. Blocks are bounded in bytes (a single longer document forms a block of its own), which bounds the memory
of a Python worker whatever the Arrow batch holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: space, tab, line feed, vertical tab, form feed, carriage return separate words
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE_LOWER = _CODE[_LOWER]
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^i and M^-i modulo 2^64 for i up to n at least."""
    size = 1 << max(20, int(n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _M, np.uint64), np.full(size, _M_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def string_buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if values.null_count:
        values = values.fill_null("")
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    _, where, data = values.buffers()
    offsets = np.frombuffer(where, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(values: pa.Array, limit: int = BLOCK_BYTES):
    """Cut a column into runs of rows of about `limit` bytes: yields (first row, end row, bytes, offsets)."""
    data, offsets = string_buffers(values)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the number of its first word (one more at the end)."""
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased), from one running polynomial sum over the block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_CODE_LOWER if lower else _CODE)[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_hash(text: str) -> int:
    """The hash that word_hashes gives the word `text`."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Of each document the sorted distinct hashes of its `width`-word shingles.

    With fewer words, the whole sequence is the one shingle; without words the set is empty.
    """
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * _SHINGLE + words[k : k + n]
    rolled = mix64(rolled)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            h = np.sort(rolled[a : b - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h)
        elif b > a:
            acc = np.array([b - a], np.uint64)
            for w in words[a:b]:
                acc = acc * _SHINGLE + w
            out.append(mix64(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def mask_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each document."""
    return np.diff(word_bounds(data, offsets)[2])
