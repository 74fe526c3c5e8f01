"""Vectorised word and shingle hashing over Arrow text batches.

Texts are handled as UTF-8 bytes.  A word is a maximal run of bytes other than space and
``\\x09``-``\\x0D``; A-Z is lower-cased, nothing else.  Hashes are 64-bit polynomials over
random byte values with a final mixing step, so they agree between tasks and runs.
Work is cut into slices of about ``SLICE`` bytes, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
WIDTH = 5
_POWERS = 1 << 16

_draw = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = _draw.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
PLACE = _draw.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER, POWER_HIGH = (
    np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_POWERS - 1, b, np.uint64)])) for b in _BASES
)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD_VALUE = np.where(IS_SPACE, np.uint64(0), BYTE_VALUE[LOWER])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a larger row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words that end at or before each row's end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    keep = ~IS_SPACE[data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    edge = offsets[:-1]
    edge = edge[edge < n]
    begins[edge] = keep[edge]
    start = np.flatnonzero(begins)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    length = np.diff(np.append(start, n))
    body = slice(int(start[0]), n)
    place = np.arange(start[0], n, dtype=np.int64) - np.repeat(start, length)
    value = _WORD_VALUE[data[body]]
    if int(length.max()) <= _POWERS:
        value *= POWER[place]
    else:
        value *= POWER[place & (_POWERS - 1)] * POWER_HIGH[(place >> 16) & (_POWERS - 1)]
    return mix(np.add.reduceat(value, start - start[0])), np.searchsorted(start, offsets[1:], "left")


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_hash_words``; a single very long row is read in pieces cut at white space."""
    if len(data) <= 2 * SLICE or len(offsets) != 2:
        return _hash_words(data, offsets)
    parts, at = [], 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        while stop < len(data):
            ahead = np.flatnonzero(IS_SPACE[data[stop : stop + SLICE]])
            stop = min(stop + (int(ahead[0]) if len(ahead) else SLICE), len(data))
            if len(ahead):
                break
        parts.append(_hash_words(data[at:stop], np.array([0, stop - at], np.int64))[0])
        at = stop
    words = np.concatenate(parts)
    return words, np.array([len(words)], np.int64)


def shingle_sets(column, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, sorted distinct shingle hashes, set sizes)`` slice by slice.

    A row with fewer words than ``width`` has its whole sequence as its only shingle; a row
    without words has none.
    """
    data, offsets = text_buffers(column)
    place = PLACE[:width]
    for first, last in slices(offsets):
        own = offsets[first : last + 1] - offsets[first]
        words, ends = hash_words(data[offsets[first] : offsets[last]], own)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        grams = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            grams += words[k : k + len(grams)] * place[k]
        grams = mix(grams)
        sets, sizes = [], np.zeros(last - first, np.int64)
        for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if b - a >= width:
                one = np.sort(grams[a : b - width + 1])
                one = one[np.concatenate([[True], one[1:] != one[:-1]])]
            elif b > a:
                one = mix((words[a:b] * place[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                continue
            sets.append(one)
            sizes[row] = len(one)
        yield first, last, np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes
