"""Vectorised views of Arrow text columns: bytes, word bounds and 64-bit word hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Byte classes and tables. Words are maximal runs of bytes other than space and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_STEP = np.uint64(_MULTIPLIER)
#: Masks of the first 0 to 8 bytes of a little-endian word; spans are hashed by the word up to so many bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 256

CHUNK_BYTES = 1 << 21


def powers(n: int) -> np.ndarray:
    """The first n powers of the multiplier, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(max(n, 2 * len(_POWERS)), _MULTIPLIER, np.uint64)
        step[0] = 1
        _POWERS = np.multiply.accumulate(step)
    return _POWERS[:n]


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most about `limit` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8_view(batch.column(column))
        at, total = 0, batch.num_rows
        while at < total:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(total, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end


def utf8_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    base = offsets[0] if len(offsets) else 0
    raw = np.frombuffer(data, np.uint8)[base : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > base else np.zeros(0, np.uint8)
    return raw, offsets - base


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay inside one row, and per row the index of its first run."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(mask & (np.concatenate(([True], ~mask[:-1])) | edge[:-1]))
    ends = np.flatnonzero(mask & (np.concatenate((~mask[1:], [True])) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight at a time. Equal bytes give equal hashes in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    h = mix(lens.astype(np.uint64) * _STEP + np.uint64(salt) + (eight[starts] & _FIRST[np.minimum(lens, 8)]))
    longer, at = np.flatnonzero(lens > 8), 8
    while len(longer) and at < _LONG:
        h[longer] = mix(h[longer] * _STEP + (eight[starts[longer] + at] & _FIRST[np.minimum(lens[longer] - at, 8)]))
        at += 8
        longer = longer[lens[longer] > at]
    if len(longer):
        h[longer] = mix(h[longer] * _STEP + _sums(data, starts[longer] + at, ends[longer]))
    return h


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each span the sum of its bytes' numbers times powers of the multiplier; for the rest of very long spans."""
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    return np.add.reduceat(_BYTE_VALUES[data[at]] * powers(int(lens.max()))[pos], first)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, and per row the index of its first word (one more at the end)."""
    data, offsets = utf8_view(column)
    data = LOWER[data]
    starts, ends, first = spans(NOT_SPACE[data], offsets)
    return span_hashes(data, starts, ends), first
