"""Words and shingles of many UTF-8 texts at once, as NumPy arrays over their bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. Bytes of multi-byte characters are never white
space, so words can be cut without decoding. A word's key is a 64-bit hash of
its bytes: a polynomial over random byte values, finished with a bit mixer.
Two different words of a corpus of 10^13 words share a key with a chance of
about 10^-19 per pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACES = (9, 10, 11, 12, 13, 32)
#: Bytes hashed at a time; only bounds temporary arrays, a longer word is hashed in one go.
_BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_IN_WORD = np.ones(256, bool)
_IN_WORD[list(_SPACES)] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_UP, _DOWN = _powers(_BLOCK, _BASE), _powers(_BLOCK, _BASE_INVERSE)
#: Weights of the places of a shingle.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * _MIX_1) | np.uint64(1)


class Words(NamedTuple):
    """Words of a slice of texts: first and end byte, key, and for each text its first word."""

    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    bounds: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` text bytes (one row may have more)."""
    if not batch.num_rows:
        return
    at = 0
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def split_words(raw: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """Words of texts; ``fold`` lower-cases A-Z in the keys."""
    n = len(raw)
    inside = _IN_WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        apart = edge[1:n]
        first[1:] &= ~inside[:-1] | apart
        last[:-1] &= ~inside[1:] | apart
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, _keys(raw, starts, ends, _FOLDED if fold else _VALUES), np.searchsorted(starts, offsets))


def _keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    keys = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        size = int(ends[j - 1] - low)
        up, down = (_UP, _DOWN) if size <= _BLOCK else (_powers(size, _BASE), _powers(size, _BASE_INVERSE))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(values[raw[low : low + size]] * up[:size], out=total[1:])
        a = starts[i:j] - low
        keys[i:j] = (total[ends[i:j] - low] - total[a]) * down[a]
        i = j
    return mix(keys)


def shingle_keys(keys: np.ndarray, words: int) -> np.ndarray:
    """Keys of all runs of ``words`` successive words, whatever text they are in."""
    n = len(keys) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += keys[k : k + n] * _PLACES[k]
    return mix(total + np.uint64(words))


def shingle_sets(found: Words, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle keys; a text of fewer words has one shingle of all its words, or none."""
    keys = shingle_keys(found.keys, words)
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if b - a >= words:
            run = np.sort(keys[a : b - words + 1])
            keep = np.empty(len(run), bool)
            keep[0] = True
            np.not_equal(run[1:], run[:-1], out=keep[1:])
            yield run[keep]
        elif b > a:
            yield shingle_keys(found.keys[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
