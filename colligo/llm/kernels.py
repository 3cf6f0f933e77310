"""Vectorised word splitting and hashing over Arrow string columns (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MASK = (1 << 64) - 1
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd multipliers from a seeded rule."""
    return mix(np.arange(1, n + 1, dtype=U64) * BASE + U64(seed)) | U64(1)


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (BASE, BASE_INVERSE)]
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offsets where each starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the index of its first word."""
    inside = ~SEPARATOR[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, from prefix sums, then mixed with its length."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        lo = starts[a]
        block = data[lo : ends[b - 1]].astype(U64) + U64(1)
        power, inverse = _power_tables(len(block) + 1)
        prefix = np.concatenate([np.zeros(1, U64), np.cumsum(block * power[: len(block)], dtype=U64)])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((prefix[e] - prefix[s]) * inverse[s] ^ ((e - s).astype(U64) * BASE))
        a = b
    return out


def chunks(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together; a longer one stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def documents(column: pa.Array, lower: bool = False, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) for ranges of rows of about ``limit`` bytes."""
    data, offs = utf8(column)
    for a, b in chunks(offs, limit):
        part = data[offs[a] : offs[b]]
        part = LOWER[part] if lower else part
        starts, ends, first = spans(part, offs[a : b + 1] - offs[a])
        yield a, b, hash_words(part, starts, ends), first


def ngrams(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from each position; len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, k * int(BASE) & MASK, U64)
    for j, c in enumerate(odd_constants(k, seed)):
        total += words[j : j + n] * c
    return mix(total)


def shingle_set(words: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Sorted distinct k-word shingles; with fewer words, the whole sequence as one."""
    return np.unique(ngrams(words, min(k, len(words)), seed)) if len(words) else np.zeros(0, U64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``column``, so that Python objects of few rows live at once."""
    _, offs = utf8(batch[column])
    for a, b in chunks(offs, limit):
        yield batch.slice(a, b - a)
