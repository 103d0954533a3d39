"""Words and shingles of many texts at once, as flat numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_KEYS = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_STEPS = np.random.default_rng(20260102).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _STEP, np.uint64)]))


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker keeps it from Spark otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts (null: empty), and the offsets of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (separated by white space), and the number of words per text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw, offsets = raw_bytes(pc.utf8_lower(texts) if lower else texts)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begins[edge] = solid[edge]
    letters = raw[solid]
    starts = np.flatnonzero(begins[solid])
    counts = np.add.reduceat(np.concatenate([begins, [False]]), np.minimum(offsets[:-1], len(raw)), dtype=np.int64) if len(raw) else np.zeros(len(texts), np.int64)
    counts[np.diff(offsets) == 0] = 0
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = np.diff(np.concatenate([starts, [len(letters)]]))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_BYTE_KEYS[letters] * _powers(int(lengths.max()))[place], starts)), counts


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five-word windows and their number per text; one to four words are one window."""
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    begins = np.cumsum(counts) - counts
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + n, n)
    width = np.repeat(np.minimum(counts, SHINGLE), n)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        total += np.where(k < width, padded[at + k] * _WORD_STEPS[k], np.uint64(0))
    return mix(total), n


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, in slices of about ``most`` bytes; a longer row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
