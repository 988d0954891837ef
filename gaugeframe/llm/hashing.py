"""Vectorised hashing of words and word n-grams for Arrow string batches.

All functions work on whole Arrow arrays with numpy and never build a Python
object per word.  A *word* is a maximal run of ASCII letters, digits,
underscores and non-ASCII characters of the lower-cased text; everything else
separates words.  Hashes are 64-bit, depend on the text alone and are the same
in every process, so that a retried task reproduces its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; bounds the temporary arrays (about 60 bytes per byte of text).
CHUNK_BYTES = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True

_powers = np.array([1], dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(6, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            grown = np.full(size, _BASE | np.uint64(1), dtype=np.uint64)
            grown[0] = 1
            _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of an Arrow string array of about ``limit`` bytes each, with the first row's position.

    A single longer text is a slice of its own: texts are never cut.
    """
    if len(column) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    groups = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(groups)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, len(column)], strict=True):
        yield int(a), column.slice(int(a), int(b - a))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a bounded number of rows, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all (lower-cased) texts and the n + 1 offsets of the texts in them; null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the n + 1 offsets of the texts among the words."""
    data, offsets = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = inside[heads]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(starts[at])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(np.r_[first, len(at)])
    position = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        parts = (data[at].astype(np.uint64) + np.uint64(1)) * _powers_to(int(lengths.max()))[position]
        words = mix64(np.add.reduceat(parts, first))
    return words, np.searchsorted(at[first], offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within a text; a text of 1 to n - 1 words has one shingle, all of its words."""
    counts = np.diff(offsets)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(made)])
    shingles = np.zeros(int(out[-1]), dtype=np.uint64)
    long = counts >= n
    # where each shingle starts among the words
    begin = np.repeat(offsets[:-1] - out[:-1], made) + np.arange(len(shingles))
    with np.errstate(over="ignore"):
        of_long = np.repeat(long, made)
        b = begin[of_long]
        acc = np.zeros(len(b), dtype=np.uint64)
        for k in range(n):
            acc = acc * (_BASE | np.uint64(1)) + words[b + k]
        shingles[of_long] = acc
        for i in np.flatnonzero(~long & (counts > 0)):
            acc = np.uint64(0)
            for w in words[offsets[i] : offsets[i + 1]]:
                acc = acc * (_BASE | np.uint64(1)) + w
            shingles[out[i]] = acc + np.uint64(counts[i])
        return mix64(shingles), out


def minhashes(shingles: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """``k`` min-hashes (n x k, unsigned 32 bit) of each text; rows of texts without shingles hold no meaning."""
    counts = np.diff(offsets)
    some = np.flatnonzero(counts > 0)
    out = np.zeros((len(counts), k), dtype=np.uint32)
    if not len(some):
        return out
    first = offsets[some]
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 2**63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, size=k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out[some, j] = np.minimum.reduceat(((shingles * mult[j] + add[j]) >> np.uint64(32)).astype(np.uint32), first)
    return out
