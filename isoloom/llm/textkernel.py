"""Whole batches of texts as one byte buffer: words, rolling hashes and shingles without a Python loop per word.

A batch of texts is one uint8 array and the offsets of its documents. Hashes are differences of
prefix sums of (byte value x power of an odd base) modulo 2**64, divided by the power at their
start, so a string has the same hash wherever it stands. They are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1
#: Bytes of text worked on at a time; one larger document is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240611))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_LOWER_VALUES = _VALUES[LOWER]
#: Multipliers of the words of a shingle.
PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(U) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: Powers are the product of one of STEP low ones and a high one, so their tables stay small however long a text is.
STEP_BITS = 14
STEP = 1 << STEP_BITS


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i for i below STEP, and base**(STEP * j) as far as n needs, 1024 at least."""
    return _powers(base, STEP), _powers(pow(base, STEP, 1 << 64), max(1024, 1 << (n >> STEP_BITS).bit_length()))


def scaled(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """values[i] * base**i, in place."""
    low, high = _tables(base, len(values))
    for j, at in enumerate(range(0, len(values), STEP)):
        part = values[at : at + STEP]
        part *= low[: len(part)] * high[j]
    return values


def shifted(values: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """values * BASE**-places, in place; places are below `size`."""
    low, high = _tables(INVERSE, size)
    values *= low[places & (STEP - 1)]
    values *= high[places >> STEP_BITS]
    return values


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; a null is empty. No copy but for nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each range of `chunks`."""
    buf, offsets = buffer_of(texts)
    for lo, hi in chunks(offsets, limit):
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """len(buf) + 1 prefix sums; see `span_hash`."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(scaled((_LOWER_VALUES if lower else _VALUES)[buf]), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans, lengths included."""
    h = shifted(prefix[ends] - prefix[starts], starts, len(prefix))
    h += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(h)


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes within documents, and the first word of each document."""
    inside = ~space[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words of a document, or of all its words where it has fewer; with the row of each.

    `words` are word hashes, `bounds` the first word of each document (one more entry at the end).
    """
    counts = np.diff(bounds)
    total = len(words)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not total:
        return np.zeros(0, U), rows
    acc = np.zeros(total, U)
    for j in range(min(n, total)):
        acc[: total - j] += words[j:] * PLACES[j]
    at = np.arange(total) - bounds[:-1][rows]
    keep = at + n <= counts[rows]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        keep[bounds[short]] = True
        value = np.zeros(len(short), U)
        for j in range(n - 1):
            has = counts[short] > j
            value[has] += words[bounds[short[has]] + j] * PLACES[j]
        acc[bounds[short]] = value + counts[short].astype(U) * U(0xA0761D6478BD642F)
    return mix(acc[keep]), rows[keep]
