"""Seeds of a read: open syncmers, parsed into locally consistent blocks over several levels.

A seed is a 64-bit hash with a level. Reads that share sequence share seeds whatever surrounds it,
because every choice depends on the neighbourhood alone. The kernels work on one read at a time
with numpy; `seeds` runs them over a table of reads in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isoloom.runtime import prepare

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
#: The hash values of the bases A, C, G, T. Fixed values.
BASE_HASH = np.array([0x9E3779B97F4A7C15, 0x6C62272E07BB0142, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], U)
#: What tells the levels' hashes apart; beyond, STEP is added for each level. Fixed values.
LEVELS = (0x9E3779B97F4A7C15, 0x6C62272E07BB0142, 0xD2A98B26625EEE7B, 0xA3B195354A2B7623, 0x1B03738712FAD5C9, 0xC4CEB9FE1A85EC53, 0x517CC1B727220A95, 0x9BE1AA58BA6A9F81)
STEP, FIRST, SECOND = 0x6C62272E07BB0142, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


def codes(seq: str) -> np.ndarray:
    """0 to 3 for the bases, 4 for any other letter."""
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return x if not by else (x << U(by)) | (x >> U(64 - by))


def smer_hashes(code: np.ndarray, s: int) -> np.ndarray:
    """Hash of every s-mer; the largest value where it holds another letter."""
    n = len(code) - s + 1
    if n <= 0:
        return np.zeros(0, U)
    each = BASE_HASH[np.minimum(code, 3)]
    out = np.zeros(n, U)
    for j in range(s):
        out ^= _rotate(each[j : j + n], s - 1 - j)
    other = np.concatenate([[0], np.cumsum(code == 4)])
    out[other[s:] > other[:-s]] = TOP
    return out


def kmer_values(code: np.ndarray, k: int) -> np.ndarray:
    """Base-4 value of every k-mer (other letters count as A)."""
    n = len(code) - k + 1
    out = np.zeros(max(n, 0), U)
    digit = np.where(code == 4, 0, code).astype(U)
    for j in range(k if n > 0 else 0):
        out = (out << U(2)) | digit[j : j + n]
    return out


def syncmers(seq: str, k: int, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the k-mers whose leftmost smallest s-mer stands at offset t; none that hold an N."""
    if len(seq) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    code = codes(seq)
    windows = np.lib.stride_tricks.sliding_window_view(smer_hashes(code, s), k - s + 1)
    chosen = windows.argmin(axis=1) == t
    letters = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    unknown = np.concatenate([[0], np.cumsum((letters | 32) == ord("n"))])
    chosen &= unknown[k:] == unknown[:-k]
    at = np.flatnonzero(chosen)
    return at, kmer_values(code, k)[at]


def local_extremes(v: list[int]) -> tuple[list[bool], list[bool]]:
    """Where a value is below, and above, both neighbours; a missing neighbour is no obstacle."""
    n = len(v)
    low = [(i == 0 or v[i] < v[i - 1]) and (i == n - 1 or v[i] < v[i + 1]) for i in range(n)]
    high = [(i == 0 or v[i] > v[i - 1]) and (i == n - 1 or v[i] > v[i + 1]) for i in range(n)]
    return low, high


def triplets(v: list[int]) -> list[tuple[int, int]]:
    """Ranges (inclusive) around the minima, then around the maxima that touch no minimum."""
    low, high = local_extremes(v)
    n = len(v)
    around = lambda i: (max(i - 1, 0), min(i + 1, n - 1))
    lonely = [i for i in range(n) if high[i] and not (i and low[i - 1]) and not (i + 1 < n and low[i + 1])]
    return [around(i) for i in range(n) if low[i]] + [around(i) for i in lonely]


def three_colours(v: list[int]) -> list[int]:
    """Deterministic coin tossing: neighbours that differ get different colours of three."""
    coin = list(v)
    while max(coin) >= 6:
        tossed = []
        for x, y in zip(coin, coin[1:], strict=False):
            p = ((x ^ y) & -(x ^ y)).bit_length() - 1
            tossed.append(2 * p + (x >> p & 1))
        coin = [*tossed, int(tossed[-1] == 0)]
    for colour in (3, 4, 5):
        for i, c in enumerate(coin):
            if c == colour:
                beside = {coin[i - 1] if i else None, coin[i + 1] if i + 1 < len(coin) else None}
                coin[i] = next(x for x in range(3) if x not in beside)
    return coin


def split_run(first: int, last: int, v: list[int]) -> list[tuple[int, int]]:
    """A strictly monotone stretch cut into ranges (inclusive) of at most three units."""
    if last - first < 3:
        return [(first, last)]
    return [(first + a, first + b) for a, b in triplets(three_colours(v[first : last + 1]))]


def parse(v: list[int]) -> list[tuple[int, int]]:
    """Locally consistent blocks (start, end) that cover every unit; a range that adds nothing is left out."""
    n = len(v)
    if n < 2:
        return [(0, 1)] * n
    free, out = [True] * n, []

    def take(lo: int, hi: int) -> None:
        hi = min(hi, n - 1)
        if any(free[lo : hi + 1]):
            free[lo : hi + 1] = [False] * (hi + 1 - lo)
            out.append((lo, hi + 1))

    for lo, hi in triplets(v):
        take(lo, hi)
    i = 0
    while i < n:  # runs of equal values, with their neighbours
        j = i
        while j + 1 < n and v[j + 1] == v[i]:
            j += 1
        if j > i:
            take(max(i - 1, 0), j + 1)
        i = j + 1
    if any(free):
        reach = {1: list(range(n)), -1: list(range(n))}  # how far a strict rise or fall goes
        for sign, far in reach.items():
            for i in range(n - 2, -1, -1):
                if (v[i + 1] - v[i]) * sign > 0:
                    far[i] = far[i + 1]
        for a in range(n - 2):
            for sign in (1, -1):
                b = reach[sign][a]
                if not free[a] and b > a + 1 and not free[b] and any(free[a + 1 : b]):
                    for lo, hi in split_run(a, b, v):
                        take(lo, hi)
    if any(free):
        raise AssertionError("a unit belongs to no block")
    return sorted(out, key=lambda x: x[0])


def block_hashes(values: np.ndarray, blocks: list[tuple[int, int]], level: int) -> np.ndarray:
    """Hash of each block's values; level counts from 0."""
    domain = LEVELS[level] if level < len(LEVELS) else LEVELS[-1] + level * STEP
    spans = np.array(blocks, np.int64).reshape(-1, 2)
    sizes = spans[:, 1] - spans[:, 0]
    out = sizes.astype(U) * U(FIRST) ^ U(domain & int(TOP))
    for j in range(int(sizes.max()) if len(sizes) else 0):
        on = sizes > j
        h = _rotate(out[on], 13) + values[spans[on, 0] + j]
        h = (h ^ (h >> U(30))) * U(FIRST)
        h = (h ^ (h >> U(27))) * U(SECOND)
        out[on] = h ^ (h >> U(31))
    return out


def level_hashes(seq: str, k: int, s: int, t: int, levels: int) -> list[np.ndarray]:
    """The block hashes of each level, lowest first; ends where fewer than two units are left."""
    _, values = syncmers(seq, k, s, t)
    out: list[np.ndarray] = []
    while len(values) and len(out) < max(levels, 1) and (not out or len(values) >= 2):
        values = block_hashes(values, parse([int(x) for x in values]), len(out))
        out.append(values)
    return out


def read_seeds(seq: str, k: int = 15, s: int = 9, t: int | None = None, levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A read's distinct seeds in unsigned order, and the level (from 1) of each."""
    per = level_hashes(seq, k, s, (k - s) // 2 if t is None else t, levels)
    if not per:
        return np.zeros(0, U), np.zeros(0, np.int32)
    h = np.concatenate(per)
    level = np.repeat(np.arange(1, len(per) + 1), [len(p) for p in per]).astype(np.int32)
    h, first = np.unique(h, return_index=True)
    return h, level[first]


def seeds(reads: DataFrame, k: int = 15, s: int = 9, t: int | None = None, levels: int = 3) -> DataFrame:
    """(read_idx, h, level), one row per distinct seed of a read; h holds the unsigned hash's bits."""
    prepare(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, marks = [], [], []
            for i, seq in zip(batch.column("read_idx").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                h, level = read_seeds(seq or "", k, s, t, levels)
                ids.append(np.full(len(h), i, np.int64))
                hashes.append(h.view(np.int64))
                marks.append(level)
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([pa.array(join(ids, np.int64)), pa.array(join(hashes, np.int64)), pa.array(join(marks, np.int32))], names=["read_idx", "h", "level"])

    return reads.select("read_idx", "seq").mapInArrow(run, "read_idx long, h long, level int")
