"""Pairwise alignment with affine gaps: match 1, mismatch -1, a gap of n costs 2 + (n - 1).

Exact dynamic programming, a row at a time in numpy: the gaps along a row are a running maximum.
The way back reads one byte a cell (100 MB for two sequences that differ over 10,000 bases).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OPEN, EXTEND = -2, -1
LOW = -(1 << 28)


def _letters(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)


def _rows(a: np.ndarray, b: np.ndarray):
    """Yield, for each row, the best scores and those that end in a gap down and along."""
    m = len(b)
    ramp = EXTEND * np.arange(m + 1)
    top = np.concatenate([[0], OPEN + EXTEND * np.arange(m)]).astype(np.int64)
    down = np.full(m + 1, LOW, np.int64)
    yield top, down, top
    for i, x in enumerate(a):
        down = np.maximum(top + OPEN, down + EXTEND)
        best = down.copy()
        best[1:] = np.maximum(best[1:], top[:-1] + np.where(b == x, 1, -1))
        best[0] = OPEN + EXTEND * i
        along = np.full(m + 1, LOW, np.int64)
        along[1:] = (np.maximum.accumulate(best - ramp)[:-1] + ramp[1:]) + OPEN - EXTEND
        best = np.maximum(best, along)
        yield best, down, along
        top = best


#: What the way back needs to know of a cell: one byte.
DIAGONAL, DOWN, MORE_DOWN, MORE_ALONG = 1, 2, 4, 8


def _marks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How each cell's score came about; scores themselves are kept for two rows only."""
    out = np.zeros((len(a) + 1, len(b) + 1), np.uint8)
    above = None
    for i, (best, down, along) in enumerate(_rows(a, b)):
        out[i, 1:] |= (along[1:] == along[:-1] + EXTEND) * np.uint8(MORE_ALONG)
        if above is not None:
            out[i, 1:] |= (best[1:] == above[0][:-1] + np.where(b == a[i - 1], 1, -1)) * np.uint8(DIAGONAL)
            out[i] |= (best == down) * np.uint8(DOWN)
            out[i] |= (down == above[1] + EXTEND) * np.uint8(MORE_DOWN)
        above = best, down
    return out


@dataclass
class Summary:
    """Of a global alignment: the longest gap, matching and mismatching columns."""

    longest_indel: int
    matches: int
    mismatches: int

    @property
    def identity(self) -> float:
        columns = self.matches + self.mismatches
        return self.matches / columns if columns else 1.0


def global_summary(a: str, b: str) -> Summary:
    """Align all of a with all of b. Equal ends are matched without a table."""
    if not a or not b:
        return Summary(max(len(a), len(b)), 0, 0)
    x, y = _letters(a), _letters(b)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[::-1][: n - head] != y[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    equal = head + tail
    if not len(x) or not len(y):
        return Summary(max(len(x), len(y)), equal, 0)
    marks = _marks(x, y)
    i, j, longest, mismatches, run, state = len(x), len(y), 0, 0, 0, "best"
    while i or j:
        if state == "best":
            if i and j and marks[i, j] & DIAGONAL:
                equal, mismatches = equal + int(x[i - 1] == y[j - 1]), mismatches + int(x[i - 1] != y[j - 1])
                i, j = i - 1, j - 1
                continue
            state, run = ("down" if i and (not j or marks[i, j] & DOWN) else "along"), 0
        run += 1
        longest = max(longest, run)
        if state == "down":
            stay = i > 1 and (not j or marks[i, j] & MORE_DOWN)
            i -= 1
        else:
            stay = j > 1 and (not i or marks[i, j] & MORE_ALONG)
            j -= 1
        if not stay:
            state = "best"
    return Summary(longest, equal, mismatches)


@dataclass
class Flank:
    """Of an extension: bases of the read left over, bases of the backbone used, and whether the backbone ran out."""

    unmatched: int
    consumed: int
    exhausted: bool


def extend(read: str, backbone: str, backwards: bool) -> Flank:
    """Extend a read's flank into the backbone's, outwards from their anchor, up to the best-scoring end.

    A row that falls below the best score by max(20, a quarter of the flank) everywhere ends it.
    """
    if not read:
        return Flank(0, 0, not backbone)
    if not backbone:
        return Flank(len(read), 0, True)
    x, y = (_letters(s[::-1] if backwards else s) for s in (read, backbone))
    drop = max(20, len(read) // 4)
    # The best end lies on the diagonal as long as all bases agree.
    n = min(len(x), len(y))
    if (x[:n] == y[:n]).all():
        return Flank(len(x) - n, n, n >= len(y))
    y_used = y[: 2 * len(x) + drop + 2]
    top, where = 0, (0, 0)
    for i, (best, _, _) in enumerate(_rows(x, y_used)):
        j = int(best.argmax())
        if best[j] > top:
            top, where = int(best[j]), (i, j)
        elif best[j] < top - drop:
            break
    return Flank(len(x) - where[0], where[1], where[1] >= len(y))
