"""Where the reads of a group start and end: peaks, validated starts, and the isoforms these make."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from isoloom.options import IsoformOptions, StartLibrary

# The thresholds and windows below are fixed values.
#: A read within RADIUS of a start begins there; SHARP is the wider window it is compared with.
RADIUS, SHARP = 25, 300
#: Without thresholds of the library: stop fraction and capped share of a real start.
STOP_FRACTION, CAPPED_SHARE = 0.42, 0.7
#: A cap signal needs this share of capped reads among this many labelled ones.
CAP_LIBRARY, CAP_READS = 0.2, 10
#: Candidates that a library needs for thresholds of its own.
CANDIDATES = 100
#: Windows around a start that the dump counts. Fixed values.
DUMP_WINDOWS = (50, 100, 150, 200, 300, 500, 750, 1000, 1500)
#: The start key of reads at no validated start; it sorts before all others.
ANYWHERE = -(1 << 31)


def peaks(points: Iterable[int], width: int, support: int) -> list[int]:
    """Medians of the densest windows of `width`, taken one after the other while they hold `support` points."""
    x = np.sort(np.fromiter(points, np.int64))
    found = []
    while len(x):
        counts = np.searchsorted(x, x + width, "right") - np.arange(len(x))
        i = int(counts.argmax())
        n = int(counts[i])
        if n < support:
            break
        found.append(int(x[(2 * i + n - 1) // 2]))
        x = np.delete(x, np.s_[i : i + n])
    return sorted(found)


def nearest(centres: list[int], x: int, radius: int) -> int | None:
    """The nearest centre within the radius, the lower of two."""
    near = [(abs(c - x), c) for c in centres if abs(c - x) <= radius]
    return min(near)[1] if near else None


def lead(read: str, backbone: str, start: int) -> tuple[int, str] | None:
    """How many bases (0 to 3) stand before the read matches 12 bases of the backbone at its start, and its first base."""
    for n in range(4):
        if n + 12 > len(read):
            return None
        word = read[n : n + 12]
        if any(backbone[b : b + 12] == word for b in (start, max(start - 1, 0), start + 1)):
            return n, read[0]
    return None


def otsu(values: Iterable[float]) -> float:
    """The cut, in hundredths, that separates values in [0, 1] best."""
    v = np.array(list(values), np.float32).astype(np.float64)
    counts = np.bincount(np.minimum((v * 100).astype(np.int64), 99), minlength=100).astype(np.float64)
    middle = (np.arange(100) + 0.5) / 100
    below, weight = np.cumsum(counts)[:-1], np.cumsum(counts * middle)[:-1]
    above = counts.sum() - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return CAPPED_SHARE
    gap = weight[ok] / below[ok] - ((counts * middle).sum() - weight[ok]) / above[ok]
    return float((np.flatnonzero(ok)[int((below[ok] * above[ok] * gap * gap).argmax())] + 1) / 100)


def rank_test(sharpness: np.ndarray, capped: np.ndarray) -> tuple[float, float]:
    """Mann-Whitney z and AUC of the capped against the others; ties share their mean rank."""
    n1, n2 = float(capped.sum()), float((~capped).sum())
    if not n1 or not n2:
        return 0.0, 0.5
    _, place, counts = np.unique(sharpness, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    return rank_z(n1, n2, 2 * (upto - (counts - 1) / 2)[place][capped].sum())


def rank_z(n1: float, n2: float, twice_rank_sum: float) -> tuple[float, float]:
    """Mann-Whitney z and AUC from the group sizes and twice the rank sum of the first group."""
    if not n1 or not n2:
        return 0.0, 0.5
    u = twice_rank_sum / 2 - n1 * (n1 + 1) / 2
    return float((u - n1 * n2 / 2) / np.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)), float(u / (n1 * n2))


@dataclass
class StartStats:
    """What start validation sees, summed over groups."""

    labelled: int = 0
    capped: int = 0
    candidates: list[tuple[float, float]] = field(default_factory=list)
    stop_fractions: list[float] = field(default_factory=list)

    def add(self, other: StartStats) -> None:
        self.labelled += other.labelled
        self.capped += other.capped
        self.candidates += other.candidates
        self.stop_fractions += other.stop_fractions

    def library(self, o: IsoformOptions) -> StartLibrary:
        many = len(self.candidates) >= CANDIDATES
        threshold = o.cap_threshold if o.cap_threshold is not None else otsu(c for c, _ in self.candidates) if many else CAPPED_SHARE
        signal = o.cap_signal == "on"
        if o.cap_signal == "auto":
            signal = self.labelled >= CAP_READS and self.capped >= CAP_LIBRARY * self.labelled
            if signal and many:
                pairs = np.array(self.candidates, np.float32)
                signal = rank_test(pairs[:, 1], pairs[:, 0].astype(np.float64) >= threshold)[0] > 3.09
        stop = o.stop_threshold if o.stop_threshold is not None else otsu(self.stop_fractions) if len(self.stop_fractions) >= CANDIDATES else STOP_FRACTION
        return StartLibrary(signal, threshold, stop)


class Group:
    """A structure group: its reads' starts and ends on the backbone, and which begin with an untemplated G."""

    def __init__(self, placed: list[tuple[int, int, int]], seqs: list[str], o: IsoformOptions):
        self.reads, self.o = [p[0] for p in placed], o
        self.starts = np.array([p[1] for p in placed], np.int64)
        self.ends = np.array([p[2] for p in placed], np.int64)
        self.seqs, self.backbone = seqs, seqs[placed[0][0]]
        self._leads: list | None = None

    @property
    def leads(self) -> list[tuple[int, str] | None]:
        if self._leads is None:
            self._leads = [lead(self.seqs[i], self.backbone, int(s)) if s > RADIUS else None for i, s in zip(self.reads, self.starts, strict=True)]
        return self._leads

    def tally(self, which: np.ndarray | None = None) -> tuple[int, int]:
        """Labelled reads and capped ones."""
        on = [x for i, x in enumerate(self.leads) if x is not None and (which is None or which[i])]
        return len(on), sum(n > 0 and first == "G" for n, first in on)

    def peaks(self, points: np.ndarray) -> list[int]:
        return peaks(points, max(self.o.peak_width, 1), self.o.min_iso)

    def candidates(self) -> list[int]:
        return [p for p in self.peaks(self.starts) if p > RADIUS]

    def within(self, peak: int, radius: int) -> np.ndarray:
        return np.abs(self.starts - peak) <= radius

    def stop_fraction(self, peak: int, starting: int) -> float:
        passing = int(((self.starts < peak - RADIUS) & (self.ends > peak + RADIUS)).sum())
        return starting / max(starting + passing, 1)

    def stats(self) -> StartStats:
        out = StartStats(*self.tally())
        for peak in self.candidates():
            near = self.within(peak, RADIUS)
            n, g = self.tally(near)
            if n >= self.o.min_iso:
                out.candidates.append((float(np.float32(g) / np.float32(n)), float(np.float32(near.sum()) / np.float32(self.within(peak, SHARP).sum()))))
            out.stop_fractions.append(float(np.float32(self.stop_fraction(peak, int(near.sum())))))
        return out

    def decided(self) -> StartLibrary:
        """The library's decision, or this group's where there is none."""
        if self.o.library:
            return self.o.library
        known, capped = self.tally()
        signal = self.o.cap_signal == "on" or self.o.cap_signal == "auto" and known >= CAP_READS and capped >= CAP_LIBRARY * known
        pick = lambda x, y: y if x is None else x
        return StartLibrary(signal, pick(self.o.cap_threshold, CAPPED_SHARE), pick(self.o.stop_threshold, STOP_FRACTION))

    def judged(self) -> list[dict]:
        """Each start candidate with `min_iso` reads, with its counts and whether it is real."""
        found = self.candidates()
        if not found:
            return []
        library, out = self.decided(), []
        for peak in found:
            near = self.within(peak, RADIUS)
            size = int(near.sum())
            if size < self.o.min_iso:
                continue
            n, g = self.tally(near)
            real = n >= self.o.min_iso and g >= library.threshold * n if library.cap_signal else self.stop_fraction(peak, size) >= library.stop_fraction
            out.append({"peak": peak, "reads": size, "labelled": n, "capped": g, "near": int(self.within(peak, SHARP).sum()), "real": bool(real), "signal": library.cap_signal, "windows": {w: int(self.within(peak, w).sum()) for w in DUMP_WINDOWS}})
        return out

    def split(self) -> list[tuple[list[int], bool]]:
        """The isoforms: lists of reads, and whether each begins at a validated start."""
        o, n = self.o, len(self.reads)
        tolerance = max(o.boundary_tol, 1)
        ends = self.peaks(self.ends)
        if o.start_split == "on":
            centres = self.peaks(self.starts)
            first = [nearest(centres, int(s), tolerance) for s in self.starts]
        elif o.start_split == "off":
            first = [ANYWHERE] * n
        else:
            centres = [c["peak"] for c in self.judged() if c["real"]]
            first = [ANYWHERE if (c := nearest(centres, int(s), RADIUS)) is None else c for s in self.starts]
        last = [nearest(ends, int(e), tolerance) for e in self.ends]
        cells: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(first, last, strict=True)):
            if None not in key:
                cells.setdefault(key, []).append(i)
        dense = {k: v for k, v in sorted(cells.items()) if len(v) >= o.min_iso}
        if not dense:
            return [(list(self.reads), False)]
        extents = []
        for key, inside in dense.items():
            q = min(max(o.min_iso // 2, 1), len(inside))
            extents.append((key, np.sort(self.starts[inside])[q - 1], np.sort(self.ends[inside])[-q], len(inside)))
        by_support = sorted(extents, key=lambda e: (-e[3], e[0]))
        members: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            key = (first[i], last[i])
            if key not in dense:
                slack = tolerance if o.start_split == "on" else RADIUS
                holds = (k for k, a, b, _ in by_support if b >= self.ends[i] - tolerance and (o.start_split != "on" and k[0] == ANYWHERE or a <= self.starts[i] + slack))
                key = next(holds, None)
            if key is not None:
                members.setdefault(key, []).append(self.reads[i])
        return [(m, o.start_split == "auto" and k[0] != ANYWHERE) for k, m in sorted(members.items())]
