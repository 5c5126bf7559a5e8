"""Merging isoforms that are copies of each other, and telling start variants from isoforms."""

from __future__ import annotations

from dataclasses import dataclass, replace

from isoloom.operators import ends
from isoloom.operators.align import global_summary
from isoloom.operators.consensus import consensus
from isoloom.operators.minimizers import minimizers
from isoloom.operators.placement import place, strip_tails, structure_groups
from isoloom.options import IsoformOptions


@dataclass
class Isoform:
    members: list[int]
    consensus: str
    alt_start: bool = False
    variant_of: int | None = None
    offset: int | None = None


def near_identical(a: str, b: str, o: IsoformOptions) -> bool:
    a, b = strip_tails(a), strip_tails(b)
    if abs(len(a) - len(b)) > o.collapse_gap:
        return False
    found = global_summary(a, b)
    return found.identity >= o.collapse_ident and found.longest_indel <= o.collapse_gap


def primed(longer: str, end: int, o: IsoformOptions) -> bool:
    """Is the sequence just past `end` rich in A, so that a primer may have annealed there?"""
    window = longer[max(end, 0) :][: o.priming_window].upper()
    return bool(window) and window.count("A") >= o.priming_a_frac * len(window)


class Merger:
    """Compares consensuses of one cluster, each with its minimizers, under tightened options."""

    def __init__(self, o: IsoformOptions):
        self.o = o
        self.strict = replace(o, min_cov=max(o.min_cov, 0.95), max_gap=o.collapse_gap, max_indel_run=o.collapse_gap + 1)
        self.maps: dict[str, tuple] = {}

    def placed(self, a: str, b: str) -> tuple[int, int] | None:
        for s in (a, b):
            if s not in self.maps:
                self.maps[s] = minimizers(s, self.o.k, self.o.w)
        where = place(a, b, self.maps[a], self.maps[b], self.strict)
        return None if isinstance(where, str) else where

    def decide(self, small: Isoform, big: Isoform) -> str:
        """'apart', 'merge', or 'rebuild': merge, and the larger one's consensus is to be made anew."""
        o, slack = self.o, self.o.collapse_gap
        if near_identical(small.consensus, big.consensus, o):
            return "merge"
        within = len(small.members) <= o.collapse_ratio * len(big.members)
        polya = o.end_merge == "polya"
        if not (within or polya):
            return "apart"
        extends = len(small.consensus) > len(big.consensus)
        short, long = (big, small) if extends else (small, big)
        where = self.placed(short.consensus, long.consensus)
        if where is None:
            return "apart"
        start, end = where
        either = small.alt_start or big.alt_start
        size = len(long.consensus)
        ends_early = end < size - slack
        if extends:
            if start > slack and either:
                return "apart"
        elif start < -slack:
            return "rebuild" if within and not either and end >= size - o.boundary_tol else "apart"
        elif o.alt_starts == "keep" and small.alt_start and start > slack:
            return "apart"
        if polya and ends_early:
            return ("rebuild" if extends else "merge") if primed(long.consensus, end, o) else "apart"
        if not within:
            return "apart"
        return "rebuild" if extends and (start > slack or ends_early) else "merge"

    def variant(self, small: Isoform, big: Isoform) -> int | None:
        """The start of `small` relative to `big`, if they differ in little else."""
        a, b = small.consensus, big.consensus
        window, slack = self.o.start_variant_window, self.o.peak_width
        if abs(len(a) - len(b)) > window + slack:
            return None
        swapped = len(a) > len(b)
        where = self.placed(b, a) if swapped else self.placed(a, b)
        if where is None or abs(where[0]) > window or abs(where[1] - max(len(a), len(b))) > slack:
            return None
        return -where[0] if swapped else where[0]

    def merged(self, isoforms: list[Isoform], seqs: list[str], maps: list[tuple]) -> list[Isoform]:
        """Kept isoforms, largest first, then the start variants; each with the reads merged into it."""
        if len(isoforms) < 2:
            return isoforms
        isoforms = sorted(isoforms, key=lambda x: -len(x.members))
        kept: list[Isoform] = []
        absorbed: dict[int, list[Isoform]] = {}
        rebuilt: set[int] = set()
        root: dict[int, tuple[Isoform, int]] = {}
        for x in isoforms:
            verdict = next(((v, y) for y in kept if (v := self.decide(x, y)) != "apart"), None)
            if verdict:
                absorbed.setdefault(id(verdict[1]), []).append(x)
                if verdict[0] == "rebuild":
                    rebuilt.add(id(verdict[1]))
                continue
            if self.o.start_variants == "report":
                found = next(((y, s) for y in kept if (s := self.variant(x, y)) is not None), None)
                if found:
                    y, s = found
                    base, more = root.get(id(y), (y, 0))
                    root[id(x)] = (base, s + more)
            kept.append(x)
        order = [x for x in kept if id(x) not in root] + [x for x in kept if id(x) in root]
        place_of = {id(x): i for i, x in enumerate(order)}
        for x in order:
            if id(x) in root:
                base, x.offset = root[id(x)]
                x.variant_of = place_of[id(base)]
        for x in order:
            x.members = x.members + [m for y in absorbed.get(id(x), ()) for m in y.members]
            if id(x) in rebuilt:
                x.consensus = consensus(seqs, maps, x.members, x.members, self.o.trims_caps, False)
        return order


def isoforms_of(seqs: list[str], o: IsoformOptions, groups: list | None = None) -> list[Isoform]:
    """All steps on one cluster's reads, or those after grouping."""
    maps = [minimizers(s, o.k, o.w) for s in seqs]
    if groups is None:
        groups, _ = structure_groups(seqs, maps, o)
    drafts = []
    for placed in groups:
        group = [p[0] for p in placed]
        drafts += [(members, alt, group) for members, alt in ends.Group(placed, seqs, o).split() if len(members) >= o.min_iso]
    drafts.sort(key=lambda d: -len(d[0]))
    made = [Isoform(m, consensus(seqs, maps, m, g, o.trims_caps, o.votes_tails), alt) for m, alt, g in drafts]
    return Merger(o).merged(made, seqs, maps)
