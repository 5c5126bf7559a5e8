"""Does a read have the structure of a backbone? Anchors, the gaps between them, and the flanks outside."""

from __future__ import annotations

from collections import Counter

import numpy as np

from isoloom.operators.align import extend, global_summary
from isoloom.operators.minimizers import anchors_of, chain
from isoloom.options import IsoformOptions

TAIL_BASES, TAIL_PURITY = 10, 0.8
#: Lower bounds of the classes that gap sizes, and differences of a gap's two lengths, are counted in.
SIZE_CLASSES, JUMP_CLASSES = (0, 32, 64, 128, 256, 512), (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64)


def bound(classes: tuple[int, ...], n: int) -> int:
    return max(c for c in classes if c <= n)


def is_tail(seq: str) -> bool:
    """A stretch of at least TAIL_BASES of which one base makes up TAIL_PURITY, as a poly-A tail."""
    upper = seq.upper()
    return len(seq) >= TAIL_BASES and max(map(upper.count, "ACGT")) >= TAIL_PURITY * len(seq)


def strip_tails(seq: str) -> str:
    """End runs of more than TAIL_BASES equal letters cut back to one, the 3' end first."""
    low = seq.lower()
    run = len(low) - len(low.rstrip(low[-1:])) if low else 0
    if run > TAIL_BASES:
        seq, low = seq[: len(seq) - run + 1], low[: len(low) - run + 1]
    run = len(low) - len(low.lstrip(low[:1])) if low else 0
    return seq[run - 1 :] if run > TAIL_BASES else seq


def gaps_fit(path: np.ndarray, read: str, backbone: str, o: IsoformOptions, seen: Counter) -> bool:
    """Every gap between neighbouring anchors is short, or the same sequence without a long indel."""
    begin, end = path[:-1] + o.k, path[1:]
    sizes = np.maximum(end - begin, 0)
    for g in np.flatnonzero(sizes.max(axis=1) > o.max_gap):
        jump = abs(int(sizes[g, 0] - sizes[g, 1]))
        if o.max_gap_jump and jump >= o.max_gap_jump:
            seen["gap_jumps", 0] += 1
            return False
        a, b = (seq[begin[g, i] : begin[g, i] + sizes[g, i]] for i, seq in enumerate((read, backbone)))
        found = global_summary(a, b)
        fits = found.identity >= o.min_gap_ident and found.longest_indel < o.max_indel_run
        seen["gap_size", bound(SIZE_CLASSES, int(sizes[g].max()))] += 1
        seen["jump_accepted" if fits else "jump_rejected", bound(JUMP_CLASSES, jump)] += 1
        if not fits:
            return False
    return True


def place(read: str, backbone: str, read_map: tuple, backbone_map: tuple, o: IsoformOptions, seen: Counter | None = None) -> tuple[int, int] | str:
    """The read's start and end on the backbone (they may lie outside), or why it doesn't fit.

    `seen` gets counts of what was compared, by (event, class).
    """
    seen = Counter() if seen is None else seen
    seen["placements", 0] += 1
    shared = anchors_of(read_map, backbone_map)
    if len(shared) < o.min_anchors:
        return "few_anchors"
    path = chain(shared)
    if len(path) < o.min_anchors:
        return "short_chain"
    if not gaps_fit(path, read, backbone, o, seen):
        return "interior_gap"
    (r0, b0), (r1, b1) = path[0].tolist(), path[-1].tolist()
    after = min(b1 + o.k, len(backbone))
    sides = ((read[:r0], backbone[:b0], True), (read[r1 + o.k :], backbone[after:], False))
    fits, charged, overhang = [], [], []
    for mine, theirs, backwards in sides:
        seen["flank_size", bound(SIZE_CLASSES, min(len(mine), len(theirs)))] += 1
        fit = extend(mine, theirs, backwards)
        loose = mine[: fit.unmatched] if backwards else mine[len(mine) - fit.unmatched :]
        tail = is_tail(loose)
        fits.append(fit)
        charged.append(0 if tail else fit.unmatched)
        overhang.append(0 if tail else max(len(mine) - fit.consumed, 0))
    head, foot = fits
    start = -overhang[0] if head.exhausted else b0 - head.consumed
    end = len(backbone) + overhang[1] if foot.exhausted else after + foot.consumed
    long = [c > o.max_flank for c in charged]
    if any(x and not f.exhausted for x, f in zip(long, fits, strict=True)):
        return "flank_diverged"
    if all(long):
        return "both_flanks"
    if max(len(read) - sum(charged), 0) / max(len(read), 1) < o.min_cov:
        return "low_coverage"
    return start, end


def structure_groups(seqs: list[str], maps: list[tuple], o: IsoformOptions, seen: Counter | None = None) -> tuple[list[list[tuple[int, int, int]]], dict[str, int]]:
    """Groups of (read, start, end) on the longest read left each time; and how often a read was turned down, and why."""
    left = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    groups, reasons = [], {}
    while left:
        lead, *others = left
        group, left = [(lead, 0, len(seqs[lead]))], []
        for i in others:
            where = place(seqs[i], seqs[lead], maps[i], maps[lead], o, seen)
            if isinstance(where, str):
                reasons[where] = reasons.get(where, 0) + 1
                left.append(i)
            else:
                group.append((i, *where))
        groups.append(group)
    return groups, reasons
