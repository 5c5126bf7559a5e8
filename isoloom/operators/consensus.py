"""Consensus of an isoform's reads: between anchors that most reads share, the most frequent segment."""

from __future__ import annotations

from collections import Counter

import numpy as np

from isoloom.operators.minimizers import anchors_of, chain

#: A boundary needs so many reads; fewer own reads than OWN call for helpers, at most HELPERS of the longest.
SUPPORT, OWN, HELPERS = 2, 3, 16


def once(sorted_map: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions of the k-mers that occur once."""
    value, at = sorted_map
    _, first, counts = np.unique(value, return_index=True, return_counts=True)
    return np.sort(at[first[counts == 1]])


def hits(read_map: tuple, backbone_map: tuple, places: np.ndarray) -> np.ndarray:
    """A read's rows (boundary, position), rising in both; a boundary that the read meets twice is left out."""
    shared = anchors_of(read_map, backbone_map)
    shared = shared[np.isin(shared[:, 1], places)]
    _, back, counts = np.unique(shared[:, 1], return_inverse=True, return_counts=True)
    path = chain(shared[counts[back] == 1] if len(shared) else shared)
    return np.stack([np.searchsorted(places, path[:, 1]), path[:, 0]], axis=1)


def depth_and_support(found: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """At each boundary: reads whose hits span it, and reads that hit it."""
    step, support = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    for h in found:
        if len(h):
            step[h[0, 0]] += 1
            step[h[-1, 0] + 1] -= 1
            support[h[:, 0]] += 1
    return np.cumsum(step)[:n], support


def modal(votes: Counter, default: str) -> str:
    """The most frequent segment; of equals the default, then the smallest."""
    return min(votes, key=lambda s: (-votes[s], s != default, s)) if votes else default


def untemplated(head: str, heads: list[str]) -> int:
    """Leading Gs, at most three, at which more reads begin than carry one more G before them."""
    n = 0
    while n < min(3, len(head)) and head[n] == "G":
        rest = head[n:]
        if heads.count(rest) <= heads.count("G" + rest):
            break
        n += 1
    return n


def segments(found: list[np.ndarray], seqs: list[str], boundaries: np.ndarray) -> list[Counter]:
    """For each window between neighbouring boundaries, the segments of the reads that hold both."""
    votes = [Counter() for _ in boundaries[1:]]
    for h, seq in zip(found, seqs, strict=True):
        held = h[np.isin(h[:, 0], boundaries)]
        window = np.searchsorted(boundaries, held[:, 0])
        for k in np.flatnonzero(window[1:] == window[:-1] + 1):
            votes[window[k]][seq[held[k, 1] : held[k + 1, 1]]] += 1
    return votes


def consensus(seqs: list[str], maps: list[tuple], members: list[int], group: list[int], trim_caps: bool = False, vote_tail: bool = False) -> str:
    """The consensus of `members`; other reads of the `group` vote where members are few."""
    size = max(len(seqs[i]) for i in members)
    lead = [i for i in members if len(seqs[i]) == size][-1]
    backbone, places = seqs[lead], once(maps[lead])
    if len(members) < 2 or len(places) < 2:
        return backbone
    mine = [hits(maps[i], maps[lead], places) for i in members]
    depth, support = depth_and_support(mine, len(places))
    helpers: list[int] = []
    if (depth < OWN).any():
        inside = set(members)
        helpers = sorted((i for i in group if i not in inside), key=lambda i: -len(seqs[i]))[:HELPERS]
    theirs = [hits(maps[i], maps[lead], places) for i in helpers]
    more_depth, more_support = depth_and_support(theirs, len(places))
    few = depth < OWN
    all_depth, all_support = depth + few * more_depth, support + few * more_support
    boundaries = np.flatnonzero(all_support >= np.maximum(all_depth // 2 + 1, SUPPORT))
    if len(boundaries) < 2:
        return backbone
    at = places[boundaries].tolist()
    votes = segments(mine, [seqs[i] for i in members], boundaries)
    for own, extra in zip(votes, segments(theirs, [seqs[i] for i in helpers], boundaries) if helpers else [], strict=False):
        if own.total() < OWN:
            own.update(extra)
    where = lambda b: [(seqs[i], int(h[h[:, 0] == b, 1][0])) for i, h in zip(members, mine, strict=True) if (h[:, 0] == b).any()]
    begin = untemplated(backbone[: at[0]], [s[:p] for s, p in where(boundaries[0])]) if trim_caps else 0
    stop, tail = len(boundaries) - 1, backbone[at[-1] :]
    if vote_tail:
        held = np.flatnonzero(2 * support[boundaries] > len(members))
        if len(held):
            tails = Counter(s[p:] for s, p in where(boundaries[held[-1]]))
            if max(tails.values(), default=0) >= 2:
                stop = int(held[-1])
                tail = modal(tails, backbone[at[stop] :])
    middle = [modal(votes[i], backbone[at[i] : at[i + 1]]) for i in range(stop)]
    return "".join([backbone[begin : at[0]], *middle, tail])
