"""Kernels of clustering and isoform detection, on generated sequences."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isoloom.operators import align, ends
from isoloom.operators.align import extend, global_summary
from isoloom.operators.cluster import assign
from isoloom.operators.consensus import consensus, modal, untemplated
from isoloom.operators.merge import Isoform, Merger, isoforms_of, near_identical, primed
from isoloom.operators.minimizers import anchors_of, chain, minimizers
from isoloom.operators.placement import is_tail, place, strip_tails, structure_groups
from isoloom.operators.seeds import TOP, codes, kmer_values, level_hashes, local_extremes, parse, read_seeds, smer_hashes, syncmers, three_colours
from isoloom.options import ClusterOptions, IsoformOptions, StartLibrary


def gene(seed: int, n: int) -> str:
    return "".join(random.Random(seed).choices("ACGT", k=n))


def swap(base: str) -> str:
    return {"A": "C", "C": "G", "G": "T", "T": "A"}[base]


# ---- seeds ----


def test_smer_hash_is_its_closed_form():
    seq, s = gene(1, 60), 9
    table = dict(zip("ACGT", [0x9E3779B97F4A7C15, 0x6C62272E07BB0142, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], strict=True))
    got = smer_hashes(codes(seq), s)
    for i in range(len(seq) - s + 1):
        h = 0
        for b in seq[i : i + s]:
            h = ((h << 1 | h >> 63) & (2**64 - 1)) ^ table[b]
        assert int(got[i]) == h
    assert (smer_hashes(codes("ACGTNACGTAC"), 5)[:5] == TOP).all()


def test_syncmers_hold_their_smallest_smer_at_the_offset():
    seq = gene(2, 400)
    at, values = syncmers(seq, 15, 9, 3)
    h = smer_hashes(codes(seq), 9).tolist()
    want = [i for i in range(len(seq) - 14) if h[i : i + 7].index(min(h[i : i + 7])) == 3]
    assert at.tolist() == want and (values == kmer_values(codes(seq), 15)[at]).all()
    assert not len(syncmers("ACG", 15, 9, 3)[0])
    masked, _ = syncmers(seq[:200] + "N" + seq[201:], 15, 9, 3)
    assert not any(i <= 200 < i + 15 for i in masked.tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60) | st.lists(st.integers(0, 2**64 - 1), max_size=40) | st.integers(2, 50).map(lambda n: [x * x for x in range(n)]))
def test_parsing_covers_every_unit_in_order(values):
    blocks = parse(values)
    assert {i for a, b in blocks for i in range(a, b)} == set(range(len(values)))
    assert blocks == sorted(blocks, key=lambda x: x[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=4, max_size=40, unique=True))
def test_colours_differ_between_neighbours_in_rising_runs(values):
    colours = three_colours(sorted(values))
    assert set(colours) <= {0, 1, 2} and all(a != b for a, b in zip(colours, colours[1:], strict=False))


def test_local_extremes_take_open_ends():
    assert local_extremes([1, 2, 2, 0]) == ([True, False, False, True], [False, False, False, False])


def test_equal_neighbourhoods_share_seeds():
    core = gene(3, 900)
    a, la = read_seeds(gene(4, 150) + core)
    b, _ = read_seeds(core + gene(5, 200))
    assert len(np.intersect1d(a, b)) > 0.5 * min(len(a), len(b))
    assert (np.diff(a.astype(object)) > 0).all() and set(la) == {1, 2, 3}
    assert not len(np.intersect1d(read_seeds(gene(6, 900))[0], a))
    per = level_hashes(core, 15, 9, 3, 3)
    assert len(per) == 3 and len(per[0]) > len(per[1]) > len(per[2])
    assert not len(read_seeds("ACGT")[0])


# ---- greedy clustering ----


def unit_seeds(shared: int):
    h = np.array([*range(shared), *range(1000, 1020 - shared)], np.int64)
    return h, np.ones(len(h), np.int64)


@pytest.mark.parametrize(("fraction", "shared", "joins"), [(0.1, 3, True), (0.1, 2, False), (0.5, 9, False), (0.5, 10, True), (0.0, 3, True)])
def test_a_read_joins_with_enough_shared_weight(fraction, shared, joins):
    first = (np.arange(20), np.ones(20, np.int64))
    assert assign([first, unit_seeds(shared)], 3, fraction) == [0, 0 if joins else 1]


def test_reads_without_seeds_found_clusters_and_claims_last():
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert assign([none, none], 0, 0.0) == [0, 1]
    one = lambda *h: (np.array(h), np.ones(len(h), np.int64))
    assert assign([one(1, 2, 3), one(4, 5, 6), one(1, 4, 5), one(4, 5, 7)], 2, 0.0) == [0, 1, 1, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=5), min_size=1, max_size=14), st.integers(0, 4), st.sampled_from([0.0, 0.3, 1.0]))
def test_components_give_the_clusters_of_one_pass(sets, shared, fraction):
    reads = [(np.array(sorted(s), np.int64), np.ones(len(s), np.int64)) for s in sets]
    whole = assign(reads, shared, fraction)
    label = list(range(len(reads)))
    for _ in reads:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a & b:
                    label[i] = label[j] = min(label[i], label[j])
    founder = {}
    for c in sorted(set(label)):
        rows = [i for i in range(len(reads)) if label[i] == c]
        own = assign([reads[i] for i in rows], shared, fraction)
        for i, k in zip(rows, own, strict=True):
            founder[i] = next(r for r, x in zip(rows, own, strict=True) if x == k)
    order = {f: n for n, f in enumerate(sorted(set(founder.values())))}
    assert [order[founder[i]] for i in range(len(reads))] == whole


# ---- minimizers and chains ----


def test_minimizers_by_windows():
    seq = gene(7, 200)
    value, at = minimizers(seq, 7, 5)
    ks = kmer_values(codes(seq), 7).tolist()
    want = {min((ks[j], j) for j in range(i, i + 5)) for i in range(len(ks) - 4)}
    assert sorted(zip(value.tolist(), at.tolist(), strict=True)) == sorted(w for w in want if len(set(seq[w[1] : w[1] + 7])) > 1)
    assert not len(minimizers("A" * 50)[0])
    repeat = "ACGTTGCATCAGGATCCATG" * 4
    assert max(Counter(minimizers(repeat, 9, 4)[0].tolist()).values()) >= 3
    assert len(minimizers("ACGTACGTACGTACGTAC", 15, 10)[0]) == 4
    assert all(not p <= 100 < p + 15 for p in minimizers(gene(8, 100) + "N" + gene(9, 100))[1].tolist())


def test_anchors_pair_all_occurrences():
    a = (np.array([1, 1, 5]), np.array([3, 9, 4]))
    b = (np.array([1, 1, 2]), np.array([7, 8, 1]))
    assert sorted(map(tuple, anchors_of(a, b).tolist())) == [(3, 7), (3, 8), (9, 7), (9, 8)]


def longest_rising(points):
    best = {}
    for x, y in sorted(set(points)):
        best[x, y] = 1 + max((n for (u, v), n in best.items() if u < x and v < y), default=0)
    return max(best.values(), default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_chain_is_a_longest_rising_one(points):
    got = chain(np.array(points, np.int64).reshape(-1, 2))
    assert len(got) == longest_rising(points) or len(points) < 2
    assert (np.diff(got, axis=0) > 0).all()


# ---- alignment and placement ----


@settings(max_examples=80, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=14), st.text("ACGT", min_size=1, max_size=14))
def test_global_alignment_accounts_for_all_bases(a, b):
    got = global_summary(a, b)
    assert got.matches + got.mismatches <= min(len(a), len(b))
    assert (len(a) + len(b) - 2 * (got.matches + got.mismatches) == 0) == (got.longest_indel == 0)


def test_alignment_summaries():
    a = gene(10, 80)
    assert global_summary(a, a).identity == 1.0 and global_summary(a, "").longest_indel == 80
    cut = global_summary(a, a[:30] + a[37:])
    assert (cut.longest_indel, cut.mismatches) == (7, 0)
    changed = global_summary(a, a[:40] + swap(a[40]) + a[41:])
    assert (changed.matches, changed.mismatches, changed.longest_indel) == (79, 1, 0)


def test_flanks():
    a, b = gene(11, 60), gene(12, 60)
    f = extend(a, a + b, False)
    assert (f.unmatched, f.consumed, f.exhausted) == (0, 60, False)
    f = extend(b + a, a, True)
    assert f.unmatched == 60 and f.exhausted
    assert extend("", "ACG", False).exhausted is False and extend("ACG", "", False).unmatched == 3
    assert extend(a, b + b, False).unmatched > 25


def test_tails():
    assert is_tail("A" * 8 + "CC") and not is_tail("A" * 9) and not is_tail("ACACACACAC")
    assert strip_tails("ACG" + "T" * 11) == "ACGT" and strip_tails("ACG" + "T" * 10) == "ACG" + "T" * 10
    assert strip_tails("aA" * 6 + "CG") == "ACG" and strip_tails("") == "" and strip_tails("A" * 30) == "A"


@pytest.mark.parametrize("jump", [64, 0])
def test_a_skipped_exon_is_another_structure(jump):
    o = IsoformOptions(max_gap_jump=jump)
    whole = gene(13, 2000)
    skipped = whole[:900] + whole[1050:]
    assert place(skipped, whole, minimizers(skipped), minimizers(whole), o) == "interior_gap"
    part = whole[300:1800]
    assert place(part, whole, minimizers(part), minimizers(whole), o) == (300, 1800)
    over = "G" + whole
    assert place(over, whole, minimizers(over), minimizers(whole), o)[0] == -1
    assert place(gene(14, 900), whole, minimizers(gene(14, 900)), minimizers(whole), o) == "few_anchors"
    tailed = whole + "A" * 40
    assert place(tailed, whole, minimizers(tailed), minimizers(whole), o) == (0, 2000)


def test_structure_groups_take_the_longest_first():
    whole = gene(15, 1500)
    skipped = whole[:600] + whole[800:]
    seqs = [skipped, whole[200:], whole, skipped[100:]]
    groups, reasons = structure_groups(seqs, [minimizers(s) for s in seqs], IsoformOptions())
    assert [[m[0] for m in g] for g in groups] == [[2, 1], [0, 3]] and reasons == {"interior_gap": 2}


# ---- ends ----


def test_peaks_and_nearest():
    assert ends.peaks([5, 1, 2, 3, 100, 101, 102, 50], 10, 3) == [2, 101]
    assert ends.peaks([0, 10, 20, 30], 10, 3) == [] and ends.peaks([], 10, 1) == []
    assert ends.nearest([10, 20], 15, 5) == 10 and ends.nearest([10, 20], 15, 4) is None


def placed_group(starts_ends, o, seqs=None):
    seqs = seqs or ["A" * 2000] * len(starts_ends)
    return ends.Group([(i, s, e) for i, (s, e) in enumerate(starts_ends)], seqs, o)


def test_truncated_majority_stays_with_the_full_length_reads():
    rows = [(0, 2000), (3, 2000), (40, 1999), *[(800, 2000)] * 8]
    assert placed_group(rows, IsoformOptions(start_split="off")).split() == [(list(range(11)), False)]
    split = placed_group(rows, IsoformOptions(start_split="on", boundary_tol=10)).split()
    assert [len(m) for m, _ in split] == [8]


def test_two_ends_are_two_isoforms():
    rows = [(0, 2000)] * 4 + [(0, 1500)] * 4
    got = placed_group(rows, IsoformOptions(start_split="off", boundary_tol=50)).split()
    assert sorted(sorted(m) for m, _ in got) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_stop_fraction_counts_those_that_pass():
    g = placed_group([(0, 2000), (100, 2000), (800, 2000), (790, 2000), (0, 700), (805, 2000), (810, 2000), (795, 2000), (800, 2000), (799, 2000)], IsoformOptions())
    assert g.stop_fraction(800, 7) == 7 / 9


def alternative_start_group(capped: bool, smear: bool = False):
    tx = "".join(random.Random(16).choices("ACT", k=2000))
    rows, seqs = [(0, 2000)], [tx]
    for _ in range(2):
        rows.append((0, 2000))
        seqs.append(tx)
    for i in range(6):
        start = 800 + (30 * i if smear else 0)
        rows.append((start, 2000))
        seqs.append(("G" if capped else "") + tx[start:])
    for start in range(120, 1900, 120):
        rows.append((start, 2000))
        seqs.append(tx[start:])
    return rows, seqs


def test_capped_start_is_kept_and_uncapped_folded():
    signal = StartLibrary(True, 0.5, 0.42)
    for capped, alt in ((True, 1), (False, 0)):
        rows, seqs = alternative_start_group(capped)
        got = placed_group(rows, IsoformOptions(library=signal), seqs).split()
        assert sum(a for _, a in got) == alt
    rows, seqs = alternative_start_group(True)
    assert sum(a for _, a in placed_group(rows, IsoformOptions(cap_signal="off", stop_threshold=0.9), seqs).split()) == 0
    assert sum(a for _, a in placed_group(rows, IsoformOptions(cap_signal="off", stop_threshold=0.3), seqs).split()) >= 1
    assert ends.lead("G" + seqs[0][800:900], seqs[0], 800) == (1, "G") and ends.lead("GGGGACGT", seqs[0], 0) is None


def test_marks_give_the_alignment_of_whole_tables():
    """The way back over one byte a cell against the one over all scores."""
    r = np.random.default_rng(12)
    for _ in range(150):
        a = "".join(r.choice(list("ACG"), r.integers(1, 40)))
        b = list(a)
        for _ in range(r.integers(0, 8)):
            at = r.integers(0, len(b) + 1)
            b[at : at + r.integers(0, 4)] = list(r.choice(list("ACG"), r.integers(0, 4)))
        b = "".join(b) or "A"
        x, y = align._letters(a), align._letters(b)
        best, down, along = (np.stack(t) for t in zip(*align._rows(x, y), strict=True))
        marks = align._marks(x, y)
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                m = marks[i, j]
                if i and j:
                    assert bool(m & align.DIAGONAL) == (best[i, j] == best[i - 1, j - 1] + (1 if x[i - 1] == y[j - 1] else -1))
                if i:
                    assert bool(m & align.DOWN) == (best[i, j] == down[i, j])
                    assert bool(m & align.MORE_DOWN) == (down[i, j] == down[i - 1, j] + align.EXTEND)
                if j:
                    assert bool(m & align.MORE_ALONG) == (along[i, j] == along[i, j - 1] + align.EXTEND)
    long = "".join(r.choice(list("ACGT"), 3000))
    found = align.global_summary("A" + long + "C", "G" + long[:1500] + long[1510:] + "T")
    assert found.longest_indel == 10 and found.matches >= 2988


def test_otsu_and_library():
    assert 0.05 < ends.otsu([0.05] * 80 + [0.9] * 60) <= 0.9 and ends.otsu([0.5]) == 0.7
    o = IsoformOptions()
    stats = ends.StartStats(1000, 400, [(0.02, 0.1)] * 80 + [(0.9, 0.6)] * 60, [0.03] * 90 + [0.8] * 40)
    got = stats.library(o)
    assert got.cap_signal and 0.02 <= got.threshold <= 0.9 and 0.03 <= got.stop_fraction <= 0.8
    blunt = ends.StartStats(1000, 400, [(0.02, 0.6)] * 80 + [(0.9, 0.1)] * 60)
    assert not blunt.library(o).cap_signal
    few = ends.StartStats(9, 9, [(0.9, 0.6)])
    assert few.library(o) == StartLibrary(False, 0.7, 0.42)
    assert ends.StartStats(100, 10).library(IsoformOptions(cap_signal="on", cap_threshold=0.3, stop_threshold=0.1)) == StartLibrary(True, 0.3, 0.1)
    assert ends.rank_test(np.array([1.0, 2.0, 3.0]), np.array([False, True, True]))[1] == 1.0 and ends.rank_test(np.array([1.0]), np.array([True])) == (0.0, 0.5)


# ---- consensus ----


def voted(seqs, members=None, **k):
    maps = [minimizers(s) for s in seqs]
    members = members if members is not None else list(range(len(seqs)))
    return consensus(seqs, maps, members, list(range(len(seqs))), **k)


def test_backbone_errors_are_outvoted_locally():
    tx = gene(17, 900)
    bad = tx[:450] + swap(tx[450]) + tx[451:]
    assert voted([bad + "AC", tx[20:], tx[30:], tx[40:]]) == tx + "AC"
    late = tx[:100] + swap(tx[100]) + tx[101:]
    assert voted([late + "A", tx[:-3], tx[:-2], *[tx[500:]] * 6]) == tx + "A"
    deleted = tx[:450] + tx[451:]
    assert voted([tx + "A", deleted, tx[5:]]) == tx + "A"


def test_a_tie_keeps_the_backbone_and_helpers_break_it():
    tx = gene(18, 900)
    bad = tx[:300] + swap(tx[300]) + tx[301:] + "A"
    assert voted([bad, tx]) == bad
    assert voted([bad, tx, tx[10:], tx[20:]], [0, 1]) == tx + "A"


def test_leading_gs_and_tails():
    tx = "ACT" + gene(19, 700)
    seqs = ["G" + tx, "G" + tx, tx, "G" + tx, "G" + tx]
    assert voted(seqs, trim_caps=True) == tx and voted(seqs) == "G" + tx
    assert untemplated("GACT", ["GACT", "GACT", "GGACT"]) == 1 and untemplated("GACT", ["GACT", "GGACT", "GGACT"]) == 0
    ended = [tx, tx[:-9], tx[:-9], tx[:-9]]
    assert voted(ended) == tx and voted(ended, vote_tail=True) == tx[:-9]
    assert modal(Counter({"AC": 2, "AA": 2}), "AC") == "AC" and modal(Counter({"AC": 2, "AA": 2}), "T") == "AA" and modal(Counter(), "T") == "T"
    assert voted(["ACGT"]) == "ACGT"


# ---- merging ----


def iso(n, seq, alt=False):
    return Isoform(list(range(n)), seq, alt)


def merged(a, b, **k):
    """`b` is the smaller."""
    return Merger(IsoformOptions(**k)).decide(b, a)


def test_contained_and_extending_isoforms():
    tx = gene(20, 1500)
    assert merged(iso(20, tx), iso(4, tx[300:])) == "merge"
    assert merged(iso(20, tx), iso(15, tx[300:])) == "apart"
    assert merged(iso(20, tx[300:]), iso(4, tx)) == "rebuild"
    assert merged(iso(20, tx[:1400]), iso(4, tx)) == "rebuild"
    assert merged(iso(20, tx), iso(15, tx)) == "merge"
    assert merged(iso(20, tx), iso(4, tx[:600] + tx[800:])) == "apart"


def test_validated_starts_are_protected():
    tx = gene(21, 1500)
    assert merged(iso(20, tx), iso(4, tx[300:], True)) == "apart"
    assert merged(iso(20, tx), iso(4, tx[300:], True), alt_starts="merge") == "merge"
    assert merged(iso(20, tx[300:], True), iso(4, tx)) == "apart"


def test_internal_priming_decides_ends():
    tx = gene(22, 1500)
    rich = tx[:1200] + "A" * 18 + tx[1218:]
    assert merged(iso(20, rich), iso(15, rich[:1200]), end_merge="polya") == "merge"
    assert merged(iso(20, tx), iso(4, tx[:1200]), end_merge="polya") == ("merge" if primed(tx, 1200, IsoformOptions()) else "apart")
    assert merged(iso(20, rich[:1200]), iso(15, rich), end_merge="polya") == "rebuild"
    assert not primed("ACGT", 9, IsoformOptions())


def test_start_variants_are_reported_with_sign():
    tx = gene(23, 1200)
    m = Merger(IsoformOptions())
    assert m.variant(iso(9, tx[30:]), iso(20, tx)) == 30 and m.variant(iso(9, tx), iso(20, tx[30:])) == -30
    assert m.variant(iso(9, tx[90:]), iso(20, tx)) is None
    seqs = [tx] * 20 + [tx[30:]] * 15
    maps = [minimizers(s) for s in seqs]
    drafts = lambda: [Isoform(list(range(20)), tx), Isoform(list(range(20, 35)), tx[30:])]
    got = Merger(IsoformOptions()).merged(drafts(), seqs, maps)
    assert [(len(x.members), x.variant_of, x.offset) for x in got] == [(20, None, None), (15, 0, 30)]
    got = Merger(IsoformOptions(start_variants="keep")).merged(drafts(), seqs, maps)
    assert [x.variant_of for x in got] == [None, None]
    assert near_identical(tx + "A" * 30, tx + "A" * 20, IsoformOptions()) and not near_identical(tx, tx[10:], IsoformOptions())


def test_isoforms_of_a_cluster():
    tx = gene(24, 1300)
    skipped = tx[:500] + tx[700:]
    seqs = [tx, tx[4:], tx[2:], tx[:-2], skipped, skipped[3:], skipped[:-1], gene(25, 800)]
    got = isoforms_of(seqs, IsoformOptions(start_split="off"))
    assert sorted((sorted(x.members), x.consensus) for x in got) == [([0, 1, 2, 3], tx), ([4, 5, 6], skipped)]


@pytest.mark.parametrize("bad", [{"max_occ_frac": 1.5}, {"s": 20}, {"t": 9}, {"levels": 0}])
def test_cluster_options_are_checked(bad):
    with pytest.raises(ValueError):
        ClusterOptions(**bad)


@pytest.mark.parametrize("bad", [{"start_split": "no"}, {"w": 0}, {"min_iso": 0}, {"end_merge": "x"}])
def test_isoform_options_are_checked(bad):
    with pytest.raises(ValueError):
        IsoformOptions(**bad)
