"""Exact substring deduplication: every byte covered by a string of `length` bytes that also starts earlier goes.

Suffix arrays of the whole corpus would be many times its size, so shards hold only text that can
repeat:

1. Anchors. Of each window of `length` bytes the smallest-hashed GRAM-byte gram is its anchor, so
   equal windows have equal anchors at equal offsets. Neighbouring windows with the same anchor
   form a segment. An anchor that occurs once cannot lie in a repeat: its text goes no further.
2. Segments of equal anchor and equal content (a 128-bit digest and the offsets) are one distinct
   segment; its occurrences after the first are repeats as a whole. Each task does this for what
   it reads before anything is shuffled, so a group of copies costs one row a task.
3. Distinct segments that share an anchor but differ (the edges of passages, edited copies) are
   gathered in shards by anchor. Each shard's suffix array is made by induced sorting: suffixes
   are classified, leftmost-smaller substrings sorted and named, recursively until the names
   differ, and the rest induced bucket by bucket; permuted common prefixes, of which only the
   irreducible are compared, then tell which windows are equal. All but the earliest are repeats.
4. A document's repeats are united and cut out.

A window of one document is compared with the windows of all others exactly once, at its anchor.
An anchor with more than SHARD_SEGMENTS differing segments doesn't fit a shard; its windows are
compared by digest in a plain aggregation instead, and nothing is dropped.

Defined results: a null or empty text has nothing to remove; texts shorter than `length` are left
whole; doc_id names a text, so rows that repeat a doc_id are one text and give repeated rows;
a text with a null doc_id is left whole and repeats nobody; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm import textkernel as K
from isoloom.runtime import prepare, written

LENGTH = 100
GRAM = 32
#: Anchors a task holds before it unites equal segments.
HELD_ANCHORS = 1_000_000
#: Segments of one anchor that a shard takes, and bytes of a shard (but for one larger anchor).
SHARD_SEGMENTS, SHARD_BYTES = 20_000, 1 << 20
#: In a location: the offset of the anchor that says it is a repeat, not an anchor.
REPEAT = 1023


# ---- suffix arrays ----


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the last is larger than the end."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    smaller = np.zeros(n, bool)
    if len(differs):
        at = np.searchsorted(differs, np.arange(n))
        known = at < len(differs)
        d = differs[at[known]]
        smaller[known] = t[d] < t[d + 1]
    return smaller


class _Buckets:
    """Where each letter's suffixes stand, and the free places at their heads and tails."""

    def __init__(self, t: np.ndarray):
        counts = np.bincount(t)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.letters = np.flatnonzero(counts)


def _append(sa: np.ndarray, heads: np.ndarray, letters: np.ndarray, values: np.ndarray, step: int) -> None:
    """Put values at the next free places of their letters' buckets, in order: forwards (1) or backwards (-1)."""
    if not len(letters):
        return
    order = np.argsort(letters.astype(np.uint16) if heads.size <= 1 << 16 else letters, kind="stable")
    sorted_letters = letters[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_letters[1:] != sorted_letters[:-1]]))
    counts = np.diff(np.append(edge, len(order)))
    within = np.arange(len(order)) - np.repeat(edge, counts)
    sa[heads[sorted_letters] + step * within] = values[order]
    heads[sorted_letters[edge]] += step * counts


def induce(t: np.ndarray, smaller: np.ndarray, buckets: _Buckets, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes from an order of the leftmost-smaller ones, whole buckets at a time."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    heads, tails = buckets.starts.copy(), buckets.ends - 1
    lms_tails = buckets.ends - 1
    back = lms[::-1]
    _append(sa, lms_tails, t[back], back, -1)

    def pull(now: np.ndarray, ends: np.ndarray, want: bool, letter: int, step: int) -> np.ndarray:
        """Place what precedes `now` and has the wanted type; those of the same bucket come back for the next round."""
        before = now[now > 0] - 1
        before = before[smaller[before] == want]
        if not len(before):
            return before
        letters = t[before]
        _append(sa, ends, letters, before, step)
        return before[letters == letter]

    # Larger suffixes, first letter up; the last suffix comes before all others of its letter.
    sa[heads[t[-1]]] = n - 1
    heads[t[-1]] += 1
    for c in buckets.letters:
        at, end = buckets.starts[c], heads[c]
        now = sa[at:end]
        while len(now):
            now = pull(now, heads, False, c, 1)
        tail = sa[lms_tails[c] + 1 : buckets.ends[c]]
        if len(tail):
            pull(tail, heads, False, -1, 1)
    # Smaller suffixes, last letter down; they replace the leftmost-smaller ones placed above.
    for c in buckets.letters[::-1]:
        sa_end = buckets.ends[c]
        now = sa[tails[c] + 1 : sa_end][::-1]
        while len(now):
            now = pull(now, tails, True, c, -1)
        large = sa[buckets.starts[c] : heads[c]][::-1]
        if len(large):
            same = pull(large, tails, True, c, -1)
            while len(same):
                same = pull(same, tails, True, c, -1)
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order by doubling ranks: ends the recursion where the alphabet is too large for buckets."""
    n, rank, h = len(names), names.astype(np.int64) + 1, 1
    while True:
        key = rank * (n + 2)
        key[: n - h] += rank[h:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        rank[order] = new
        if new[-1] == n or h >= n:
            return order
        h *= 2


#: Letters up to which whole buckets are worth their overhead.
MOST_LETTERS = 4096


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting; t holds small whole numbers, and its end is smaller than any."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    smaller = suffix_types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    buckets = _Buckets(t)
    if not len(lms):
        return induce(t, smaller, buckets, lms)
    in_order = induce(t, smaller, buckets, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = in_order[is_lms[in_order]]
    # Name the leftmost-smaller substrings: equal neighbours in the order share a name.
    ends = np.append(lms[1:] + 1, n)
    end_of = np.zeros(n, np.int64)
    end_of[lms] = ends
    size = end_of[in_order] - in_order
    same = np.zeros(len(lms), bool)
    same[1:] = (size[1:] == size[:-1]) & (end_of[in_order[1:]] < n) & (end_of[in_order[:-1]] < n)
    active, k = np.flatnonzero(same), 0
    while len(active):
        a, b = in_order[active], in_order[active - 1]
        differ = (t[a + k] != t[b + k]) | (smaller[a + k] != smaller[b + k])
        same[active[differ]] = False
        k += 1
        active = active[~differ & (size[active] > k)]
    names = np.zeros(n, np.int64)
    names[in_order] = np.cumsum(~same) - 1
    reduced = names[lms]
    most = int(reduced.max()) + 1
    if most == len(lms):
        order = np.argsort(reduced)
    elif most <= MOST_LETTERS:
        order = suffix_array(reduced)
    else:
        order = _doubled(reduced)
    return induce(t, smaller, buckets, lms[order])


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, the length it shares with its predecessor in the array.

    A value is reducible where the letters before the two suffixes agree: then it is one less
    than the value before. Only the others are compared, eight bytes at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    plain = np.zeros(n + 8, np.uint8)
    plain[:n] = t
    words = np.lib.stride_tricks.as_strided(plain.view(), (n, 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    prev = phi - 1
    at = np.arange(n)
    reducible = (at > 0) & (prev >= 0)
    reducible[reducible] = t[at[reducible] - 1] == t[prev[reducible]]
    start = np.flatnonzero(~reducible)
    plcp = np.zeros(n, np.int64)
    active = start[phi[start] >= 0]
    shared = np.zeros(n, np.int64)
    while len(active):
        a, b = active + shared[active], phi[active] + shared[active]
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        room = n - np.maximum(a, b)
        low = np.where(x == 0, 8, np.bitwise_count((x & (~x + K.U(1))) - K.U(1)).astype(np.int64) // 8)
        shared[active] += np.minimum(low, room)
        active = active[(low == 8) & (room > 8)]
    plcp[start] = shared[start]
    last = np.maximum.accumulate(np.where(reducible, -1, at))
    return np.maximum(plcp[last] - (at - last), 0)


def window_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a shard, and for each of its entries the class of the window that starts there."""
    sa = suffix_array(text.astype(np.int64))
    plcp = permuted_lcp(text, sa)
    return sa, np.cumsum(plcp[sa] < length) - 1


# ---- anchors ----


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of a batch: row, anchor hash, content hash, first and last window start, anchor position (all in the batch)."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    ok = np.diff(offsets) >= length
    if not ok.any():
        return none, none.view(K.U), none.view(K.U), none, none, none
    prefix = K.prefix_hash(buf)
    h = K.scaled(prefix[gram:] - prefix[:-gram], K.INVERSE)
    h *= K.U(0x9E3779B97F4A7C15)
    h ^= h >> K.U(29)
    h *= K.U(0xBF58476D1CE4E5B9)
    least = (h & K.U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=K.U)
    width, want = 1, length - gram + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, offsets[:-1][ok], 1)
    np.add.at(inside, offsets[1:][ok] - (length - 1), -1)
    at = np.flatnonzero(np.cumsum(inside)[: n - length + 1])
    where = (least[at] & K.U(0xFFFFFFFF)).astype(np.int64)
    edge = np.concatenate([[True], (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(at)) - 1
    a, b, p = at[first], at[last], where[first]
    content = K.span_hash(prefix, a, b + length) + (p - a).astype(K.U) * K.U(0xA0761D6478BD642F)
    return np.searchsorted(offsets, a, "right") - 1, h[p], K.mix(content), a, b, p


def locations(a: np.ndarray, b: np.ndarray, offset) -> np.ndarray:
    """A segment in one number: its first window start, its further starts, and the anchor's offset."""
    return a << 20 | (b - a) << 10 | offset


ANCHORS = "h long, s long, doc_id long, loc long"


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def united() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        again = np.zeros(len(rows), bool)
        again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        rows[again, 3] |= REPEAT
        rows[again, 0] = K.mix(rows[again, 2].astype(K.U)).astype(np.int64)  # on to the next step, anywhere
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], names=["h", "s", "doc_id", "loc"])

    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for lo, _, buf, offsets in K.text_chunks(batch.column("text")):
            row, h, s, a, b, p = anchors(buf, offsets, length, gram)
            if len(row):
                base = offsets[row]
                held.append(np.stack([h.view(np.int64), s.view(np.int64), ids[lo + row], locations(a - base, b - base, p - a)], axis=1))
                size += len(row)
            if size >= HELD_ANCHORS:
                yield united()
                held, size = [], 0
    if size:
        yield united()


def _compared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and content in; repeats (kind 0), segments for shards (1) and of crowded anchors (2) out."""
    rest = np.zeros((0, 4), np.int64)
    for batch in _with_end(batches):
        if batch is not None:
            rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy() for c in ("h", "s", "doc_id", "loc")], axis=1)])
        if not len(rest):
            continue
        end = len(rest) if batch is None else int(np.searchsorted(rest[:, 0], rest[-1, 0]))
        rows, rest = rest[:end], rest[end:]
        if not len(rows):
            continue
        marked = (rows[:, 3] & REPEAT) == REPEAT
        found = [rows[marked]]
        rows = rows[~marked]
        kinds = [np.zeros(len(found[0]), np.int8)]
        if len(rows):
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            again = rows[~new]
            again[:, 3] |= REPEAT
            first = rows[new]
            edge = np.flatnonzero(np.concatenate([[True], first[1:, 0] != first[:-1, 0]]))
            counts = np.repeat(np.diff(np.append(edge, len(first))), np.diff(np.append(edge, len(first))))
            several = first[counts > 1]
            found += [again, several]
            kinds += [np.zeros(len(again), np.int8), np.where(counts[counts > 1] > most, 2, 1).astype(np.int8)]
        out = np.concatenate(found)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(out[:, 0]), pa.array(out[:, 2]), pa.array(out[:, 3])], names=["kind", "h", "doc_id", "loc"])


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def shard_repeats(docs: np.ndarray, locs: np.ndarray, segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's segments, the runs of windows that also start earlier: doc_ids and locations."""
    _, once = np.unique(np.stack([docs, locs]), axis=1, return_index=True)
    docs, locs, segments = docs[once], locs[once], [segments[i] for i in once.tolist()]
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), np.uint8)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), sizes)
    sa, group = window_classes(text, length)
    starts = sa - base[owner[sa]]
    valid = starts + length <= sizes[owner[sa]]
    sa, group, starts = sa[valid], group[valid], starts[valid]
    own = owner[sa]
    order = np.lexsort(((locs[own] >> 20) + starts, docs[own], group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    at = np.sort(sa[order][later])  # places in the shard's text: windows of a segment are neighbours
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]))
    last = at[np.append(edge[1:], len(at)) - 1]
    first = at[edge]
    o = owner[first]
    a = (locs[o] >> 20) + first - base[o]
    return docs[o], locations(a, a + last - first, REPEAT)


def _sharded(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor in, their repeats out; a shard holds whole anchors."""
    keys, docs, locs, segments, size = [], [], [], [], 0

    def done(upto: int) -> pa.RecordBatch:
        d, x = shard_repeats(np.array(docs[:upto], np.int64), np.array(locs[:upto], np.int64), segments[:upto], length)
        del keys[:upto], docs[:upto], locs[:upto], segments[:upto]
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(x)], names=["doc_id", "loc"])

    for batch in batches:
        for h, d, x, s in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "loc", "segment")), strict=True):
            if size >= shard_bytes and h != keys[-1]:
                yield done(len(keys))
                size = 0
            keys.append(h)
            docs.append(d)
            locs.append(x)
            segments.append(s)
            size += len(s)
    if keys:
        yield done(len(keys))


def covered(locs: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal removed runs of a document from its repeats."""
    a, e = locs >> 20, (locs >> 20) + (locs >> 10 & 1023) + length
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], a[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return a[first], e[np.append(first[1:], len(a)) - 1]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = SHARD_SEGMENTS, shard_bytes: int = SHARD_BYTES, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, the extra columns, marks): every document with the locations of its repeats."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"_x_{c}") for c in extra))
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    plain = nameless.select("doc_id", "text", *(F.col(f"_x_{c}").alias(c) for c in extra), F.array().cast("array<long>").alias("marks"))
    found = docs.select("doc_id", "text").mapInArrow(lambda it: _anchored(it, length, gram), ANCHORS)
    compared = found.repartition("h").sortWithinPartitions("h", "s", "doc_id", "loc").mapInArrow(lambda it: _compared(it, most), "kind tinyint, h long, doc_id long, loc long")
    ours = written(compared.groupBy("doc_id").agg(F.collect_list(F.when(F.col("kind") == 0, F.col("loc"))).alias("marks"), F.collect_list(F.when(F.col("kind") > 0, F.struct("kind", "h", "loc"))).alias("open")), "repeats")
    texts = docs.join(ours, "doc_id", "left")
    cut = "transform(open, x -> struct(x.kind AS kind, x.h AS h, x.loc AS loc, substring(b, int(shiftright(x.loc, 20)) + 1, int(shiftright(x.loc, 10) & 1023) + %d) AS segment))" % length
    segments = texts.where("size(open) > 0").select("doc_id", F.col("text").cast("binary").alias("b"), "open").select("doc_id", F.explode(F.expr(cut)).alias("x")).select("doc_id", "x.*")
    normal = segments.where("kind = 1").select("h", "doc_id", "loc", "segment")
    edges = normal.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _sharded(it, length, shard_bytes), "doc_id long, loc long")
    if not ours.where("exists(open, x -> x.kind = 2)").isEmpty():
        edges = edges.unionByName(_crowded(segments.where("kind = 2"), length))
    more = edges.groupBy("doc_id").agg(F.collect_list("loc").alias("more"))
    out = texts.join(more, "doc_id", "left").select("doc_id", "text", *(F.col(f"_x_{c}").alias(c) for c in extra), F.concat(F.coalesce("marks", F.array().cast("array<long>")), F.coalesce("more", F.array().cast("array<long>"))).alias("marks"))
    return out.unionByName(plain)


def _crowded(segments: DataFrame, length: int) -> DataFrame:
    """Repeats of anchors with too many differing segments for a shard: each window by its digest."""
    windows = segments.select("doc_id", F.expr("shiftright(loc, 20) AS a"), F.expr("posexplode(sequence(0, int(shiftright(loc, 10) & 1023))) AS (i, j)"), "segment")
    windows = windows.select("doc_id", (F.col("a") + F.col("i")).alias("a"), F.sha2(F.expr("substring(segment, i + 1, %d)" % length), 256).alias("w"))
    first = windows.groupBy("w").agg(F.min(F.struct("doc_id", "a")).alias("first"))
    return windows.join(first, "w").where(F.struct("doc_id", "a") != F.col("first")).select("doc_id", F.expr(f"shiftleft(a, 20) | {REPEAT} AS loc"))


def without(data: bytes | None, marks: pa.Array | None, length: int = LENGTH) -> bytes:
    """A document's bytes without its repeats."""
    data = data or b""
    if marks is None or not len(marks):
        return data
    first, end = covered(marks.to_numpy(), length, len(data))
    bounds = [0, *(x for pair in zip(first.tolist(), end.tolist(), strict=True) for x in pair), len(data)]
    return b"".join([data[s:e] for s, e in zip(bounds[::2], bounds[1::2], strict=True)])


def kept(docs: DataFrame, length: int = LENGTH, **parameters) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document's bytes without its repeats."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return repeats(docs, length, **parameters).select("doc_id", "marks", F.col("text").cast("binary").alias("b")).mapInArrow(lambda it: _cut(it, length, bytes, pa.binary(), "kept"), schema)


def digests(docs: DataFrame, length: int = LENGTH, **parameters) -> DataFrame:
    """As `kept`, with the digest of the remaining bytes in their place."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats(docs, length, **parameters).select("doc_id", "marks", F.col("text").cast("binary").alias("b")).mapInArrow(lambda it: _cut(it, length, lambda b: hashlib.sha256(b).hexdigest(), pa.string(), "kept_sha256"), schema)


def _cut(batches: Iterator[pa.RecordBatch], length: int, make, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, out = [], [], [], []
        marks = batch.column("marks")
        for i in range(batch.num_rows):
            data, here = batch.column("b")[i].as_py() or b"", marks[i].values
            n, r, k = len(data), 0, 0
            if here is not None and len(here):
                first, end = covered(here.to_numpy(), length, n)
                r, k = int((end - first).sum()), len(first)
                data = without(data, here, length)
            sizes.append(n)
            removed.append(r)
            spans.append(k)
            out.append(make(data))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(out, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])
