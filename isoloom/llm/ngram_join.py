"""Jaccard join of documents on word n-grams, as a blocked sparse product of the document by n-gram incidence.

A document is a row of the incidence matrix: the set of hashes of its word n-grams (A-Z lower
case, words split at ASCII white space). Two documents link when their sets' Jaccard similarity
reaches the threshold, tested in whole numbers. The product is never made whole:

* Documents of equal sets are one class; only its smallest doc_id takes part from then on.
* In a fixed order of n-grams, two linked documents share one of the first `size - ceil(t * size)
  + 1` of each. Only those prefixes form the incidence that is multiplied, dealt out in blocks of
  n-grams. The order puts the longest n-grams first, as they are rare, and known frequent ones
  last; any order gives the same links.
* A block gives each of its columns as the list of its documents, one row a column, however many
  blocks there are. Columns of the same documents are united, wherever they were, and squared once;
  for each pair of documents this adds up the n-grams shared in the prefixes. What two documents
  share beyond lies behind the prefix that ends first, so a pair whose count, with the larger rest,
  stays below what the two sizes require is discarded; the others are counted over their whole sets.
* A column with more than LONG documents is not squared. Each of its documents is first compared
  with the column's head; components of those links are contracted. Columns with the same head are
  then multiplied together in blocks of documents, and only pairs across components whose counts
  can still be enough leave the block. So a group of near copies costs its size, and nothing is
  dropped.

Components come from operators.components; no links, sets or labels reach the driver. The driver
only sees the frequent n-grams, at most FREQUENT of them, which set the order.

Defined results: a null text, or one without words, has an empty set and is linked with nothing;
fewer words than n make one n-gram of all of them; doc_id names a text, and rows that repeat it give
repeated rows; a row with a null doc_id links nobody, and has the component of the documents with an
equal set, or null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm import textkernel as K
from isoloom.operators.components import components
from isoloom.runtime import discard, prepare, written

#: Most n-grams that the order puts last; 8 bytes each go to every task.
FREQUENT = 100_000
#: A task looks for n-grams that recur among so many hashes at a time, at least so often.
SURVEY_HASHES, SURVEY_TIMES = 2_000_000, 12
#: Documents in a column of the product that is squared at once.
LONG = 48
#: Rows of one block of a longer column.
BLOCK = 512


def need(a, b, num: int, den: int):
    """The overlap that sets of these sizes need."""
    return -(-(num * (a + b)) // (num + den))


def prefix_length(size, num: int, den: int):
    return size + (-(num * size) // den) + 1


def document_keys(buf: np.ndarray, offsets: np.ndarray, n: int, frequent: np.ndarray) -> Iterator[np.ndarray]:
    """Each document's n-grams as sorted distinct keys: frequent last, long before short, then by hash."""
    starts, ends, bounds = K.word_spans(buf, offsets)
    words = K.span_hash(K.prefix_hash(buf, lower=True), starts, ends)
    hashes, rows = K.shingle_hashes(words, bounds, n)
    sums = np.concatenate([[0], np.cumsum(ends - starts)])
    counts = np.diff(bounds)
    first = np.arange(len(words))
    inside = first - bounds[:-1][np.repeat(np.arange(len(counts)), counts)]
    of = np.repeat(counts, counts)
    first = first[(inside + n <= of) | ((inside == 0) & (of < n))]
    last = np.minimum(first + n, bounds[1:][rows])
    long = np.minimum(sums[last] - sums[first], 127).astype(K.U)
    keys = (K.U(127) - long) << K.U(55) | hashes >> K.U(9)
    if len(frequent) and len(keys):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        keys |= (frequent[at] == keys).astype(K.U) << K.U(62)
    cut = np.searchsorted(rows, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        k = np.sort(keys[cut[i] : cut[i + 1]])
        yield k[np.concatenate([[True], k[1:] != k[:-1]])] if len(k) else k


def frequent_keys(docs: DataFrame, n: int, most: int = FREQUENT, times: int = SURVEY_TIMES) -> np.ndarray:
    """Keys of n-grams that recur in many documents, at most `most`; they only steer the order, so an estimate will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def found() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            found_times = np.diff(np.append(edge, len(every)))
            often = found_times >= times
            return pa.RecordBatch.from_arrays([pa.array(every[edge[often]].astype(np.int64)), pa.array(found_times[often])], names=["key", "times"])

        none = np.zeros(0, K.U)
        for batch in batches:
            for _, _, buf, offsets in K.text_chunks(batch.column("text")):
                for keys in document_keys(buf, offsets, n, none):
                    held.append(keys)
                    size += len(keys)
                if size >= SURVEY_HASHES:
                    yield found()
                    held, size = [], 0
        if size:
            yield found()

    table = docs.select("text").mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    top = table.orderBy(F.desc("times"), "key").limit(most).select("key").toPandas()
    return np.sort(top["key"].to_numpy().astype(K.U))


def _columns(batches: Iterator[pa.RecordBatch], most: int = LONG, together: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and document in; out: the members of each short column (kind 0), the rows of long ones (kind 1),
    and how many columns a hot document has for itself (kind 2)."""

    def out(kind: int, key: np.ndarray, doc: np.ndarray, size: np.ndarray, n: np.ndarray, members: pa.Array | None = None) -> pa.RecordBatch:
        numbers = [pa.array(c.astype(np.int64)) for c in (key, doc, size, n)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), *numbers, pa.nulls(len(key), MEMBERS) if members is None else members], names=["kind", "key", "doc_id", "size", "n", "members"])

    held: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    ready = 0

    def gathered() -> pa.RecordBatch:
        rows, counts = np.concatenate(held), np.concatenate(lengths)
        members = pa.StructArray.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2])], names=["doc_id", "size"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), members)
        zero = np.zeros(len(counts))
        return out(0, zero, zero, zero, zero, lists)

    lonely: dict[int, int] = {}
    rest, open_key = np.zeros((0, 4), np.int64), None
    for batch in _with_end(batches):
        if batch is not None:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "doc_id", "size", "hot")], axis=1)
            rest = np.concatenate([rest, rows])
        if not len(rest):
            continue
        end = len(rest) if batch is None else int(np.searchsorted(rest[:, 0], rest[-1, 0]))
        now, rest = rest[:end], rest[end:]
        if len(now):
            edge = np.flatnonzero(np.concatenate([[True], now[1:, 0] != now[:-1, 0]]))
            lasting = np.diff(np.append(edge, len(now)))
            counts = lasting.copy()
            if now[0, 0] == open_key:
                counts[0] = max(counts[0], most + 1)  # its first rows have gone out
            long = np.repeat(counts > most, lasting)
            if long.any():
                x = now[long]
                yield out(1, x[:, 0], x[:, 1], x[:, 2], np.zeros(len(x)))
            alone = now[edge[counts == 1]]
            for doc, n in zip(*np.unique(alone[alone[:, 3] > 0, 1], return_counts=True), strict=True):
                lonely[int(doc)] = lonely.get(int(doc), 0) + int(n)
            short = (counts > 1) & (counts <= most)
            if short.any():
                held.append(now[np.repeat(short, lasting)])
                lengths.append(counts[short])
                ready += len(held[-1])
                if ready > together:
                    yield gathered()
                    held, lengths, ready = [], [], 0
        if len(rest) > most:  # a long column goes out as it comes, however long it is
            open_key = rest[0, 0]
            yield out(1, rest[:, 0], rest[:, 1], rest[:, 2], np.zeros(len(rest)))
            rest = rest[:0]
    if ready:
        yield gathered()
    if lonely:
        zero = np.zeros(len(lonely))
        yield out(2, zero, np.array(list(lonely)), zero, np.array(list(lonely.values())))


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


COLUMNS = "kind tinyint, key long, doc_id long, size long, n long, members array<struct<doc_id: long, size: long>>"
MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("size", pa.int64())]))


def squared(short: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, a_size, b_size, n) of the documents in columns (members); columns of the same members are squared once."""
    once = short.groupBy("members").agg(F.count("*").alias("n"))
    left = once.select("members", "n", F.posexplode("members").alias("i", "x"))
    both = left.select("n", "x", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("y"))
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    able = both.where((F.col("x.doc_id") != F.col("y.doc_id")) & (small * den >= large * num))
    return able.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.size").alias("a_size"), F.col("y.size").alias("b_size"), "n")


def sets_of(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(doc_id, keys) of every document in the pairs, made once and written."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in K.text_chunks(batch.column("text")):
                packed = [k.tobytes() for k in document_keys(buf, offsets, n, np.zeros(0, K.U))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["doc_id", "keys"])

    # The same plan at every size: the ids grow with the corpus, so they are never broadcast.
    made = docs.select("doc_id", "text").join(named.hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, keys binary")
    out = written(made.dropDuplicates(["doc_id"]), "sets")
    discard(named)
    return out


def verified(pairs: DataFrame, made: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, counted over whole sets."""
    both = pairs.select("a", "b").join(made.select(F.col("doc_id").alias("a"), F.col("keys").alias("a_keys")), "a").join(made.select(F.col("doc_id").alias("b"), F.col("keys").alias("b_keys")), "b")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_keys"), batch.column("b_keys"), strict=True):
                p, q = np.frombuffer(x.as_py(), K.U), np.frombuffer(y.as_py(), K.U)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * den >= num * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_keys", "b_keys").mapInArrow(overlap, "a long, b long")


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components."""
    side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    joined_ = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined_.where(~F.coalesce("_a", "a").eqNullSafe(F.coalesce("_b", "b"))).drop("_a", "_b")


def classes(docs: DataFrame, n: int, num: int, den: int, frequent) -> DataFrame:
    """(doc_id, n_shingles, digest of the set as two longs, prefix as packed keys) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            for lo, hi, buf, offsets in K.text_chunks(batch.column("text")):
                sizes, one, two, prefixes = [], [], [], []
                for keys in document_keys(buf, offsets, n, last):
                    sizes.append(len(keys))
                    m = K.mix(keys + K.U(1))
                    one.append(int(m.sum(dtype=K.U).view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(K.mix(m)).view(np.int64)) if len(m) else 0)
                    prefixes.append(keys[: prefix_length(len(keys), num, den)].tobytes() if len(keys) else b"")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefixes, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, prefix binary")


def joined(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, long: int = LONG, block: int = BLOCK, survey: int = SURVEY_TIMES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links need a similarity of num / den."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(frequent_keys(docs, n, times=survey))
    table = written(classes(docs, n, num, den, frequent), "sets")
    rows = table.select("doc_id", "n_shingles", "d1", "d2")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    leaders = written(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("leader")), "leaders")
    chosen = table.join(leaders.select(F.col("leader").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "prefix")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("prefix")]
            counts = [len(k) for k in keys]
            hot = [len(k) > 0 and bool(k[-1] >> 62 & 1) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), counts)), pa.array(np.repeat(batch.column("n_shingles").to_numpy(), counts).astype(np.int32)), pa.array(np.repeat(np.array(hot, bool), counts))], names=["key", "doc_id", "size", "hot"])

    incidence = chosen.mapInArrow(exploded, "key long, doc_id long, size int, hot boolean")
    known = F.col("key").bitwiseAND(1 << 62) != 0  # frequent n-grams: their columns are long, and are not gathered
    blocks = incidence.where(~known).repartition("key").sortWithinPartitions("key", "doc_id")
    product = written(blocks.mapInArrow(lambda it: _columns(it, long), COLUMNS), "product")
    short = squared(product.where("kind = 0"), num, den)
    column = product.where("kind = 1").select("key", "doc_id", "size")
    # A document whose prefix reaches the frequent n-grams has all its others in the prefix. What only one of
    # two such documents holds there counts against them: `own` is what a document shares with nobody, -1
    # where that is not known.
    own = product.where("kind = 2").groupBy("doc_id").agg(F.sum("n").alias("own"))
    column = column.withColumn("own", F.lit(-1).cast("long")).unionByName(incidence.where(known).select("key", "doc_id", F.col("size").cast("long").alias("size")).join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).select("key", "doc_id", "size", "own"))
    column = written(column, "columns")
    able = lambda x, u, y, v: F.least(x - F.greatest(u, F.lit(0)), y - F.greatest(v, F.lit(0))) * den >= F.greatest(x + F.greatest(v, F.lit(0)), y + F.greatest(u, F.lit(0))) * num

    # Long columns: each document against the column's smallest that it shares most with.
    heads = column.groupBy("key").agg(F.min_by(F.struct("doc_id", "size", "own"), F.struct("own", "doc_id")).alias("head"))
    stars = column.join(heads, "key").where((F.col("doc_id") != F.col("head.doc_id")) & able(F.col("size"), F.col("own"), F.col("head.size"), F.col("head.own")))
    stars = stars.groupBy("doc_id", "head.doc_id").agg(F.count("*").alias("n")).toDF("b", "a", "n")
    stars = written(stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "stars")
    links, label = None, spark.createDataFrame([], "doc_id long, component long")
    if not stars.isEmpty():
        sets = sets_of(docs, stars, n)
        links = written(verified(stars, sets, num, den), "links")
        discard(sets)
        label = components(links).select(F.col("node").alias("doc_id"), "component")
    # Columns with the same head are multiplied together: a document is there once, with its n-grams.
    marked = column.join(heads.select("key", F.col("head.doc_id").alias("head")), "key")
    held = marked.groupBy("head", "doc_id").agg(F.max("size").alias("size"), F.max("own").alias("own"), F.collect_set("key").alias("keys")).join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = held.groupBy("head").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("head", F.ceil(F.col("rows") / block).cast("int").alias("parts"))
    open_ = held.join(several, "head").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    # Block (i, j) of a head holds parts i and j; pairs within a part are formed in (i, i).
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("head", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "size", "own", "component", "keys")
    across = dealt.repartition("head", "i", "j").sortWithinPartitions("head", "i", "j").mapInArrow(lambda it: _across(it, num, den), "a long, b long, a_size long, b_size long, n long")
    pairs = short.unionByName(across)
    totals = pairs.groupBy("a", "b").agg(F.max("a_size").alias("x"), F.max("b_size").alias("y"), F.sum("n").alias("n"))
    needed = F.expr(f"({num} * (x + y) + {num + den - 1}) div {num + den}")
    rest = lambda c: F.expr(f"({num} * {c} + {den - 1}) div {den} - 1")
    likely = written(totals.where(F.col("n") + F.greatest(rest("x"), rest("y")) >= needed).select("a", "b", "n"), "likely")
    discard(product, column, stars)
    # Each document with the one it shares most with first: what these links join needs no further pair.
    made = sets_of(docs, likely, n)
    ends = likely.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "n"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "n"))).alias("e")).select("e.*")
    nearest = ends.groupBy("x").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = verified(nearest, made, num, den)
    links = written(near if links is None else near.unionByName(links), "links")
    open_pairs = written(apart(likely, components(links)), "apart")
    last = written(verified(open_pairs, made, num, den).unionByName(links), "links")
    discard(likely, made, links, open_pairs)
    label = components(last).select(F.col("node").alias("leader"), "component")
    named = leaders.join(label, "leader", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "leader").alias("component_id"))
    return rows.join(named, ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], together: int = 4096) -> np.ndarray:
    """The product of two blocks of the incidence: n-grams that each left row shares with each right row."""
    names = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(names), together):
        some = names[lo : lo + together]
        sides = []
        for rows in (left, right):
            dense = np.zeros((len(rows), len(some)), np.float32)
            for i, keys in enumerate(rows):
                at = np.searchsorted(some, keys)
                at = at[(at < len(some)) & (some[np.minimum(at, len(some) - 1)] == keys)]
                dense[i, at] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _across(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """For each block, the pairs across components whose shared n-grams, with all that may be shared elsewhere, can be enough."""
    names = ["head", "i", "j", "part", "doc_id", "size", "own", "component"]
    rest, lists = np.zeros((0, len(names)), np.int64), []

    def pairs(block: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
        i, j = block[0, 1:3]
        p, q = np.flatnonzero(block[:, 3] == i), np.flatnonzero(block[:, 3] == j)
        left, right = block[p], block[q]
        a, u, c = (left[:, k, None] for k in (5, 6, 7))
        b, v, d = (right[:, k] for k in (5, 6, 7))
        known = (u >= 0) & (v >= 0)
        u, v = np.where(known, u, 0), np.where(known, v, 0)
        able = (c != d) & (np.minimum(a - u, b - v) * den >= num * np.maximum(a + v, b + u))
        if i == j:
            able = np.triu(able, 1)
        here = np.array([len(k) for k in keys], np.int64)
        if able.any():
            n = shared_counts([keys[x] for x in p], [keys[x] for x in q])
            spare = np.minimum(prefix_length(a, num, den) - u - here[p, None], prefix_length(b, num, den) - v - here[q])
            beyond = np.maximum(a - prefix_length(a, num, den), b - prefix_length(b, num, den))
            able &= (n > 0) & (n + spare + beyond >= need(a, b, num, den))
        p, q = np.nonzero(able)
        x, y = left[p][:, [4, 5]], right[q][:, [4, 5]]
        swap = x[:, 0] > y[:, 0]
        x[swap], y[swap] = y[swap], x[swap].copy()
        total = n[p, q] if len(p) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(z) for z in (x[:, 0], y[:, 0], x[:, 1], y[:, 1], total)], names=["a", "b", "a_size", "b_size", "n"])

    for batch in _with_end(batches):
        if batch is not None:
            rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)])
            lists.extend(k.values.to_numpy() for k in batch.column("keys"))
        if not len(rest):
            continue
        edge = np.flatnonzero(np.concatenate([[True], (rest[1:, :3] != rest[:-1, :3]).any(axis=1)]))
        ends = np.append(edge[1:], len(rest))
        done = len(edge) if batch is None else len(edge) - 1
        for s, e in zip(edge[:done].tolist(), ends[:done].tolist(), strict=True):
            yield pairs(rest[s:e], lists[s:e])
        cut = int(edge[done]) if done < len(edge) else len(rest)
        rest, lists = rest[cut:], lists[cut:]
