"""The steps of isoform detection that are relational, as DataFrame operations over whole tables.

The production path runs them inside one group per cluster; these forms serve tables where a group
is too large for that, and check the kernels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.operators import ends
from isoloom.runtime import prepare

#: Cells that values are dealt to before they are ranked.
RANK_CELLS = 4096


def local_extremes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """is_min and is_max: strictly below or above both neighbours; a missing neighbour is no obstacle."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    both = lambda test: F.coalesce(test(before), F.lit(True)) & F.coalesce(test(after), F.lit(True))
    return df.withColumn("is_min", both(lambda x: v < x)).withColumn("is_max", both(lambda x: v > x))


def open_syncmers(smers: DataFrame, k: int, s: int, t: int) -> DataFrame:
    """From (read_idx, pos, h) of all s-mers, the k-mer positions whose leftmost smallest s-mer is at offset t."""
    w = Window.partitionBy("read_idx").orderBy("pos").rowsBetween(0, k - s)
    order = F.struct(F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("o"), "pos")
    least = smers.withColumn("least", F.min(order).over(w)).withColumn("n", F.count("*").over(w))
    return least.where((F.col("n") == k - s + 1) & (F.col("least.pos") == F.col("pos") + t)).select("read_idx", "pos")


def kmer_runs(table: DataFrame) -> DataFrame:
    """(read_idx, kmer, positions in order)."""
    return table.groupBy("read_idx", "kmer").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def peaks(points: DataFrame, keys: list[str], column: str, width: int, support: int) -> DataFrame:
    """(keys, peak): medians of each group's densest windows."""
    prepare(points.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = ends.peaks(pdf[column].tolist(), width, support)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(found) for k in keys}, "peak": found})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select(*keys, column).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "peak long"]))


def nearest(points: DataFrame, centres: DataFrame, keys: list[str], column: str, radius: int, name: str = "key") -> DataFrame:
    """Each point with the nearest centre of its group within the radius, the lower of two, or null.

    The join is on the group and the two buckets of width 2 * radius + 1 a centre can reach, so its
    size follows the points that have a centre near.
    """
    size = 2 * radius + 1
    bucket = lambda c: F.floor(c / F.lit(size)).cast("long")
    reach = centres.select(*keys, "peak", F.explode(F.array_distinct(F.array(bucket(F.col("peak") - radius), bucket(F.col("peak") + radius)))).alias("_b"))
    rows = points.withColumn("_b", bucket(F.col(column)))
    gap = F.abs(F.col("peak") - F.col(column))
    near = rows.join(reach, [*keys, "_b"], "left").withColumn("_c", F.when(gap <= radius, F.struct(gap.alias("gap"), "peak")))
    return near.groupBy(*points.columns).agg(F.min("_c").alias("_c")).select(*points.columns, F.col("_c.peak").alias(name))


def cells(placed: DataFrame, keys: list[str], min_iso: int) -> DataFrame:
    """Dense cells (keys, start_key, end_key) with their extent and support."""
    pairs = placed.where("start_key IS NOT NULL AND end_key IS NOT NULL").groupBy(*keys, "start_key", "end_key").agg(F.count("*").alias("support"), F.sort_array(F.collect_list("start")).alias("s"), F.sort_array(F.collect_list("end")).alias("e"))
    q = F.least(F.lit(max(min_iso // 2, 1)), F.col("support")).cast("int")
    return pairs.where(F.col("support") >= min_iso).select(*keys, "start_key", "end_key", "support", F.element_at("s", q).alias("lo"), F.element_at("e", -q).alias("hi"))


def folded(placed: DataFrame, dense: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Each read's isoform: its own dense cell, else the best-supported one that holds it within the tolerance."""
    own = placed.join(dense.select(*keys, "start_key", "end_key", F.lit(True).alias("own")), [*keys, "start_key", "end_key"], "left")
    extents = dense.select(*keys, F.struct((-F.col("support")).alias("n"), "start_key", "end_key").alias("c"), "lo", "hi")
    loose = own.where("own IS NULL").select(*keys, "read_idx", "start", "end")
    holds = (F.col("lo") <= F.col("start") + tolerance) & (F.col("hi") >= F.col("end") - tolerance)
    best = loose.join(extents, keys, "left").groupBy(*keys, "read_idx").agg(F.min(F.when(holds, F.col("c"))).alias("c"))
    kept = own.where("own").select(*keys, "read_idx", "start_key", "end_key")
    return kept.unionByName(best.select(*keys, "read_idx", F.col("c.start_key").alias("start_key"), F.col("c.end_key").alias("end_key")))


def stop_counts(placed: DataFrame, centres: DataFrame, keys: list[str], radius: int = ends.RADIUS) -> DataFrame:
    """For each centre, the reads that start there and those that pass it.

    Reads pass if they start before the window around the centre, less those that end by its end, but
    for those that lie within it. The first two are running counts along each group, and only reads
    that start in a centre's window are joined with it, by bucket: no read meets every centre.
    """
    counted = centres
    for name, point, edge, first in (("before", "start", -radius, 0), ("by", "end", radius, 1)):
        points = placed.select(*keys, F.col(point).cast("long").alias("x"), F.lit(1 - first).alias("turn"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("peak"))
        asked = centres.select(*keys, (F.col("peak") + edge).cast("long").alias("x"), F.lit(first).alias("turn"), F.lit(0).alias("one"), F.col("peak").cast("long").alias("peak"))
        upto = F.sum("one").over(Window.partitionBy(*keys).orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.join(points.unionByName(asked).withColumn(name, upto).where("peak IS NOT NULL").select(*keys, "peak", name), [*keys, "peak"])
    size = 2 * radius + 1
    bucket = lambda c: F.floor(c / F.lit(size)).cast("long")
    reach = centres.select(*keys, "peak", F.explode(F.array_distinct(F.array(bucket(F.col("peak") - radius), bucket(F.col("peak") + radius)))).alias("_b"))
    near = placed.select(*keys, "start", "end").withColumn("_b", bucket(F.col("start"))).join(reach, [*keys, "_b"]).where(F.abs(F.col("start") - F.col("peak")) <= radius)
    near = near.groupBy(*keys, "peak").agg(F.count("*").alias("starting"), F.count_if(F.col("end") <= F.col("peak") + radius).alias("within"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counted.join(near, [*keys, "peak"], "left").select(*keys, "peak", zero("starting").cast("long").alias("starting"), (F.col("before") - F.col("by") + zero("within")).cast("long").alias("passing"))


def otsu(values: DataFrame, column: str = "v", default: float = ends.CAPPED_SHARE) -> DataFrame:
    """One row: the cut, in hundredths, that separates values in [0, 1] best."""
    bins = values.select(F.least(F.floor(F.col(column).cast("double") * 100), F.lit(99)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").cast("double").alias("n"))
    up = Window.orderBy("bin")
    mid = (F.col("bin") + 0.5) / 100
    runs = bins.select("bin", F.sum("n").over(up).alias("below"), F.sum(F.col("n") * mid).over(up).alias("weight"), F.sum("n").over(Window.partitionBy()).alias("all"), F.sum(F.col("n") * mid).over(Window.partitionBy()).alias("total"))
    above = F.col("all") - F.col("below")
    gap = F.col("weight") / F.col("below") - (F.col("total") - F.col("weight")) / F.when(above > 0, above)
    between = F.round(F.col("below") * above * gap * gap, 6)
    return runs.where(above > 0).agg(F.coalesce(F.max_by((F.col("bin") + 1) / 100, F.struct(between, -F.col("bin"))), F.lit(default)).alias("cut"))


def rank_sums(values: DataFrame, column: str, flag: str) -> DataFrame:
    """One row: group sizes and twice the rank sum of the flagged rows, ties sharing their mean rank.

    Values are dealt to at most RANK_CELLS cells in their order; only the cells' sizes are summed up
    in one place, and ranks are counted within each cell. Sums are exact at every size.
    """
    counts = values.groupBy(column).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k"))
    range_ = counts.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    share = (F.col(column).cast("double") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    cells = counts.crossJoin(F.broadcast(range_)).withColumn("cell", F.coalesce(F.floor(share * (RANK_CELLS - 1)), F.lit(0)).cast("int"))  # one row
    sizes = cells.groupBy("cell").agg(F.sum("n").alias("size"))
    below = sizes.select("cell", (F.sum("size").over(Window.orderBy("cell")) - F.col("size")).alias("below"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("cell").orderBy(column))
    ranked = cells.join(F.broadcast(below), "cell").withColumn("upto", upto)
    return ranked.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)).alias("n2"), F.coalesce(F.sum(F.col("k") * (2 * F.col("upto") - F.col("n") + 1)), F.lit(0)).alias("twice_rank_sum"))


def unique_boundaries(table: DataFrame) -> DataFrame:
    """(read_idx, kmer, pos) of the minimizers that occur once in their read, numbered by position."""
    # Dealt by read once: both windows, and what joins on read_idx after them, keep that.
    one = table.repartition("read_idx").withColumn("n", F.count("*").over(Window.partitionBy("read_idx", "kmer"))).where("n = 1").drop("n")
    return one.withColumn("boundary", F.row_number().over(Window.partitionBy("read_idx").orderBy("pos")) - 1)


def depth_and_support(hits: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, read_idx, boundary): reads that hit each boundary, and reads whose hits span it."""
    spans = hits.groupBy(*keys, "read_idx").agg(F.min("boundary").alias("a"), F.max("boundary").alias("b"))
    steps = spans.select(*keys, F.col("a").alias("boundary"), F.lit(1).alias("d")).unionByName(spans.select(*keys, (F.col("b") + 1).alias("boundary"), F.lit(-1).alias("d")))
    support = hits.groupBy(*keys, "boundary").agg(F.count("*").alias("support"))
    joined = steps.groupBy(*keys, "boundary").agg(F.sum("d").alias("d")).join(support, [*keys, "boundary"], "full")
    depth = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(*keys).orderBy("boundary"))
    return joined.withColumn("depth", depth).where("support IS NOT NULL").select(*keys, "boundary", F.col("depth").cast("long").alias("depth"), "support")


def helpers(reads: DataFrame, members: DataFrame, keys: list[str], most: int = 16) -> DataFrame:
    """The longest reads of each group that are no members, at most `most`."""
    others = reads.join(members.select("read_idx"), "read_idx", "left_anti")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("len"), "read_idx"))
    return others.withColumn("place", order).where(F.col("place") <= most)


def window_votes(hits: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """From (read_idx, boundary, pos) and (keys, read_idx, seq): how often each segment fills each window between neighbouring boundaries.

    A read is in one group. Its keys and sequence meet its hits only once these lie sorted by
    read_idx, and the sequence leaves with the segment cut: hits are dealt out as three numbers, and
    no shuffle carries a sequence more than once.
    """
    w = Window.partitionBy("read_idx").orderBy("boundary")
    ends_ = hits.select("read_idx", "boundary", "pos").withColumn("next", F.lead("boundary").over(w)).withColumn("stop", F.lead("pos").over(w)).where(F.col("next") == F.col("boundary") + 1)
    segment = F.substring("seq", F.col("pos") + 1, F.col("stop") - F.col("pos"))
    cut = ends_.join(reads.select("read_idx", *keys, "seq").hint("merge"), "read_idx").select(*keys, "boundary", segment.alias("segment"))
    return cut.groupBy(*keys, "boundary", "segment").agg(F.count("*").alias("votes"))


def modal(votes: DataFrame, keys: list[str], default: Column) -> DataFrame:
    """The most frequent segment of each window; of equals the default, then the smallest."""
    order = F.row_number().over(Window.partitionBy(*keys, "boundary").orderBy(F.desc("votes"), F.desc(default == F.col("segment")), "segment"))
    return votes.withColumn("place", order).where("place = 1").drop("place")


def assembled(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The windows' segments joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("boundary", "segment")))
    return windows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x.segment), "").alias("seq"))


def size_class(n: Column, bounds: tuple[int, ...] = (32, 64, 128, 256, 512)) -> Column:
    """The lower bound of the class a size falls in."""
    out = F.lit(0)
    for b in bounds:
        out = F.when(n >= b, F.lit(b)).otherwise(out)
    return out
