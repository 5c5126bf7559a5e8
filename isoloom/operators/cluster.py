"""Clustering reads by the seeds they share.

Counting, the frequency band and the seed lookup are plain aggregations and joins. The greedy
assignment goes read by read, but only reads that are linked through informative seeds can affect
each other, so each connected component of that graph is one independent group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.operators.components import components
from isoloom.operators.ranking import ranked
from isoloom.operators.seeds import seeds
from isoloom.options import ClusterOptions
from isoloom.runtime import prepare, written


def unsigned(h: Column | str) -> Column:
    """A sort key for bits of unsigned numbers."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63))) if isinstance(h, str) else h.bitwiseXOR(F.lit(-(1 << 63)))


def seed_counts(table: DataFrame) -> DataFrame:
    """(h, n_reads, level): in how many reads each seed occurs."""
    return table.groupBy("h").agg(F.count("*").alias("n_reads"), F.min("level").alias("level"))


def effective_max_occ(n_reads: Column, max_occ: int, fraction: float) -> Column:
    """The cap on a seed's reads: `max_occ`, or a share of the reads if that is more."""
    return F.greatest(F.lit(max_occ).cast("long"), F.least(F.floor(n_reads * F.lit(float(fraction))), F.lit(4294967295)).cast("long"))


def informative(counts: DataFrame, min_occ: int, cap) -> DataFrame:
    """Seeds in at least `min_occ` and at most `cap` reads."""
    return counts.where(F.col("n_reads").between(min_occ, cap))


def weight(level: Column, weights: tuple[int, ...]) -> Column:
    """A level's vote weight; levels beyond the list weigh their number."""
    listed = F.array(*(F.lit(int(w)) for w in weights)) if weights else F.array().cast("array<int>")
    return F.coalesce(F.get(listed, level - 1), level).cast("int")


def weighted_seeds(table: DataFrame, keep: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(read_idx, h, weight) of the informative seeds of every read."""
    return table.select("read_idx", "h").join(keep.select("h", "level"), "h").select("read_idx", "h", weight(F.col("level"), weights).alias("weight"))


def assign(seed_lists: list[tuple[np.ndarray, np.ndarray]], min_shared: int, min_shared_frac: float) -> list[int]:
    """Clusters of reads taken in order; each read's seeds come in unsigned order, with weights.

    A read joins the cluster that owns most weight of its seeds, the first to get there, if that
    is enough; else it founds one. Seeds nobody owns then belong to its cluster for good.
    """
    owner: dict[int, int] = {}
    out, n = [], 0
    for hashes, weights in seed_lists:
        need = max(min_shared, int(np.ceil(min_shared_frac * float(weights.sum()))))
        votes: dict[int, int] = {}
        best, most = -1, 0
        for h, w in zip(hashes.tolist(), weights.tolist(), strict=True):
            c = owner.get(h)
            if c is not None:
                votes[c] = votes.get(c, 0) + w
                if votes[c] > most:
                    best, most = c, votes[c]
        if best < 0 or most < need:
            best, n = n, n + 1
        for h in hashes.tolist():
            owner.setdefault(h, best)
        out.append(best)
    return out


def assigned(reads: DataFrame, weighted: DataFrame, min_shared: int, min_shared_frac: float) -> DataFrame:
    """(read_idx, cluster_id): the same clusters and numbers as one pass over all reads, longest first.

    `reads` has read_idx and len. Clusters are numbered by their founders in that order.
    """
    prepare(reads.sparkSession)
    weighted = written(weighted, "weighted")
    first = weighted.groupBy("h").agg(F.min("read_idx").alias("b"))
    edges = weighted.join(first, "h").select(F.col("read_idx").alias("a"), "b")
    label = components(edges).select(F.col("node").alias("read_idx"), "component")
    lists = weighted.groupBy("read_idx").agg(F.sort_array(F.collect_list(F.struct(unsigned("h").alias("o"), "h", "weight"))).alias("seeds"))
    rows = reads.select("read_idx", "len").join(lists, "read_idx", "left").join(label, "read_idx", "left")
    rows = rows.select(F.coalesce("component", "read_idx").alias("component"), "read_idx", "len", F.coalesce(F.col("seeds.h"), F.array().cast("array<long>")).alias("h"), F.coalesce(F.col("seeds.weight"), F.array().cast("array<int>")).alias("w"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by component, then longest first."""
        held: list = []

        def done() -> pa.RecordBatch:
            clusters = assign([(h, w) for _, _, h, w in held], min_shared, min_shared_frac)
            founder: dict[int, int] = {}
            for (_, i, _, _), c in zip(held, clusters, strict=True):
                founder.setdefault(c, i)
            ids = [i for _, i, _, _ in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([founder[c] for c in clusters], pa.int64())], names=["read_idx", "founder"])

        for batch in batches:
            for c, i, h, w in zip(batch.column("component").to_pylist(), batch.column("read_idx").to_pylist(), batch.column("h"), batch.column("w"), strict=True):
                if held and held[0][0] != c:
                    yield done()
                held.append((c, i, h.values.to_numpy(zero_copy_only=False), w.values.to_numpy(zero_copy_only=False)))
        if held:
            yield done()

    dealt = rows.repartition("component").sortWithinPartitions("component", F.desc("len"), "read_idx").select("component", "read_idx", "h", "w")
    founded = written(dealt.mapInArrow(fold, "read_idx long, founder long"), "founded")
    founders = founded.select("founder").distinct().join(reads.select(F.col("read_idx").alias("founder"), "len"), "founder")
    numbered = ranked(founders, [F.desc("len"), F.asc("founder")], "cluster_id").select("founder", F.col("cluster_id").cast("long").alias("cluster_id"))
    return founded.join(numbered, "founder").select("read_idx", "cluster_id")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))


def size_histogram(clusters: DataFrame) -> DataFrame:
    return cluster_sizes(clusters).groupBy("cluster_size").agg(F.count("*").alias("num_clusters"))


def top_sizes(clusters: DataFrame, n: int = 20) -> DataFrame:
    return cluster_sizes(clusters).orderBy(F.desc("cluster_size"), "cluster_id").limit(n)


def eligible(clusters: DataFrame, min_size: int = 1, max_size: int | None = None) -> DataFrame:
    """Clusters within the size range, largest first."""
    sizes = cluster_sizes(clusters).where(F.col("cluster_size") >= min_size)
    return (sizes if max_size is None else sizes.where(F.col("cluster_size") <= max_size)).orderBy(F.desc("cluster_size"), "cluster_id")


def size_summary(clusters: DataFrame) -> DataFrame:
    """One row: clusters, singletons, multi-read clusters, the largest, their mean size, and the share of reads in them."""
    many, size = F.col("cluster_size") > 1, F.col("cluster_size")
    return cluster_sizes(clusters).agg(
        F.count("*").alias("clusters"),
        F.count_if(~many).alias("singleton_clusters"),
        F.count_if(many).alias("multi_read_clusters"),
        F.coalesce(F.max("cluster_size"), F.lit(0)).alias("largest_cluster"),
        F.coalesce(F.sum(F.when(many, size)), F.lit(0)).alias("reads_in_multi"),
        F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("reads"),
    )


def length_order(reads: DataFrame) -> DataFrame:
    """(read_idx, rank): longest first, ties in file order."""
    return ranked(reads.select("read_idx", "len"), [F.desc("len"), F.asc("read_idx")], "rank").select("read_idx", F.col("rank").cast("long").alias("rank"))


def clustered(reads: DataFrame, o: ClusterOptions = ClusterOptions()) -> tuple[DataFrame, dict]:
    """(read_idx, cluster_id) of the reads, and what the summary tells of the seeds."""
    table = written(seeds(reads, o.k, o.s, o.offset, o.levels), "seeds")
    n_reads = reads.count()
    cap = max(o.max_occ, min(int(o.max_occ_frac * n_reads), 4294967295))
    counts = seed_counts(table)
    keep = written(informative(counts, o.min_occ, cap), "informative")
    clusters = assigned(reads, weighted_seeds(table, keep, o.level_weights), o.min_shared, o.min_shared_frac)
    return clusters, {"reads": n_reads, "max_occ": cap, "distinct_seeds": counts.count(), "informative_seeds": keep.count()}
