"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.runtime import discard, written

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): each edge is replaced by edges to the smallest neighbour, first of the
    larger neighbours, then of the smaller ones, until every node points at its component's
    smallest. Both steps are one aggregation with map-side combine and one join on the node, in
    which adaptive execution may split a hub. Each round is written to the shared folder, so a
    lost executor repeats at most one round. Edges that repeat are dropped once a
    round, and a round's table is deleted when the next stands. The number of rounds is
    logarithmic in practice; beyond MOST_ROUNDS an error says so.
    """
    ab = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(ab.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    previous = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(before)
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")
    return now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
