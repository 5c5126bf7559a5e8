"""The three commands as dataflows: cluster, predict, find_isoforms."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.operators import cluster as C
from isoloom.operators.diagnostics import library_line, placement_counts, start_dump
from isoloom.operators.isoforms import isoforms, library, library_facts, placements, start_stats
from isoloom.options import ClusterOptions, IsoformOptions
from isoloom.runtime import written
from isoloom.sources import reads as R
from isoloom.sources import sinks as S


def cluster(spark: SparkSession, path: str, out: str, o: ClusterOptions = ClusterOptions(), emit_assignments: bool = False, one_file: bool = False) -> DataFrame:
    """Cluster a file's reads and write summary, histogram and, if asked for, assignments."""
    clock = Clock()
    table = written(R.load(spark, path, o.max_reads), "reads")
    clock.lap("reading")
    clusters, facts = C.clustered(table, o)
    clusters = written(clusters, "clusters")
    clock.lap("clustering")
    S.save(S.cluster_summary(clusters, facts, o), f"{out}/summary.tsv", False, one_file)
    S.save(S.cluster_histogram(clusters), f"{out}/cluster_size_hist.tsv", one_file=one_file)
    if emit_assignments:
        S.save(S.cluster_assignments(clusters, table), f"{out}/assignments.tsv", one_file=one_file)
    clock.lap("writing")
    print(report(clusters, facts, o))
    print(clock)
    return clusters


class Clock:
    """Seconds of a command's phases."""

    def __init__(self):
        self.began, self.laps = time.monotonic(), []

    def lap(self, name: str) -> None:
        now = time.monotonic()
        self.laps.append((name, now - self.began))
        self.began = now

    def __str__(self) -> str:
        return "seconds: " + ", ".join(f"{name} {s:.1f}" for name, s in self.laps)


def report(clusters: DataFrame, facts: dict, o: ClusterOptions) -> str:
    """A clustering in a few lines."""
    s = C.size_summary(clusters).first()
    many = s["multi_read_clusters"]
    top = [str(r["cluster_size"]) for r in C.top_sizes(clusters, 12).collect()]
    return "\n".join(
        (
            f"reads={facts['reads']}  k={o.k} s={o.s} L1..{o.levels}  band=[{o.min_occ},{facts['max_occ']}]  weights={list(o.level_weights)}  min_shared={o.min_shared}  min_shared_frac={o.min_shared_frac}",
            f"distinct seeds={facts['distinct_seeds']}  informative={facts['informative_seeds']}",
            f"clusters={s['clusters']}  (singletons={s['singleton_clusters']}, multi={many})",
            f"reads in multi-read clusters: {s['reads_in_multi']} ({100 * s['reads_in_multi'] / max(s['reads'], 1):.1f}%)",
            f"largest cluster={s['largest_cluster']}  mean(multi)={s['reads_in_multi'] / max(many, 1):.1f}",
            f"top sizes: {', '.join(top)}",
        )
    )


def _write(found: DataFrame, table: DataFrame, out: str, one_file: bool) -> None:
    save = lambda df, name: S.save(df, f"{out}/{name}", one_file=one_file)
    save(S.isoform_assignments(found, table), "isoform_assignments.tsv")
    save(S.isoform_summary(found), "isoform_summary.tsv")
    save(S.isoform_fasta(found), "isoforms.fasta")
    save(S.start_variant_fasta(found), "start_variants.fasta")
    save(S.start_variant_assignments(found, table), "start_variant_assignments.tsv")


def isoform_report(found: DataFrame, members: DataFrame) -> str:
    """A detection in a few lines."""
    n = members.agg(F.count("*").alias("reads"), F.count_distinct("cluster_id").alias("clusters")).first()
    f = found.agg(F.count_if(F.col("variant_of").isNull()).alias("isoforms"), F.count("variant_of").alias("variants"), F.count_if(F.col("alt_start")).alias("alt"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("placed"), F.count_distinct("cluster_id").alias("with")).first()
    return "\n".join(
        (
            f"clusters={n['clusters']}  with isoforms={f['with']}  reads={n['reads']}  in isoforms={f['placed']} ({100 * f['placed'] / max(n['reads'], 1):.1f}%)",
            f"isoforms={f['isoforms']}  start variants={f['variants']}  at alternative starts={f['alt']}",
        )
    )


def placement_report(members: DataFrame, o: IsoformOptions) -> str:
    """The counters of placement, one event a line; places every read again."""
    rows = placement_counts(members, o).orderBy("event", "class").collect()
    return "\n".join(f"{r['event']}" + (f" [{r['class']}+]" if r["class"] else "") + f": {r['n']}" for r in rows)


def predict(spark: SparkSession, path: str, out: str, co: ClusterOptions = ClusterOptions(), io: IsoformOptions = IsoformOptions(), min_size: int = 1, max_size: int | None = None, dump_clusters: bool = False, dump_starts: str | None = None, one_file: bool = False, stats: bool = False) -> DataFrame:
    """Clustering, then isoforms of every cluster within the size range."""
    clock = Clock()
    table = written(R.load(spark, path, co.max_reads), "reads")
    clock.lap("reading")
    clusters = written(C.clustered(table, co)[0], "clusters")
    clock.lap("clustering")
    if dump_clusters:
        S.save(S.gene_clusters(clusters, table), f"{out}/gene_clusters.tsv", one_file=one_file)
    chosen = C.eligible(clusters, min_size, max_size).select("cluster_id")
    members = written(clusters.join(chosen, "cluster_id", "left_semi").join(table, "read_idx").select("cluster_id", "read_idx", "seq"), "members")
    placed = written(placements(members, io), "placed")
    if dump_starts:
        rows = placed.join(table.select("read_idx", "seq", "name"), "read_idx")
        starts = written(start_stats(rows, io), "starts")
        facts = library_facts(starts)
        decided = library(starts, io, facts)
        lines = start_dump(rows, replace(io, library=decided)).unionByName(spark.createDataFrame([(None, "library", library_line(facts, decided))], "cluster_id long, kind string, value string"))
        S.save(lines.orderBy("kind", "cluster_id", "value").select("value"), dump_starts, one_file=one_file)
        io = replace(io, library=decided) if io.start_split == "auto" else io
    found = isoforms(members, io, placed=placed)
    clock.lap("isoforms")
    _write(found, table, out, one_file)
    clock.lap("writing")
    print(isoform_report(found, members), *([placement_report(members, io)] if stats else []), clock, sep="\n")
    return found


def find_isoforms(spark: SparkSession, path: str, clusters: str, out: str, o: IsoformOptions = IsoformOptions(), only: list[int] | None = None, min_size: int = 1, max_size: int | None = None, one_file: bool = False, stats: bool = False) -> DataFrame:
    """Isoforms for a given table of clusters; starts are decided for each structure group."""
    clock = Clock()
    table = written(R.load(spark, path), "reads")
    members = written(R.joined(table, R.assignments(spark, clusters), only, min_size, max_size).select("cluster_id", "read_idx", "seq"), "members")
    clock.lap("reading")
    found = isoforms(members, o, whole_library=False)
    clock.lap("isoforms")
    _write(found, table, out, one_file)
    clock.lap("writing")
    print(isoform_report(found, members), *([placement_report(members, o)] if stats else []), clock, sep="\n")
    return found


def isoform_counts(found: DataFrame) -> DataFrame:
    """Isoforms of each cluster that are no start variants."""
    return found.groupBy("cluster_id").agg(F.count_if(F.col("variant_of").isNull()).alias("n_isoforms"))
