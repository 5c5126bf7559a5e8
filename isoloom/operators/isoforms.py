"""Isoform detection over clusters: one Arrow group per cluster, and the tables it gives."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.operators import ends
from isoloom.operators import relational as R
from isoloom.operators.merge import isoforms_of
from isoloom.operators.minimizers import minimizers
from isoloom.operators.placement import structure_groups
from isoloom.options import IsoformOptions, StartLibrary
from isoloom.runtime import prepare, written

PLACED = "cluster_id long, group_id int, ord int, read_idx long, start int, end int"
FOUND = "cluster_id long, isoform_index int, consensus string, alt_start boolean, variant_of int, start_offset int, members array<long>"
STATS = "cluster_id long, group_id int, reads int, labelled int, capped int, candidates array<struct<share: float, sharpness: float>>, stop_fractions array<float>"


def placements(members: DataFrame, o: IsoformOptions) -> DataFrame:
    """Step 1: the structure groups of every cluster; `members` has cluster_id, read_idx, seq."""
    prepare(members.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("read_idx")
        seqs, ids = pdf["seq"].tolist(), pdf["read_idx"].tolist()
        groups, _ = structure_groups(seqs, [minimizers(s, o.k, o.w) for s in seqs], o)
        rows = [(pdf["cluster_id"].iloc[0], g, k, ids[i], a, b) for g, group in enumerate(groups) for k, (i, a, b) in enumerate(group)]
        return pd.DataFrame(rows, columns=["cluster_id", "group_id", "ord", "read_idx", "start", "end"])

    return members.select("cluster_id", "read_idx", "seq").groupBy("cluster_id").applyInPandas(run, PLACED)


def _groups(pdf: pd.DataFrame) -> tuple[list[str], list[int], list[list[tuple[int, int, int]]]]:
    """A cluster's sequences and ids in file order, and its groups by place in that order."""
    reads = pdf.sort_values("read_idx")
    at = {i: n for n, i in enumerate(reads["read_idx"])}
    ordered = pdf.sort_values(["group_id", "ord"])
    groups = [[(at[r], a, b) for r, a, b in zip(g["read_idx"], g["start"], g["end"], strict=True)] for _, g in ordered.groupby("group_id")]
    return reads["seq"].tolist(), reads["read_idx"].tolist(), groups


def start_stats(placed: DataFrame, o: IsoformOptions) -> DataFrame:
    """What start validation sees in each structure group; `placed` also has seq."""
    prepare(placed.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs, _, groups = _groups(pdf)
        rows = []
        for g, group in enumerate(groups):
            s = ends.Group(group, seqs, o).stats()
            rows.append((pdf["cluster_id"].iloc[0], g, len(group), s.labelled, s.capped, [{"share": a, "sharpness": b} for a, b in s.candidates], s.stop_fractions))
        return pd.DataFrame(rows, columns=["cluster_id", "group_id", "reads", "labelled", "capped", "candidates", "stop_fractions"])

    return placed.groupBy("cluster_id").applyInPandas(run, STATS)


@dataclass
class LibraryFacts:
    """What start validation sees over all groups: a few numbers, whatever the size of the library."""

    labelled: int
    capped: int
    candidates: int
    stops: int


def library_facts(stats: DataFrame) -> LibraryFacts:
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    r = stats.agg(total("labelled", "n"), total("capped", "g"), total(F.size("candidates"), "c"), total(F.size("stop_fractions"), "s")).first()
    return LibraryFacts(int(r["n"]), int(r["g"]), int(r["c"]), int(r["s"]))


def library(stats: DataFrame, o: IsoformOptions, facts: LibraryFacts | None = None) -> StartLibrary:
    """The library's decision from the groups' statistics. Cuts and ranks are made by Spark; sums reach the driver."""
    facts = facts or library_facts(stats)
    each = stats.select(F.explode("candidates").alias("c")).select("c.*")
    many = facts.candidates >= ends.CANDIDATES
    threshold = o.cap_threshold if o.cap_threshold is not None else R.otsu(each, "share").first()["cut"] if many else ends.CAPPED_SHARE
    signal = o.cap_signal == "on"
    if o.cap_signal == "auto":
        signal = facts.labelled >= ends.CAP_READS and facts.capped >= ends.CAP_LIBRARY * facts.labelled
        if signal and many:
            r = R.rank_sums(each.withColumn("flag", F.col("share").cast("double") >= threshold), "sharpness", "flag").first()
            signal = ends.rank_z(r["n1"], r["n2"], r["twice_rank_sum"])[0] > 3.09
    stop = o.stop_threshold
    if stop is None:
        stops = stats.select(F.explode("stop_fractions").alias("v"))
        stop = R.otsu(stops, "v").first()["cut"] if facts.stops >= ends.CANDIDATES else ends.STOP_FRACTION
    return StartLibrary(bool(signal), float(threshold), float(stop))


def detected(placed: DataFrame, o: IsoformOptions) -> DataFrame:
    """Steps 2 to 4 on the groups of every cluster; `placed` also has seq."""
    prepare(placed.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs, ids, groups = _groups(pdf)
        rows = [(pdf["cluster_id"].iloc[0], i, x.consensus, bool(x.alt_start), x.variant_of, x.offset, [ids[m] for m in x.members]) for i, x in enumerate(isoforms_of(seqs, o, groups))]
        out = pd.DataFrame(rows, columns=["cluster_id", "isoform_index", "consensus", "alt_start", "variant_of", "start_offset", "members"])
        return out.astype({"variant_of": "Int32", "start_offset": "Int32"})

    return placed.groupBy("cluster_id").applyInPandas(run, FOUND)


def isoforms(members: DataFrame, o: IsoformOptions = IsoformOptions(), whole_library: bool = True, placed: DataFrame | None = None) -> DataFrame:
    """The isoforms of all clusters as FOUND; `members` has cluster_id, read_idx, seq.

    With automatic start splitting and `whole_library`, all clusters are grouped first, and one
    decision on starts is made for all of them; an option `library` is that decision where it is
    known already, and `placed` the written placements.
    """
    placed = written(placements(members, o), "placed") if placed is None else placed
    rows = placed.join(members.select("read_idx", "seq"), "read_idx")
    if whole_library and o.start_split == "auto" and o.library is None:
        o = replace(o, library=library(written(start_stats(rows, o), "starts"), o))
    return written(detected(rows, o), "isoforms")
