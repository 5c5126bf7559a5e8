"""What isoform detection saw on its way, as tables: counts are rows of the kernels, so a repeated task counts once."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.operators import ends
from isoloom.operators.isoforms import _groups
from isoloom.operators.minimizers import minimizers
from isoloom.operators.placement import structure_groups
from isoloom.options import IsoformOptions
from isoloom.runtime import prepare


def placement_counts(members: DataFrame, o: IsoformOptions) -> DataFrame:
    """(event, class, n) over all clusters: placements, sizes of gaps and flanks, jumps, and reads turned down by reason."""
    prepare(members.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs, seen = pdf.sort_values("read_idx")["seq"].tolist(), Counter()
        _, reasons = structure_groups(seqs, [minimizers(s, o.k, o.w) for s in seqs], o, seen)
        seen.update({(f"rejected_{k}", 0): n for k, n in reasons.items()})
        return pd.DataFrame([(e, c, n) for (e, c), n in seen.items()], columns=["event", "class", "n"])

    each = members.select("cluster_id", "read_idx", "seq").groupBy("cluster_id").applyInPandas(run, "event string, class int, n long")
    return each.groupBy("event", "class").agg(F.sum("n").alias("n"))


def start_dump(placed: DataFrame, o: IsoformOptions) -> DataFrame:
    """(cluster_id, kind, value): a line for each structure group, start candidate, and way a labelled read begins.

    `placed` has the placements with seq and name. Lines are tab-separated:
    group, reads, labelled, capped, cap signal;
    cand, peak, reads, labelled, capped, reads near, real, cap signal, backbone, reads in each window;
    lead, leading bases, first base, reads.
    """
    prepare(placed.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs, ids, groups = _groups(pdf)
        names, rows, leads = dict(zip(pdf["read_idx"], pdf["name"], strict=True)), [], Counter()
        for placed_reads in groups:
            g = ends.Group(placed_reads, seqs, o)
            known, capped = g.tally()
            rows.append(("group", f"group\t{len(g.reads)}\t{known}\t{capped}\t{int(g.decided().cap_signal)}"))
            leads.update((n, b if b in "ACGT" else "N") for n, b in filter(None, g.leads))
            for c in g.judged():
                windows = ",".join(f"{w}:{n}" for w, n in c["windows"].items())
                rows.append(("cand", "\t".join(map(str, ("cand", c["peak"], c["reads"], c["labelled"], c["capped"], c["near"], int(c["real"]), int(c["signal"]), names[ids[placed_reads[0][0]]], windows)))))
        rows += [("lead", f"{n}\t{b}\t{k}") for (n, b), k in leads.items()]
        return pd.DataFrame([(pdf["cluster_id"].iloc[0], *r) for r in rows], columns=["cluster_id", "kind", "value"])

    each = placed.groupBy("cluster_id").applyInPandas(run, "cluster_id long, kind string, value string")
    parts = F.split("value", "\t")
    leads = each.where("kind = 'lead'").groupBy(parts[0].alias("n"), parts[1].alias("b")).agg(F.sum(parts[2].cast("long")).alias("k"))
    return each.where("kind <> 'lead'").unionByName(leads.select(F.lit(None).cast("long").alias("cluster_id"), F.lit("lead").alias("kind"), F.concat_ws("\t", F.lit("lead"), "n", "b", F.col("k").cast("string")).alias("value")))


def library_line(facts, library) -> str:
    """The decision on a library as a line: library, labelled, capped, cap signal, threshold, candidates, stop fraction."""
    return "\t".join(map(str, ("library", facts.labelled, facts.capped, int(library.cap_signal), library.threshold, facts.candidates, library.stop_fraction)))
