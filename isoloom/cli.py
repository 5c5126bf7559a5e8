"""Command line: python -m isoloom.cli cluster | predict | find-isoforms."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from isoloom.options import ClusterOptions, IsoformOptions
from isoloom.plans import pipeline

_FLOATS = {"min_cov", "min_gap_ident", "cap_threshold", "stop_threshold", "collapse_ratio", "collapse_ident", "priming_a_frac", "max_occ_frac", "min_shared_frac"}
_LISTED = {"start_split": "auto, on, off", "cap_signal": "auto, on, off", "cap_g": "trim, keep", "consensus_tail": "backbone, vote", "alt_starts": "keep, merge", "end_merge": "ratio, polya", "start_variants": "report, keep"}
#: What each option does, by its field.
HELP = {
    "k": "length of the k-mers",
    "s": "length of the s-mers that choose syncmers",
    "t": "place of the smallest s-mer within its k-mer; the middle if not given",
    "levels": "levels of locally consistent parsing above the syncmers",
    "min_occ": "reads a seed must occur in to count",
    "max_occ": "reads a seed may occur in at most",
    "max_occ_frac": "the same as a share of all reads; the larger of both holds",
    "min_shared": "weight of shared seeds needed to join a cluster",
    "min_shared_frac": "the same as a share of the read's own weight",
    "level_weights": "weight of a seed by level, separated by commas; the last holds for the levels above",
    "max_reads": "reads taken from the input, over all files",
    "w": "k-mers in a window of which the smallest is the minimizer",
    "min_anchors": "shared minimizers needed to place a read",
    "min_cov": "share of the read its chain must cover",
    "max_gap": "largest stretch between anchors that is not aligned",
    "min_gap_ident": "identity needed in an aligned stretch",
    "max_indel_run": "longest gap allowed in an aligned stretch",
    "max_gap_jump": "difference between the two sides of a stretch from which it is refused unaligned",
    "max_flank": "bases that may be left over at either end",
    "start_split": "where isoforms are split by start",
    "peak_width": "width of the window that makes a peak of starts or ends",
    "boundary_tol": "distance from a peak within which a read belongs to it",
    "cap_signal": "whether reads that begin with an untemplated G mark true starts",
    "cap_threshold": "share of capped reads that makes a start real; found from the library if not given",
    "stop_threshold": "share of reads that stop rather than pass at a real start; found from the library if not given",
    "min_iso": "reads an isoform needs",
    "cap_g": "what becomes of leading Gs of the cap",
    "consensus_tail": "how the 3' end of a consensus is made",
    "collapse_gap": "longest gap between isoforms that are still copies",
    "collapse_ratio": "size, as a share of the larger isoform, up to which a smaller one can merge into it",
    "collapse_ident": "identity of isoforms that are copies",
    "alt_starts": "what becomes of isoforms at alternative starts",
    "end_merge": "what lets an isoform with an earlier 3' end merge",
    "priming_window": "bases past the end that are searched for A",
    "priming_a_frac": "share of A there that tells internal priming",
    "start_variants": "what becomes of isoforms that differ in little but their start",
    "start_variant_window": "distance between the starts of such variants",
}


def _options(parser: argparse.ArgumentParser, kind, skip: tuple[str, ...] = (), prefix: dict | None = None) -> None:
    for f in fields(kind):
        if f.name in skip:
            continue
        flag = (prefix or {}).get(f.name, f.name)
        read = (lambda x: tuple(int(y) for y in x.split(","))) if f.name == "level_weights" else float if f.name in _FLOATS else str if isinstance(f.default, str) else int
        told = HELP[f.name] + (f" ({_LISTED[f.name]})" if f.name in _LISTED else "") + ("" if f.default is None else f"; default {','.join(map(str, f.default)) if isinstance(f.default, tuple) else f.default}")
        parser.add_argument(f"--{flag.replace('_', '-')}", dest=flag, type=read, default=f.default, help=told)


def _made(kind, args: argparse.Namespace, prefix: dict | None = None, skip: tuple[str, ...] = ()):
    return kind(**{f.name: getattr(args, (prefix or {}).get(f.name, f.name)) for f in fields(kind) if f.name not in skip})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="isoloom", description="Cluster long transcript reads and detect isoforms, on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cluster", help="reads to gene clusters")
    p = sub.add_parser("predict", help="reads to gene clusters and isoforms")
    f = sub.add_parser("find-isoforms", aliases=["isoforms", "isofinder"], help="isoforms of given clusters")
    for x in (c, p):
        x.add_argument("reads", help="FASTA or FASTQ, plain or gzip; several separated by commas")
        _options(x, ClusterOptions)
    c.add_argument("--emit-assignments", action="store_true", help="also write the cluster of every read")
    _options(p, IsoformOptions, ("library",), {"k": "iso_k", "w": "iso_w"})
    p.add_argument("--dump-clusters", action="store_true", help="also write the cluster of every read")
    p.add_argument("--dump-starts", default=None, help="path for what start validation saw")
    _options(f, IsoformOptions, ("library",))
    f.add_argument("--reads", required=True, help="FASTA or FASTQ, plain or gzip; several separated by commas")
    f.add_argument("--clusters", required=True, help="tab-separated table of read names and cluster numbers")
    f.add_argument("--only-clusters", type=lambda x: [int(y) for y in x.split(",")], default=None, help="clusters to work on, separated by commas")
    for x in (p, f):
        x.add_argument("--min-size", type=int, default=1, help="reads a cluster needs")
        x.add_argument("--max-size", type=int, default=None, help="reads a cluster may have at most")
        x.add_argument("--split-starts", dest="start_split", action="store_const", const="on", help="the same as --start-split on")
        x.add_argument("--no-split-starts", dest="start_split", action="store_const", const="off", help="the same as --start-split off")
        x.add_argument("--stats", action="store_true", help="also count how reads were placed, which places them once more")
    for x in (c, p, f):
        x.add_argument("-o", "--out", required=True, help="folder for the results")
        x.add_argument("--one-file", action="store_true", help="write each result as one file of its name, through one task, instead of sorted part files")
        for flag in ("--threads", "--batch", "--max-buffer-reads"):
            x.add_argument(flag, type=int, default=None, help="accepted without effect: Spark decides on tasks and memory")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        co = _made(ClusterOptions, args) if args.command in ("cluster", "predict") else None
        renamed = {"k": "iso_k", "w": "iso_w"} if args.command == "predict" else None
        io = _made(IsoformOptions, args, renamed, ("library",)) if args.command != "cluster" else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("isoloom").getOrCreate()
    if args.command == "cluster":
        pipeline.cluster(spark, args.reads, args.out, co, args.emit_assignments, args.one_file)
    elif args.command == "predict":
        pipeline.predict(spark, args.reads, args.out, co, io, args.min_size, args.max_size, args.dump_clusters, args.dump_starts, args.one_file, args.stats)
    else:
        pipeline.find_isoforms(spark, args.reads, args.clusters, args.out, io, args.only_clusters, args.min_size, args.max_size, args.one_file, args.stats)
    return 0


if __name__ == "__main__":
    sys.exit(main())
