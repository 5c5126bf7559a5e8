"""Reading FASTA and FASTQ files, plain or gzip (.gz, .bgz), as a Spark data source.

    spark.dataSource.register(ReadsSource)
    spark.read.format("reads").load("reads.fastq.gz")

gives read_idx, name, seq in file order. A gzip stream cannot be split, so a file is one
partition; several paths, separated by commas, are read side by side, numbered in that order.
A file that ends early or is corrupt raises an error.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_idx long, name string, seq string"
BATCH = 2000


def first_word(header: str) -> str:
    words = header[1:].split()
    return words[0] if words else ""


def fasta(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Records of any number of lines; blank lines before a header don't count."""
    name, parts = None, []
    for line in lines:
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts).upper()
            name, parts = first_word(line), []
        elif name is not None:
            parts.append(line.rstrip())
        elif line.strip():
            return
    if name is not None:
        yield name, "".join(parts).upper()


def fastq(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Records of four lines; the first that has no '@' ends the file."""
    for header in lines:
        rest = [next(lines, None) for _ in range(3)]
        if not header.startswith("@") or None in rest:
            return
        yield first_word(header), rest[0].rstrip().upper()


def records(path: str) -> Iterator[tuple[str, str]]:
    """The records of a file; its first line that isn't blank tells the format."""
    opened = gzip.open if path.endswith((".gz", ".bgz")) else open
    with opened(path, "rt", encoding="latin-1", newline="\n") as f:
        first = next((x for x in f if x.strip()), None)
        if first is None:
            return

        def lines() -> Iterator[str]:
            yield first
            yield from f

        yield from fasta(lines()) if first.startswith(">") else fastq(lines())


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__(number)
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p.strip().removeprefix("file://") for p in options["path"].split(",")]
        self.most = int(options["max_reads"]) if "max_reads" in options else None

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition):
        rows: list[tuple[int, str, str]] = []

        def batch() -> pa.RecordBatch:
            ids, names, seqs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(seqs)], names=["read_idx", "name", "seq"])

        for i, (name, seq) in enumerate(records(partition.path)):
            if self.most is not None and i >= self.most:
                break
            rows.append((partition.number << 40 | i, name, seq))
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class ReadsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def load(spark: SparkSession, path: str, max_reads: int | None = None) -> DataFrame:
    """read_idx, name, seq, len of one file or several; at most `max_reads`, over all of them in order."""
    from isoloom.runtime import prepare

    prepare(spark).dataSource.register(ReadsSource)
    reader = spark.read.format("reads")
    if max_reads is not None:
        reader = reader.option("max_reads", max_reads)
    table = reader.load(path).withColumn("len", F.length("seq"))
    if max_reads is not None and "," in path:  # no file gives more, but all together can: one number a file is gathered
        file = F.shiftright("read_idx", 40)
        left, keep = max_reads, F.lit(False)
        for r in table.groupBy(file.alias("file")).agg(F.count("*").alias("n")).orderBy("file").collect():
            keep |= (file == r["file"]) & (F.col("read_idx").bitwiseAND((1 << 40) - 1) < left)
            left = max(left - r["n"], 0)
        table = table.where(keep)
    return table


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """(name, cluster_id, line, last) of a tab-separated table of clusters.

    A line whose second field is no number below 2**32 is left out, headers too. Of lines with the
    same name the last counts; sizes are taken over all lines.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    rows = lines.select(F.get(parts, F.lit(0)).alias("name"), F.expr("try_cast(regexp_extract(get(split(value, '\t'), 1), '^[+]?[0-9]+$', 0) AS bigint)").alias("cluster_id"), "line")
    return rows.where("cluster_id BETWEEN 0 AND 4294967295")


def joined(reads: DataFrame, table: DataFrame, only: list[int] | None = None, min_size: int = 1, max_size: int | None = None) -> DataFrame:
    """Reads with their cluster, for clusters within the size range."""
    sizes = table.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    if max_size is not None:
        sizes = sizes.where(F.col("size") <= max_size)
    if only is not None:
        sizes = sizes.where(F.col("cluster_id").isin([int(c) for c in only]))
    last = table.groupBy("name").agg(F.max_by("cluster_id", "line").alias("cluster_id")).join(sizes, "cluster_id", "left_semi")
    return reads.join(last, "name")
