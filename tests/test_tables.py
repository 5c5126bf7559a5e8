"""Sources, sinks, whole-table operators, the commands, and every registered query against SQL."""

import gzip
import random

import duckdb
import pytest

import __spark_entry__ as driver
from isoloom import cli
from isoloom.operators import cluster as C
from isoloom.operators.components import components
from isoloom.operators.isoforms import isoforms
from isoloom.operators.ranking import ranked
from isoloom.options import ClusterOptions, IsoformOptions
from isoloom.plans import pipeline, registry
from isoloom.plans.fixture import reads
from isoloom.sources import reads as R
from isoloom.sources import sinks as S

SF = "/root/testdata/sf0.001"
ODD_FASTA = "\n\n>r1 first read\nacgt\nACGN  \n\n>r2\n>r3\tx\nTTTT"


def rows(df):
    return [(r.name, r.seq) for r in df.orderBy("read_idx").collect()]


@pytest.mark.parametrize("suffix", ["", ".gz", ".bgz"])
def test_fasta_in_plain_and_multi_member_gzip(spark, tmp_path, suffix):
    path = tmp_path / f"reads.fa{suffix}"
    data = ODD_FASTA.encode()
    path.write_bytes(data if not suffix else gzip.compress(data[:20]) + gzip.compress(data[20:]))
    assert rows(R.load(spark, str(path))) == [("r1", "ACGTACGN"), ("r2", ""), ("r3", "TTTT")]


def test_fastq_ends_at_the_first_line_that_is_no_header(spark, tmp_path):
    path = tmp_path / "reads.fq"
    path.write_text("@a x\nacg\n+\nIII\n@b\nTTT\n+\nIII\n\n@c\nGGG\n+\nIII\n")
    assert rows(R.load(spark, str(path))) == [("a", "ACG"), ("b", "TTT")]
    assert rows(R.load(spark, str(path), max_reads=1)) == [("a", "ACG")]
    (tmp_path / "empty.fq").write_text("\n\n")
    assert rows(R.load(spark, str(tmp_path / "empty.fq"))) == []
    assert len(rows(R.load(spark, f"{path},{path}"))) == 4
    assert [n for n, _ in rows(R.load(spark, f"{path},{path}", max_reads=3))] == ["a", "b", "a"]
    assert [n for n, _ in rows(R.load(spark, f"{path},{path}", max_reads=1))] == ["a"]


def test_a_corrupt_gzip_file_is_an_error(spark, tmp_path):
    path = tmp_path / "reads.fa.gz"
    path.write_bytes(gzip.compress(ODD_FASTA.encode() * 50)[:-20])
    with pytest.raises(Exception):  # noqa: B017
        R.load(spark, str(path)).collect()


def test_assignment_table_rules(spark, tmp_path):
    path = tmp_path / "clusters.tsv"
    path.write_text("read_name\tcluster_id\na\t1\nb\t1\na\t2\nc\tx\nd\t-1\ne\t4294967296\nf\nunknown\t2\n")
    table = R.assignments(spark, str(path))
    assert sorted((r.name, r.cluster_id) for r in table.collect()) == [("a", 1), ("a", 2), ("b", 1), ("unknown", 2)]
    frame = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "read_idx long, name string")
    got = lambda **k: sorted((r.name, r.cluster_id) for r in R.joined(frame, table, **k).collect())
    assert got() == [("a", 2), ("b", 1)] and got(only=[1]) == [("b", 1)] and got(min_size=3) == [] and got(max_size=2) == got()


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ranks_are_dense_and_in_order(spark):
    values = random.Random(5).sample(range(10_000), 500)
    got = ranked(spark.createDataFrame([(v,) for v in values], "v long"), ["v"]).collect()
    assert sorted((r["rank"], r.v) for r in got) == list(enumerate(sorted(values)))


@pytest.mark.parametrize(("max_occ", "fraction", "n", "cap"), [(100_000, 0.01, 13_839_533, 138_395), (100_000, 0.05, 13_839_533, 691_976), (100_000, 0.01, 5000, 100_000), (5, 0.0, 100, 5), (1, 1.0, 10**10, 4294967295)])
def test_cap_grows_with_the_reads(spark, max_occ, fraction, n, cap):
    from pyspark.sql import functions as F

    assert spark.range(1).select(C.effective_max_occ(F.lit(n), max_occ, fraction).alias("c")).first().c == cap


def two_genes():
    r = random.Random(6)
    a, b = ("".join(r.choices("ACGT", k=n)) for n in (1200, 1800))
    return [a[600:], a[300:], a, b[900:], b[500:], b]


def test_longest_read_founds_the_first_cluster(spark):
    frame = spark.createDataFrame([(i, f"r{i}", s, len(s)) for i, s in enumerate(two_genes())], "read_idx long, name string, seq string, len int")
    clusters, facts = C.clustered(frame, ClusterOptions())
    got = {r.read_idx: r.cluster_id for r in clusters.collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0} and facts["reads"] == 6
    summary = {r.key: r.value for r in S.cluster_summary(clusters, facts, ClusterOptions()).collect()}
    assert len(summary) == 19 and summary["clusters"] == "2" and summary["mean_size_multi_clusters"] == "3.00" and summary["top20_sizes"] == "3,3"


def test_clusters_of_the_derived_reads_are_the_genes(spark):
    table = reads(spark, SF)
    clusters = C.clustered(table)[0]
    found = clusters.join(table, "read_idx").groupBy("cluster_id").agg({"true_gene": "min", "read_idx": "count"}).collect()
    assert len(found) == 4


def test_isoforms_of_the_derived_reads(spark):
    table = reads(spark, SF)
    found = isoforms(table.selectExpr("true_gene AS cluster_id", "read_idx", "seq"), IsoformOptions())
    members = found.selectExpr("cluster_id", "coalesce(variant_of, isoform_index) AS i", "explode(members) AS read_idx").join(table, "read_idx")
    mixed = members.groupBy("cluster_id", "i").agg({"true_isoform": "min"}).count()
    by_truth = members.groupBy("cluster_id", "i", "true_isoform").count().count()
    assert mixed == by_truth
    assert members.count() >= 0.9 * table.count()


def test_commands_write_their_files(spark, tmp_path, capsys):
    reads_file = tmp_path / "reads.fq"
    reads_file.write_text("".join(f"@{r.name}\n{r.seq}\n+\n{'I' * r.len}\n" for r in reads(spark, SF).orderBy("read_idx").collect()))
    out = tmp_path / "out"
    found = pipeline.predict(spark, str(reads_file), f"file://{out}", dump_clusters=True, dump_starts=f"file://{out}/starts")
    lines = lambda name: [x for p in sorted((out / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert lines("isoform_summary.tsv")[0] == "cluster_id\tisoform_id\tn_reads\tlength"
    assert sum(x.startswith(">") for x in lines("isoforms.fasta")) == found.where("variant_of IS NULL").count() == len(lines("isoform_summary.tsv")) - 1
    total = sum(int(x.split("\t")[2]) for x in lines("isoform_summary.tsv")[1:])
    assert len(lines("isoform_assignments.tsv")) - 1 == total
    assert len(lines("gene_clusters.tsv")) == reads(spark, SF).count() + 1
    assert {x.split("\t")[0] for x in lines("starts")} >= {"group", "library"}
    table = tmp_path / "clusters.tsv"
    table.write_text("\n".join("\t".join(x.split("\t")[:2]) for x in lines("gene_clusters.tsv")))
    again = pipeline.find_isoforms(spark, str(reads_file), str(table), f"file://{tmp_path}/again", IsoformOptions(start_split="off"))
    assert again.count() > 0
    assert cli.main(["cluster", str(reads_file), "-o", f"file://{tmp_path}/c", "--emit-assignments"]) == 0
    assert cli.main(["cluster", str(reads_file), "-o", "x", "--max-occ-frac", "2"]) == 2
    assert cli.main(["find-isoforms", "--reads", str(reads_file), "--clusters", str(table), "-o", f"file://{tmp_path}/one", "--one-file", "--stats", "--threads", "4", "--batch", "9", "--max-buffer-reads", "9"]) == 0
    named = {x.name for x in (tmp_path / "one").iterdir() if not x.name.startswith(".")}
    assert named == {"isoform_assignments.tsv", "isoform_summary.tsv", "isoforms.fasta", "start_variants.fasta", "start_variant_assignments.tsv"}
    assert (tmp_path / "one" / "isoform_summary.tsv").read_text().splitlines()[0] == "cluster_id\tisoform_id\tn_reads\tlength"
    said = capsys.readouterr().out
    assert "isoforms=" in said and "placements" in said and "seconds: reading" in said
    with pytest.raises(SystemExit) as stop:
        cli.main(["nonsense"])
    assert stop.value.code == 2


def test_column_functions_agree_with_the_kernels(spark):
    """What the library offers as column functions and tables gives what the commands' kernels give."""
    import numpy as np
    from pyspark.sql import functions as F

    from isoloom.functions import dna
    from isoloom.operators import ends, placement, relational, seeds
    from isoloom.operators.merge import primed

    r = random.Random(31)
    texts = ["".join(r.choice("ACGTacgtN") if r.random() < 0.1 else r.choice("ACGT") for _ in range(r.randint(15, 60))) for _ in range(60)]
    texts += ["A" * 12 + t + r.choice("Tt") * r.randint(9, 14) for t in texts[:20]] + ["A" * 30]
    frame = spark.createDataFrame([(i, t, t[5:] + "ACGTTGCA") for i, t in enumerate(texts)], "i long, s string, b string")
    o = IsoformOptions(priming_window=20, priming_a_frac=0.35)
    got = frame.select("i", dna.encode(F.substring("s", 1, 15)).alias("code"), dna.as_unsigned(dna.smer_hash(F.upper("s"), 1, 9)).alias("hash"), dna.is_tail(F.col("s")).alias("tail"), dna.strip_tails(F.col("s")).alias("cut"), dna.primed(F.col("s"), F.lit(3), 20, 0.35).alias("primed"), dna.lead(F.col("s"), F.col("b"), F.lit(0)).alias("lead")).collect()
    for row in got:
        t = texts[row.i]
        code = seeds.codes(t)
        assert row.code == int(seeds.kmer_values(code, 15)[0]) and row.hash == str(int(seeds.smer_hashes(code, 9)[0]))
        assert (row.tail, row.cut, row.primed) == (placement.is_tail(t), placement.strip_tails(t), primed(t, 3, o))
        assert row.lead == (ends.lead(t, t[5:] + "ACGTTGCA", 0) or [None])[0]
    clean = [t.upper().replace("N", "A") for t in texts]
    rows = [(i, p, int(h)) for i, t in enumerate(clean) for p, h in enumerate(seeds.smer_hashes(seeds.codes(t), 9).view(np.int64))]
    found = relational.open_syncmers(spark.createDataFrame(rows, "read_idx long, pos int, h long"), 15, 9, 3).collect()
    assert sorted((x.read_idx, x.pos) for x in found) == [(i, int(p)) for i, t in enumerate(clean) for p in seeds.syncmers(t, 15, 9, 3)[0]]
    centres, points = [5, 30, 31, 90], [(i, r.randint(0, 100)) for i in range(80)]
    near = relational.nearest(spark.createDataFrame([(1, i, x) for i, x in points], "g int, i long, x long"), spark.createDataFrame([(1, c) for c in centres], "g int, peak long"), ["g"], "x", 10).collect()
    assert {x.i: x.key for x in near} == {i: ends.nearest(centres, x, 10) for i, x in points}


def test_library_of_statistics_is_that_of_lists(spark):
    """The decision made by Spark's sums against the one over lists on the driver."""
    from isoloom.operators.ends import StartStats
    from isoloom.operators.isoforms import STATS, library

    r = random.Random(9)
    for blunt in (False, True):
        groups, whole = [], StartStats()
        for g in range(60):
            n = r.randint(5, 40)
            high = [r.random() < 0.4 for _ in range(3)]
            pairs = [(r.choice([0.9, 0.95, 1.0]) if h else r.choice([0.0, 0.05, 0.1]), round(r.random() / 2 + (0.5 if h != blunt else 0), 2)) for h in high]
            stops = [round(r.random() * (0.3 if r.random() < 0.6 else 1.0), 3) for _ in range(4)]
            groups.append((1, g, n, n, n // 2, [{"share": a, "sharpness": b} for a, b in pairs], stops))
            whole.add(StartStats(n, n // 2, pairs, stops))
        o = IsoformOptions()
        assert library(spark.createDataFrame(groups, STATS), o) == whole.library(o)
        assert library(spark.createDataFrame(groups[:5], STATS), o) == StartStats(sum(g[3] for g in groups[:5]), sum(g[4] for g in groups[:5]), [(0.0, 0.0)] * 15, []).library(o)
    assert library(spark.createDataFrame([], STATS), IsoformOptions()) == StartStats().library(IsoformOptions())


def test_components_say_when_they_have_not_settled(spark, monkeypatch):
    from isoloom.operators import components as module

    monkeypatch.setattr(module, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        module.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from isoloom import runtime

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        runtime.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_placement_counts(spark):
    from isoloom.operators.diagnostics import placement_counts

    members = reads(spark, SF).selectExpr("true_gene AS cluster_id", "read_idx", "seq")
    got = {(r.event, r["class"]): r.n for r in placement_counts(members, IsoformOptions()).collect()}
    assert got["placements", 0] >= 0.9 * members.count() and got["rejected_interior_gap", 0] == got["gap_jumps", 0] > 0


def test_start_variant_files(spark):
    found = spark.createDataFrame([(7, 0, "ACGT", False, None, None, [1, 2]), (7, 1, "CGT", True, 0, 1, [3]), (7, 2, "AACGT", False, 0, -1, [4])], "cluster_id long, isoform_index int, consensus string, alt_start boolean, variant_of int, start_offset int, members array<long>")
    names = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "read_idx long, name string")
    assert [r.value for r in S.isoform_fasta(found).collect()] == [">7.0 reads=4 len=4 start_variants=2\nACGT"]
    assert [r.value for r in S.start_variant_fasta(found).collect()] == [">7.v0_0 variant_of=7.0 start_offset=+1 reads=1 len=3 alt_start=1\nCGT", ">7.v0_1 variant_of=7.0 start_offset=-1 reads=1 len=5\nAACGT"]
    assert [tuple(r) for r in S.isoform_assignments(found, names).collect()] == [(f"r{i}", 7, "7.0") for i in (1, 2, 3, 4)]
    assert [tuple(r) for r in S.start_variant_assignments(found, names).collect()] == [("r3", 7, "7.v0_0", "7.0"), ("r4", 7, "7.v0_1", "7.0")]
    assert [tuple(r) for r in S.isoform_summary(found).collect()] == [(7, "7.0", 4, 4)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert got.count() > 0
        return
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_entry_and_registrations(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
