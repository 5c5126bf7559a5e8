"""The registered queries of the clustering engine over derived reads, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoloom.functions import dna
from isoloom.operators import cluster as C
from isoloom.operators import ends, placement
from isoloom.operators import minimizers as M
from isoloom.operators import relational as R
from isoloom.operators import seeds as kernels
from isoloom.operators.components import components
from isoloom.operators.isoforms import isoforms
from isoloom.operators.merge import primed
from isoloom.operators.seeds import BASE_HASH, seeds
from isoloom.options import ClusterOptions, IsoformOptions
from isoloom.plans.fixture import MINIMIZERS_SQL, READS_SQL, genes, minimizers, reads
from isoloom.plans.pipeline import isoform_counts
from isoloom.runtime import prepare, written
from isoloom.sources import sinks as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = READS_SQL):
    """Register a function, and SQL after the common tables of `base`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {base}{', ' if sql.lstrip().split()[0] != 'SELECT' else ' '}{sql}"
        return f

    return add


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true genes as clusters."""
    return reads(spark, sf_dir).select("read_idx", F.col("true_gene").alias("cluster_id"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true places as placements: a group is a gene's isoform."""
    return reads(spark, sf_dir).select("true_gene", "true_isoform", "read_idx", F.col("true_start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _mapped(table: DataFrame, names: list[str], schema: str, f) -> DataFrame:
    """`f` of the named columns of each row gives a tuple of the schema: runs a kernel as the commands do, on Arrow batches."""
    prepare(table.sparkSession)
    into = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f(*row) for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(into, r, strict=True)) for r in rows], schema=pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in schema.split(", "))]))

    return table.select(*names).mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

_PLACED = 'placed AS (SELECT true_gene, true_isoform, read_idx, true_start::BIGINT AS start, "end"::BIGINT AS "end" FROM reads)'
_GROUP = ["true_gene", "true_isoform"]


@query("SELECT read_idx, name, true_gene, true_isoform, true_start::INT AS true_start, md5(seq) AS seq_md5, length(seq)::INT AS len FROM reads")
def derived_reads(spark, sf_dir):
    return reads(spark, sf_dir).select("read_idx", "name", "true_gene", "true_isoform", "true_start", F.md5("seq").alias("seq_md5"), "len")


@query("SELECT read_idx, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM reads")
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("read_idx", F.md5(dna.reverse_complement(F.col("seq"))).alias("rc_md5"))


_ALL_KMERS = "(SELECT read_idx, seq, unnest(range(length(seq) - {k} + 1)) AS pos FROM reads)"


@query(f"""SELECT read_idx, count(*) AS n_kmers, sum({' + '.join(f"(instr('ACGT', substr(seq, pos::INT + {i}, 1)) - 1) * {4 ** (15 - i)}::BIGINT" for i in range(1, 16))})::BIGINT AS kmer_sum FROM {_ALL_KMERS.format(k=15)} GROUP BY read_idx""")
def kmer_encoding(spark, sf_dir):
    def one(i, seq):
        v = kernels.kmer_values(kernels.codes(seq), 15)
        return i, len(v), int(v.sum())

    return _mapped(reads(spark, sf_dir), ["read_idx", "seq"], "read_idx long, n_kmers long, kmer_sum long", one)


def _rotated(h: int, by: int) -> int:
    return (h << by | h >> (64 - by)) & ((1 << 64) - 1)


def _smer_sql(at: str, s: int = 9) -> str:
    case = lambda i: f"CASE substr(seq, {at} + {i}, 1) " + " ".join(f"WHEN '{b}' THEN {_rotated(h, s - 1 - i)}::UBIGINT" for b, h in zip("ACGT", BASE_HASH.tolist(), strict=True)) + " END"
    out = case(0)
    for i in range(1, s):
        out = f"xor({out}, {case(i)})"
    return out


@query(f"SELECT read_idx, count(*) AS n_smers, bit_xor({_smer_sql('pos::INT + 1')})::VARCHAR AS hash_xor, min({_smer_sql('pos::INT + 1')})::VARCHAR AS hash_min FROM {_ALL_KMERS.format(k=9)} GROUP BY read_idx")
def smer_hash(spark, sf_dir):
    def one(i, seq):
        h = kernels.smer_hashes(kernels.codes(seq), 9)
        return i, len(h), str(int(np.bitwise_xor.reduce(h))), str(int(h.min()))

    return _mapped(reads(spark, sf_dir), ["read_idx", "seq"], "read_idx long, n_smers long, hash_xor string, hash_min string", one)


@query(f"""sm AS (SELECT read_idx, pos, {_smer_sql('pos::INT + 1')} AS h FROM (SELECT read_idx, seq, unnest(range(length(seq) - 8)) AS pos FROM reads)),
w AS (SELECT read_idx, pos, count(*) OVER f AS n, min(lpad(h::VARCHAR, 20, '0') || lpad(pos::VARCHAR, 6, '0')) OVER f AS m FROM sm WINDOW f AS (PARTITION BY read_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT read_idx, count(*) AS n_syncmers, sum(pos)::BIGINT AS pos_sum FROM w WHERE n = 7 AND substr(m, 21)::BIGINT = pos + 3 GROUP BY read_idx""")
def open_syncmers(spark, sf_dir):
    def one(i, seq):
        at, _ = kernels.syncmers(seq, 15, 9, 3)
        return i, len(at), int(at.sum())

    return _mapped(reads(spark, sf_dir), ["read_idx", "seq"], "read_idx long, n_syncmers long, pos_sum long", one).where("n_syncmers > 0")


@query("""l AS (SELECT true_gene, read_idx, length(seq) AS len, lag(length(seq)) OVER w AS a, lead(length(seq)) OVER w AS b FROM reads WINDOW w AS (PARTITION BY true_gene ORDER BY read_idx))
SELECT read_idx, (coalesce(len < a, true) AND coalesce(len < b, true)) AS is_min, (coalesce(len > a, true) AND coalesce(len > b, true)) AS is_max FROM l""")
def local_extremes(spark, sf_dir):
    return R.local_extremes(reads(spark, sf_dir), ["true_gene"], "read_idx", "len").select("read_idx", "is_min", "is_max")


@query("SELECT read_idx, kmer, pos FROM mz", MINIMIZERS_SQL)
def read_minimizers(spark, sf_dir):
    return M.read_minimizers(reads(spark, sf_dir))


@query("SELECT read_idx, kmer, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM mz GROUP BY read_idx, kmer", MINIMIZERS_SQL)
def kmer_runs(spark, sf_dir):
    return R.kmer_runs(minimizers(spark, sf_dir)).select("read_idx", "kmer", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT kmer, count(DISTINCT read_idx) AS n_reads FROM mz GROUP BY kmer", MINIMIZERS_SQL)
def seed_counts(spark, sf_dir):
    table = minimizers(spark, sf_dir).select("read_idx", F.col("kmer").alias("h"), F.lit(1).alias("level")).distinct()
    return C.seed_counts(table).select(F.col("h").alias("kmer"), "n_reads")


_INFORMATIVE = """d AS (SELECT kmer, count(DISTINCT read_idx) AS n_reads FROM mz GROUP BY kmer),
inf AS (SELECT kmer, n_reads FROM d WHERE n_reads BETWEEN 2 AND (SELECT greatest(20, floor(0.01::DOUBLE * count(*))::BIGINT) FROM reads))"""


def _informative(spark, sf_dir):
    cap = reads(spark, sf_dir).agg(C.effective_max_occ(F.count("*"), 20, 0.01).alias("cap"))
    table = minimizers(spark, sf_dir).select("read_idx", F.col("kmer").alias("h"), (F.col("kmer") % 4 + 1).cast("int").alias("level")).distinct()
    counts = C.seed_counts(table)
    return table, C.informative(counts.crossJoin(F.broadcast(cap)), 2, F.col("cap")).drop("cap")  # one row


@query(f"{_INFORMATIVE} SELECT r.true_gene, count(DISTINCT m.kmer) AS n_informative, count(*) AS n_pairs FROM (SELECT DISTINCT read_idx, kmer FROM mz) m JOIN inf USING (kmer) JOIN reads r USING (read_idx) GROUP BY r.true_gene", MINIMIZERS_SQL)
def gene_informative_seeds(spark, sf_dir):
    table, keep = _informative(spark, sf_dir)
    rows = table.join(keep.select("h"), "h").join(reads(spark, sf_dir).select("read_idx", "true_gene"), "read_idx")
    return rows.groupBy("true_gene").agg(F.count_distinct("h").alias("n_informative"), F.count("*").alias("n_pairs"))


@query(f"{_INFORMATIVE} SELECT read_idx, count(*) AS n_seeds, sum(CASE kmer % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 4 END)::BIGINT AS weight FROM (SELECT DISTINCT read_idx, kmer FROM mz) JOIN inf USING (kmer) GROUP BY read_idx", MINIMIZERS_SQL)
def weighted_seeds(spark, sf_dir):
    table, keep = _informative(spark, sf_dir)
    return C.weighted_seeds(table, keep, (1, 2, 5)).groupBy("read_idx").agg(F.count("*").alias("n_seeds"), F.sum("weight").alias("weight"))


@query("SELECT greatest(5, least(floor(0.01::DOUBLE * count(*)), 4294967295)::BIGINT) AS cap FROM reads")
def effective_cap(spark, sf_dir):
    return reads(spark, sf_dir).agg(C.effective_max_occ(F.count("*"), 5, 0.01).alias("cap"))


@query("SELECT read_idx, row_number() OVER (ORDER BY length(seq) DESC, read_idx) - 1 AS rank FROM reads")
def length_order(spark, sf_dir):
    return C.length_order(reads(spark, sf_dir))


@query("s AS (SELECT true_gene, count(*) AS cluster_size FROM reads GROUP BY 1) SELECT cluster_size, count(*) AS num_clusters FROM s GROUP BY 1")
def cluster_size_histogram(spark, sf_dir):
    return C.size_histogram(_clusters(spark, sf_dir))


@query("SELECT true_gene AS cluster_id, count(*) AS cluster_size FROM reads GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_cluster_sizes(spark, sf_dir):
    return C.top_sizes(_clusters(spark, sf_dir))


@query("SELECT true_gene AS cluster_id, count(*) AS cluster_size FROM reads GROUP BY 1 HAVING count(*) BETWEEN 25 AND 40")
def eligible_clusters(spark, sf_dir):
    return C.eligible(_clusters(spark, sf_dir), 25, 40)


@query("s AS (SELECT true_gene, count(*) AS n FROM reads GROUP BY 1) SELECT count(*) AS clusters, count(*) FILTER (n = 1) AS singleton_clusters, count(*) FILTER (n > 1) AS multi_read_clusters, max(n) AS largest_cluster, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS reads_in_multi, sum(n)::BIGINT AS reads FROM s")
def cluster_summary(spark, sf_dir):
    return C.size_summary(_clusters(spark, sf_dir))


@query("SELECT name AS read_name, true_gene AS cluster_id, count(*) OVER (PARTITION BY true_gene) AS cluster_size FROM reads")
def gene_clusters(spark, sf_dir):
    return S.gene_clusters(_clusters(spark, sf_dir), reads(spark, sf_dir).select("read_idx", "name"))


@query("SELECT name AS read_name, true_gene AS cluster_id FROM reads")
def cluster_assignments(spark, sf_dir):
    return S.cluster_assignments(_clusters(spark, sf_dir), reads(spark, sf_dir).select("read_idx", "name"))


_PAIRS = """b AS (SELECT true_gene, arg_min(read_idx, (-length(seq)) * 1000000000 + read_idx) AS bb FROM reads GROUP BY 1),
a AS (SELECT x.read_idx, x.pos AS read_pos, y.pos AS backbone_pos FROM reads r JOIN b USING (true_gene) JOIN mz x ON x.read_idx = r.read_idx JOIN mz y ON y.read_idx = b.bb AND y.kmer = x.kmer WHERE r.read_idx <> b.bb)"""


def _anchors(spark, sf_dir):
    """Anchors of every read with the longest read of its gene."""
    r = reads(spark, sf_dir).select("read_idx", "true_gene", "len")
    back = r.groupBy("true_gene").agg(F.min_by("read_idx", F.struct(-F.col("len"), "read_idx")).alias("bb"))
    m = minimizers(spark, sf_dir)
    left = m.join(r.select("read_idx", "true_gene"), "read_idx").join(back, "true_gene").where("read_idx <> bb").drop("bb")
    right = m.join(back.withColumnRenamed("bb", "read_idx"), "read_idx").drop("read_idx")
    return M.shared_anchors(left, right, ["true_gene"]).select("read_idx", "read_pos", "backbone_pos")


@query(f"{_PAIRS} SELECT read_idx, count(*) AS n_anchors, sum(read_pos)::BIGINT AS read_sum, sum(backbone_pos)::BIGINT AS backbone_sum FROM a GROUP BY 1", MINIMIZERS_SQL)
def shared_anchors(spark, sf_dir):
    return _anchors(spark, sf_dir).groupBy("read_idx").agg(F.count("*").alias("n_anchors"), F.sum("read_pos").alias("read_sum"), F.sum("backbone_pos").alias("backbone_sum"))


_CHAIN = f"""{_PAIRS}, c AS (SELECT *, max(backbone_pos) OVER (PARTITION BY read_idx ORDER BY read_pos, backbone_pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
g AS (SELECT read_idx, read_pos, backbone_pos FROM c WHERE before IS NULL OR backbone_pos > before)"""


@query(f"{_CHAIN} SELECT read_idx, count(*) AS n_chain, min(backbone_pos) AS first, max(backbone_pos) AS last FROM g GROUP BY 1", MINIMIZERS_SQL)
def greedy_chain(spark, sf_dir):
    return M.greedy_chain(_anchors(spark, sf_dir), ["read_idx"]).groupBy("read_idx").agg(F.count("*").alias("n_chain"), F.min("backbone_pos").alias("first"), F.max("backbone_pos").alias("last"))


@query(f"""{_CHAIN}, p AS (SELECT read_idx, read_pos - lag(read_pos) OVER w - 15 AS x, backbone_pos - lag(backbone_pos) OVER w - 15 AS y FROM g WINDOW w AS (PARTITION BY read_idx ORDER BY read_pos))
SELECT read_idx, count(*) FILTER (greatest(x, y, 0) > 10) AS wide, count(*) FILTER (greatest(x, y, 0) > 10 AND abs(greatest(x, 0) - greatest(y, 0)) >= 64) AS jumps FROM p GROUP BY 1""", MINIMIZERS_SQL)
def interior_gaps(spark, sf_dir):
    w = Window.partitionBy("read_idx").orderBy("read_pos")
    gap = lambda c: F.greatest(F.col(c) - F.lag(c).over(w) - 15, F.lit(0))
    rows = M.greedy_chain(_anchors(spark, sf_dir), ["read_idx"]).select("read_idx", F.when(F.lag("read_pos").over(w).isNotNull(), gap("read_pos")).alias("x"), F.when(F.lag("read_pos").over(w).isNotNull(), gap("backbone_pos")).alias("y"))
    wide = F.coalesce(F.greatest("x", "y") > 10, F.lit(False))
    return rows.groupBy("read_idx").agg(F.count_if(wide).alias("wide"), F.count_if(wide & (F.abs(F.col("x") - F.col("y")) >= 64)).alias("jumps"))


_TAILED = "repeat('A', (read_idx % 16)::INT) || seq || repeat(CASE WHEN read_idx % 2 = 0 THEN 'A' ELSE 'a' END, (read_idx % 20)::INT)"


@query(f"""SELECT read_idx, (length(t) >= 10 AND greatest(length(t) - length(replace(upper(t), 'A', '')), length(t) - length(replace(upper(t), 'C', '')), length(t) - length(replace(upper(t), 'G', '')), length(t) - length(replace(upper(t), 'T', ''))) >= length(t) * 0.8) AS is_tail
FROM (SELECT read_idx, right({_TAILED}, 12) AS t FROM reads)""")
def homopolymer_tails(spark, sf_dir):
    tailed = F.expr(_TAILED.replace("::INT", "").replace("(read_idx % 16)", "int(read_idx % 16)").replace("(read_idx % 20)", "int(read_idx % 20)"))
    ends_ = reads(spark, sf_dir).select("read_idx", tailed.alias("t")).select("read_idx", F.expr("right(t, 12)").alias("t"))
    return _mapped(ends_, ["read_idx", "t"], "read_idx long, is_tail boolean", lambda i, t: (i, placement.is_tail(t)))


def _strip_sql(x: str) -> str:
    for end in ("$", "^"):
        for b in ("Aa", "Cc", "Gg", "Tt"):
            x = f"regexp_replace({x}, '[{b}]{{11,}}$', right({x}, 1))" if end == "$" else f"regexp_replace({x}, '^[{b}]{{11,}}', left({x}, 1))"
    return x


@query(f"t AS (SELECT read_idx, {_TAILED} AS t FROM reads), e AS (SELECT read_idx, length(t) AS before, t, length(t) - length(regexp_replace(t, '[Aa]+$', '')) AS n FROM t), f AS (SELECT *, CASE WHEN n > 10 THEN left(t, (length(t) - n + 1)::INT) ELSE t END AS u FROM e), g AS (SELECT *, length(u) - length(regexp_replace(u, '^[Aa]+', '')) AS m FROM f) SELECT read_idx, length(CASE WHEN m > 10 THEN substr(u, m::INT) ELSE u END)::INT AS len, md5(CASE WHEN m > 10 THEN substr(u, m::INT) ELSE u END) AS stripped_md5 FROM g")
def strip_tails(spark, sf_dir):
    tailed = F.expr(_TAILED.replace("::INT", "").replace("(read_idx % 16)", "int(read_idx % 16)").replace("(read_idx % 20)", "int(read_idx % 20)"))
    cut = _mapped(reads(spark, sf_dir).select("read_idx", tailed.alias("t")), ["read_idx", "t"], "read_idx long, s string", lambda i, t: (i, placement.strip_tails(t)))
    return cut.select("read_idx", F.length("s").alias("len"), F.md5("s").alias("stripped_md5"))


@query("""pts AS (SELECT true_gene, true_isoform, list(true_start::BIGINT ORDER BY true_start) AS p FROM reads GROUP BY 1, 2),
rec AS (WITH RECURSIVE r AS (SELECT true_gene, true_isoform, p, NULL::BIGINT AS peak FROM pts UNION ALL
    SELECT true_gene, true_isoform, list_concat(p[1:i - 1], p[i + n:]), p[(2 * i + n - 1) // 2] FROM
        (SELECT *, c[i] AS n FROM (SELECT *, list_position(c, list_max(c)) AS i FROM
            (SELECT true_gene, true_isoform, p, list_transform(p, lambda a: length(list_filter(p, lambda x: x >= a AND x - a <= 10))) AS c FROM r WHERE length(p) > 0))) WHERE n >= 3) SELECT * FROM r)
SELECT true_gene, true_isoform, peak FROM rec WHERE peak IS NOT NULL""")
def start_peaks(spark, sf_dir):
    return R.peaks(_placed(spark, sf_dir), _GROUP, "start", 10, 3)


_CENTRES = "centres AS (SELECT DISTINCT true_gene, true_isoform, (true_start // 50) * 50 + 7::BIGINT AS peak FROM reads)"


def _centres(spark, sf_dir):
    return reads(spark, sf_dir).select(*_GROUP, (F.floor(F.col("true_start") / 50) * 50 + 7).cast("long").alias("peak")).distinct()


@query(f"""{_PLACED}, {_CENTRES} SELECT p.read_idx, (SELECT arg_min(c.peak, abs(c.peak - p.start) * 100000 + c.peak) FROM centres c WHERE c.true_gene = p.true_gene AND c.true_isoform = p.true_isoform AND abs(c.peak - p.start) <= 20) AS key FROM placed p""")
def nearest_peak(spark, sf_dir):
    centres = _centres(spark, sf_dir).groupBy(*_GROUP).agg(F.sort_array(F.collect_list("peak")).alias("c"))
    rows = _placed(spark, sf_dir).join(centres, _GROUP)
    return _mapped(rows, ["read_idx", "c", "start"], "read_idx long, key long", lambda i, c, x: (i, ends.nearest(c, x, 20)))


_KEYED = _PLACED + ', keyed AS (SELECT *, (start // 40) * 40 AS start_key, ("end" // 30) * 30 AS end_key FROM placed)'
_DENSE = """dense AS (SELECT true_gene, true_isoform, start_key, end_key, count(*) AS support, list_sort(list(start))[1] AS lo, list_sort(list("end"))[count(*)] AS hi FROM keyed GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)"""


def _keyed(spark, sf_dir):
    floor = lambda c, n: (F.floor(F.col(c) / n) * n).cast("long")
    return _placed(spark, sf_dir).withColumn("start_key", floor("start", 40)).withColumn("end_key", floor("end", 30))


@query(f"{_KEYED}, {_DENSE} SELECT * FROM dense")
def dense_cells(spark, sf_dir):
    return R.cells(_keyed(spark, sf_dir), _GROUP, 3)


@query(f"""{_KEYED}, {_DENSE},
c AS (SELECT k.read_idx, d.start_key, d.end_key, row_number() OVER (PARTITION BY k.read_idx ORDER BY CASE WHEN d.start_key = k.start_key AND d.end_key = k.end_key THEN 0 ELSE 1 END, d.support DESC, d.start_key, d.end_key) AS n
    FROM keyed k JOIN dense d ON d.true_gene = k.true_gene AND d.true_isoform = k.true_isoform AND ((d.start_key = k.start_key AND d.end_key = k.end_key) OR (d.lo <= k.start + 15 AND d.hi >= k."end" - 15)))
SELECT k.read_idx, c.start_key, c.end_key FROM keyed k LEFT JOIN c ON c.read_idx = k.read_idx AND c.n = 1""")
def containment_fold(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return R.folded(keyed, R.cells(keyed, _GROUP, 3), _GROUP, 15).select("read_idx", "start_key", "end_key")


@query(f"""{_PLACED}, {_CENTRES} SELECT c.true_gene, c.true_isoform, c.peak, count(*) FILTER (abs(p.start - c.peak) <= 25) AS starting, count(*) FILTER (p.start < c.peak - 25 AND p."end" > c.peak + 25) AS passing
FROM centres c JOIN placed p ON p.true_gene = c.true_gene AND p.true_isoform = c.true_isoform GROUP BY 1, 2, 3""")
def stop_fractions(spark, sf_dir):
    return R.stop_counts(_placed(spark, sf_dir), _centres(spark, sf_dir), _GROUP)


def _lead_sql() -> str:
    tests = [f"WHEN length(substr(seq, {n + 1}, 12)) = 12 AND (" + " OR ".join(f"substr(dna, ({b})::INT + 1, 12) = substr(seq, {n + 1}, 12)" for b in ("true_start", "greatest(true_start - 1, 0)", "true_start + 1")) + f") THEN {n}" for n in range(4)]
    return "CASE " + " ".join(tests) + " END"


@query(f"SELECT read_idx, {_lead_sql()} AS lead, left(seq, 1) AS first FROM reads JOIN genes USING (true_gene)")
def untemplated_lead(spark, sf_dir):
    rows = reads(spark, sf_dir).join(genes(spark, sf_dir), "true_gene")

    def one(i, seq, dna, start):
        n, first = ends.lead(seq, dna, start) or (None, seq[:1])
        return i, n, first

    return _mapped(rows, ["read_idx", "seq", "dna", "true_start"], "read_idx long, lead int, first string", one)


_SHARES = "v AS (SELECT true_gene, (count(*) FILTER (left(seq, 1) = 'G')::DOUBLE / count(*))::FLOAT AS v, count(*) % 7 AS sharp, count(*) FILTER (true_isoform = 1) > count(*) * 0.33 AS flag FROM reads GROUP BY 1)"


def _shares(spark, sf_dir):
    n = F.count("*")
    return reads(spark, sf_dir).groupBy("true_gene").agg((F.count_if(F.col("seq").startswith("G")).cast("double") / n).cast("float").alias("v"), (n % 7).alias("sharp"), (F.count_if(F.col("true_isoform") == 1) > n * F.lit(0.33)).alias("flag"))


@query(f"""{_SHARES}, b AS (SELECT least(floor(v::DOUBLE * 100), 99)::INT AS bin, count(*)::DOUBLE AS n FROM v GROUP BY 1),
r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS below, sum(n * ((bin + 0.5) / 100)) OVER (ORDER BY bin) AS weight, sum(n) OVER () AS al, sum(n * ((bin + 0.5) / 100)) OVER () AS total FROM b),
s AS (SELECT bin, round(below * (al - below) * power(weight / below - (total - weight) / (al - below), 2), 6) AS between_var FROM r WHERE al > below)
SELECT coalesce((SELECT (bin + 1) / 100.0::DOUBLE FROM s ORDER BY between_var DESC, bin LIMIT 1), 0.7::DOUBLE) AS cut""")
def otsu_cut(spark, sf_dir):
    return R.otsu(_shares(spark, sf_dir))


@query(f"""{_SHARES}, r AS (SELECT flag, 2 * rank() OVER (ORDER BY sharp) + count(*) OVER (PARTITION BY sharp) - 1 AS twice FROM v)
SELECT count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2, coalesce(sum(twice) FILTER (flag), 0)::BIGINT AS twice_rank_sum FROM r""")
def rank_test(spark, sf_dir):
    return R.rank_sums(_shares(spark, sf_dir), "sharp", "flag")


@query("SELECT true_gene, true_isoform, count(*) AS n FROM reads GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY n DESC")
def draft_isoforms(spark, sf_dir):
    return reads(spark, sf_dir).groupBy(*_GROUP).agg(F.count("*").alias("n")).where("n >= 10").orderBy(F.desc("n"), *_GROUP)


_UNIQUE = "u AS (SELECT read_idx, kmer, pos, row_number() OVER (PARTITION BY read_idx ORDER BY pos) - 1 AS boundary FROM (SELECT *, count(*) OVER (PARTITION BY read_idx, kmer) AS n FROM mz) WHERE n = 1)"


@query(f"{_UNIQUE} SELECT read_idx, count(*) AS n_boundaries, sum(pos)::BIGINT AS pos_sum, max(boundary)::INT AS last FROM u GROUP BY 1", MINIMIZERS_SQL)
def unique_boundaries(spark, sf_dir):
    return R.unique_boundaries(minimizers(spark, sf_dir)).groupBy("read_idx").agg(F.count("*").alias("n_boundaries"), F.sum("pos").alias("pos_sum"), F.max("boundary").alias("last"))


_HITS = f"""{_UNIQUE}, b AS (SELECT true_gene, arg_min(read_idx, (-length(seq)) * 1000000000 + read_idx) AS bb FROM reads GROUP BY 1),
h AS (SELECT r.true_gene, x.read_idx, y.boundary, x.pos, r.seq FROM reads r JOIN b USING (true_gene) JOIN u x ON x.read_idx = r.read_idx JOIN u y ON y.read_idx = b.bb AND y.kmer = x.kmer)"""


def _hits(spark, sf_dir):
    """Where reads hold a boundary of their gene's longest read, once in both."""
    r = reads(spark, sf_dir).select("read_idx", "true_gene", "len")
    back = r.groupBy("true_gene").agg(F.min_by("read_idx", F.struct(-F.col("len"), "read_idx")).alias("read_idx"))
    u = R.unique_boundaries(minimizers(spark, sf_dir))
    return u.drop("boundary").join(r.drop("len"), "read_idx").join(u.join(back, "read_idx").select("true_gene", "kmer", "boundary"), ["true_gene", "kmer"]).select("true_gene", "read_idx", "boundary", "pos")


@query(f"""{_HITS}, s AS (SELECT true_gene, read_idx, min(boundary) AS a, max(boundary) AS z FROM h GROUP BY 1, 2), t AS (SELECT true_gene, boundary, count(*) AS support FROM h GROUP BY 1, 2)
SELECT t.true_gene, t.boundary::INT AS boundary, count(*) AS depth, any_value(t.support) AS support FROM t JOIN s ON s.true_gene = t.true_gene AND t.boundary BETWEEN s.a AND s.z GROUP BY 1, 2""", MINIMIZERS_SQL)
def depth_and_support(spark, sf_dir):
    return R.depth_and_support(_hits(spark, sf_dir), ["true_gene"])


@query("SELECT true_gene, read_idx, place::INT AS place FROM (SELECT true_gene, read_idx, row_number() OVER (PARTITION BY true_gene ORDER BY length(seq) DESC, read_idx) AS place FROM reads WHERE true_isoform = 0) WHERE place <= 16")
def consensus_helpers(spark, sf_dir):
    r = reads(spark, sf_dir)
    return R.helpers(r, r.where("true_isoform = 1"), ["true_gene"]).select("true_gene", "read_idx", "place")


_VOTES = f"""{_HITS}, e AS (SELECT true_gene, boundary, lead(boundary) OVER w AS nx, pos, lead(pos) OVER w AS stop, seq FROM h WINDOW w AS (PARTITION BY true_gene, read_idx ORDER BY boundary)),
votes AS (SELECT true_gene, boundary, substr(seq, pos + 1, stop - pos) AS segment, count(*) AS votes FROM e WHERE nx = boundary + 1 GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY true_gene, boundary ORDER BY votes DESC, segment) AS place FROM votes)"""


def _votes(spark, sf_dir):
    return R.window_votes(_hits(spark, sf_dir), reads(spark, sf_dir), ["true_gene"])


def _modal(spark, sf_dir):
    return R.modal(_votes(spark, sf_dir), ["true_gene"], F.lit(""))


@query(f"{_VOTES} SELECT true_gene, boundary::INT AS boundary, segment, votes FROM votes", MINIMIZERS_SQL)
def window_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


@query(f"{_VOTES} SELECT true_gene, boundary::INT AS boundary, segment, votes FROM best WHERE place = 1", MINIMIZERS_SQL)
def modal_segments(spark, sf_dir):
    return _modal(spark, sf_dir)


@query(f"{_VOTES} SELECT true_gene, string_agg(segment, '' ORDER BY boundary) AS seq FROM best WHERE place = 1 GROUP BY 1", MINIMIZERS_SQL)
def consensus_assembly(spark, sf_dir):
    return R.assembled(_modal(spark, sf_dir), ["true_gene"])


@query("""SELECT read_idx, (length(w) > 0 AND length(w) - length(replace(w, 'A', '')) >= 0.35::DOUBLE * length(w)) AS primed FROM (SELECT read_idx, substr(dna, "end"::INT - 100 + 1, 20) AS w FROM reads JOIN genes USING (true_gene))""")
def internal_priming(spark, sf_dir):
    rows = reads(spark, sf_dir).join(genes(spark, sf_dir), "true_gene").withColumn("at", F.col("end") - 100)
    o = IsoformOptions(priming_window=20, priming_a_frac=0.35)
    return _mapped(rows, ["read_idx", "dna", "at"], "read_idx long, primed boolean", lambda i, dna, at: (i, primed(dna, at, o)))


@query("s AS (SELECT true_gene, count(*) AS n FROM reads GROUP BY 1) SELECT r.read_idx, r.name, r.true_gene AS cluster_id FROM reads r JOIN s USING (true_gene) WHERE s.n BETWEEN 25 AND 40")
def assigned_reads(spark, sf_dir):
    from isoloom.sources.reads import joined

    r = reads(spark, sf_dir)
    table = r.select("name", F.col("true_gene").alias("cluster_id"), F.col("read_idx").alias("line"))
    return joined(r.select("read_idx", "name"), table, None, 25, 40).select("read_idx", "name", "cluster_id")


@query("SELECT CASE WHEN length(seq) >= 900 THEN 900 WHEN length(seq) >= 800 THEN 800 WHEN length(seq) >= 700 THEN 700 ELSE 0 END::INT AS size_class, count(*) AS n FROM reads GROUP BY 1")
def size_classes(spark, sf_dir):
    return reads(spark, sf_dir).groupBy(R.size_class(F.col("len"), (700, 800, 900)).alias("size_class")).agg(F.count("*").alias("n"))


@query("""e AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders), m AS (SELECT o_custkey, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey AS node, first AS component FROM orders JOIN m USING (o_custkey) WHERE n > 1""")
def connected_orders(spark, sf_dir):
    """Orders of one customer form one component, linked as a chain."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    chain = o.withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("next IS NOT NULL")
    return components(chain, "o_orderkey", "next")


# ---- kernels and whole commands: no SQL equivalent ----


@query()
def read_seeds(spark, sf_dir):
    return seeds(reads(spark, sf_dir)).groupBy("read_idx", "level").agg(F.count("*").alias("n_seeds"))


@query()
def greedy_clusters(spark, sf_dir):
    return C.clustered(reads(spark, sf_dir), ClusterOptions())[0]


@query()
def predicted_isoforms(spark, sf_dir):
    r = reads(spark, sf_dir)
    clusters = written(C.clustered(r, ClusterOptions())[0], "clusters")
    found = isoforms(clusters.join(r.select("read_idx", "seq"), "read_idx"), IsoformOptions())
    return S.isoform_summary(found)


@query()
def isoforms_of_genes(spark, sf_dir):
    r = reads(spark, sf_dir)
    found = isoforms(r.select(F.col("true_gene").alias("cluster_id"), "read_idx", "seq"), IsoformOptions(start_split="off"), whole_library=False)
    return isoform_counts(found)
