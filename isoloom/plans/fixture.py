"""Reads derived from the whole of lineitem and part: 960-base genes, two isoforms each, truncated and edited copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.operators.minimizers import read_minimizers
from isoloom.operators.ranking import ranked
from isoloom.runtime import prepare, written

#: Parts that make one gene, and the pieces of 32 bases of its sequence.
GENE_PARTS, PIECES, HEX, BASES = 50, 30, "0123456789abcdef", "ACGTACGTACGTACGT"
_tables: dict[tuple, DataFrame] = {}


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(true_gene, dna): one gene of every GENE_PARTS parts."""
    key = F.col("true_gene").cast("string")
    pieces = [F.translate(F.md5(F.concat(F.lit("gene"), key, F.lit(f"_{i}"))), HEX, BASES) for i in range(PIECES)]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(f"p_partkey div {GENE_PARTS}").alias("true_gene")).distinct()
    return parts.select("true_gene", F.concat(*pieces).alias("dna"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is in one read: sums over a read's lines say what it looks like."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("true_gene", F.expr(f"l_partkey div {GENE_PARTS}"))
    slot = F.expr("(l_orderkey + 7 * l_linenumber) % (12 + true_gene % 37)")
    sums = [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("l_orderkey", "orders"), ("l_linenumber", "lines"), ("l_quantity", "pieces"), ("l_suppkey", "sources"))]
    rows = lines.groupBy("true_gene", slot.alias("slot")).agg(*sums, F.count_if(F.col("l_returnflag") == "R").alias("returned")).join(genes(spark, sf_dir), "true_gene")
    order = ["orders", "true_gene", "slot"]
    start = F.when(F.col("pieces") % 4 < 2, F.lit(0)).otherwise(10 * (F.col("orders") % 20)).cast("int")
    iso = (F.col("lines") % 3 == 0).cast("int")
    tx = F.when(iso == 1, F.concat(F.substring("dna", 1, 320), F.expr("substring(dna, 481)"))).otherwise(F.col("dna"))
    cut = rows.select(*order, F.concat_ws("_", F.concat(F.lit("r"), F.col("true_gene").cast("string")), "slot", "orders").alias("name"), iso.alias("true_isoform"), start.alias("true_start"), tx.alias("tx"), "sources", "returned")
    cut = cut.withColumn("body", F.substring("tx", F.col("true_start") + 1, (F.length("tx") - F.col("true_start") - F.col("sources") % 4).cast("int")))
    seq = F.concat(F.when(F.col("returned") % 3 == 0, "G").otherwise(""), "body")
    seq = F.when(F.col("orders") % 7 == 0, F.concat(F.substring(seq, 1, 299), F.substring(seq, F.lit(301), F.length(seq)))).otherwise(seq)
    made = cut.withColumn("end", (F.col("true_start") + F.length("body")).cast("int")).withColumn("seq", seq)
    numbered = ranked(made.select(*order, "name", "true_isoform", "true_start", "end", "seq"), order, "read_idx")
    return numbered.select(F.col("read_idx").cast("long").alias("read_idx"), "name", "true_gene", "true_isoform", "true_start", "end", "seq", F.length("seq").alias("len"))


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table is an input of many queries: made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        prepare(spark)
        _tables[key] = written(make(), name)
    return _tables[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_idx, name, true_gene, true_isoform, true_start, end, seq, len."""
    return _kept(spark, sf_dir, "reads", lambda: _derived(spark, sf_dir))


def minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_idx, kmer, pos."""
    return _kept(spark, sf_dir, "minimizers", lambda: read_minimizers(reads(spark, sf_dir)))


READS_SQL = f"""genes AS (SELECT true_gene, {' || '.join(f"translate(md5('gene' || true_gene || '_{i}'), '{HEX}', '{BASES}')" for i in range(PIECES))} AS dna FROM (SELECT DISTINCT p_partkey // {GENE_PARTS} AS true_gene FROM part)),
lines AS (SELECT true_gene, (l_orderkey + 7 * l_linenumber) % (12 + true_gene % 37) AS slot, sum(l_orderkey)::BIGINT AS orders, sum(l_linenumber)::BIGINT AS lines, sum(l_quantity::BIGINT)::BIGINT AS pieces, sum(l_suppkey)::BIGINT AS sources, count(*) FILTER (l_returnflag = 'R') AS returned
    FROM (SELECT *, l_partkey // {GENE_PARTS} AS true_gene FROM lineitem) GROUP BY 1, 2),
base AS (SELECT row_number() OVER (ORDER BY orders, true_gene, slot) - 1 AS read_idx, 'r' || true_gene || '_' || slot || '_' || orders AS name,
    true_gene, CASE WHEN lines % 3 = 0 THEN 1 ELSE 0 END AS true_isoform, CASE WHEN pieces % 4 < 2 THEN 0 ELSE 10 * (orders % 20) END AS true_start,
    CASE WHEN lines % 3 = 0 THEN substr(dna, 1, 320) || substr(dna, 481) ELSE dna END AS tx, sources % 4 AS cut, returned, orders FROM lines JOIN genes USING (true_gene)),
bodies AS (SELECT *, substr(tx, true_start + 1, length(tx) - true_start - cut) AS body FROM base),
capped AS (SELECT *, CASE WHEN returned % 3 = 0 THEN 'G' ELSE '' END || body AS s FROM bodies),
reads AS MATERIALIZED (SELECT read_idx, name, true_gene, true_isoform, true_start, true_start + length(body) AS "end", CASE WHEN orders % 7 = 0 THEN substr(s, 1, 299) || substr(s, 301) ELSE s END AS seq FROM capped)"""

_VALUE = " + ".join(f"(instr('ACGT', substr(km, {i}, 1)) - 1) * {4 ** (15 - i)}::BIGINT" for i in range(1, 16))
MINIMIZERS_SQL = f"""{READS_SQL},
kms AS (SELECT read_idx, pos, substr(seq, pos::INT + 1, 15) AS km, count(*) OVER (PARTITION BY read_idx) AS n FROM (SELECT read_idx, seq, unnest(range(length(seq) - 14)) AS pos FROM reads)),
wins AS (SELECT read_idx, pos, n, min(km || lpad(pos::VARCHAR, 6, '0')) OVER (PARTITION BY read_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m FROM kms),
picked AS (SELECT DISTINCT read_idx, substr(m, 1, 15) AS km, substr(m, 16)::INT AS pos FROM wins WHERE pos <= n - 10),
mz AS MATERIALIZED (SELECT read_idx, {_VALUE} AS kmer, pos FROM picked WHERE km NOT IN ('AAAAAAAAAAAAAAA', 'CCCCCCCCCCCCCCC', 'GGGGGGGGGGGGGGG', 'TTTTTTTTTTTTTTT'))"""
