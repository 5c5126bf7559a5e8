"""The result tables and files of clustering and isoform detection.

Each function gives a DataFrame whose rows are the lines of a file, in order by its sort columns;
`save` writes one as sorted part files, or as a single file on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoloom.operators.cluster import cluster_sizes, size_histogram, size_summary


def isoform_id(cluster: Column, index: Column) -> Column:
    return F.concat_ws(".", cluster.cast("string"), index.cast("string"))


def labelled(isoforms: DataFrame) -> DataFrame:
    """Isoforms with their ids; a start variant also has the id and index of its isoform."""
    k = F.row_number().over(Window.partitionBy("cluster_id", "variant_of").orderBy("isoform_index")) - 1
    parent = F.coalesce("variant_of", "isoform_index")
    return (
        isoforms.withColumn("parent", parent)
        .withColumn("k", F.when(F.col("variant_of").isNotNull(), k))
        .withColumn("isoform_id", isoform_id(F.col("cluster_id"), F.col("parent")))
        .withColumn("variant_id", F.when(F.col("variant_of").isNotNull(), F.concat(F.col("cluster_id").cast("string"), F.lit(".v"), F.col("variant_of").cast("string"), F.lit("_"), F.col("k").cast("string"))))
    )


def _members(isoforms: DataFrame, names: DataFrame) -> DataFrame:
    rows = labelled(isoforms).select("cluster_id", "parent", "k", "isoform_id", "variant_id", F.posexplode("members").alias("ord", "read_idx"))
    return rows.join(names.select("read_idx", F.col("name").alias("read_name")), "read_idx").withColumn("k", F.coalesce("k", F.lit(-1)))


def isoform_assignments(isoforms: DataFrame, names: DataFrame) -> DataFrame:
    """read_name, cluster_id, isoform_id; a variant's reads stand under its isoform."""
    return _members(isoforms, names).orderBy("cluster_id", "parent", "k", "ord").select("read_name", "cluster_id", "isoform_id")


def start_variant_assignments(isoforms: DataFrame, names: DataFrame) -> DataFrame:
    """read_name, cluster_id, variant_id, isoform_id."""
    return _members(isoforms, names).where("variant_id IS NOT NULL").orderBy("cluster_id", "parent", "k", "ord").select("read_name", "cluster_id", "variant_id", "isoform_id")


def _counted(isoforms: DataFrame) -> DataFrame:
    rows = labelled(isoforms)
    sums = rows.groupBy("cluster_id", "parent").agg(F.sum(F.size("members")).alias("n_reads"), F.count("variant_id").alias("n_variants"))
    return rows.where("variant_id IS NULL").join(sums, ["cluster_id", "parent"])


def isoform_summary(isoforms: DataFrame) -> DataFrame:
    """cluster_id, isoform_id, n_reads (its variants' too), length."""
    return _counted(isoforms).orderBy("cluster_id", "parent").select("cluster_id", "isoform_id", "n_reads", F.length("consensus").alias("length"))


def _alt() -> Column:
    return F.when(F.col("alt_start"), " alt_start=1").otherwise("")


def isoform_fasta(isoforms: DataFrame) -> DataFrame:
    """One record a row: header and sequence."""
    variants = F.when(F.col("n_variants") > 0, F.concat(F.lit(" start_variants="), F.col("n_variants").cast("string"))).otherwise("")
    head = F.concat(F.lit(">"), F.col("isoform_id"), F.lit(" reads="), F.col("n_reads").cast("string"), F.lit(" len="), F.length("consensus").cast("string"), variants, _alt())
    return _counted(isoforms).orderBy("cluster_id", "parent").select(F.concat_ws("\n", head, "consensus").alias("value"))


def start_variant_fasta(isoforms: DataFrame) -> DataFrame:
    head = F.concat(F.lit(">"), F.col("variant_id"), F.lit(" variant_of="), F.col("isoform_id"), F.lit(" start_offset="), F.format_string("%+d", F.col("start_offset")), F.lit(" reads="), F.size("members").cast("string"), F.lit(" len="), F.length("consensus").cast("string"), _alt())
    return labelled(isoforms).where("variant_id IS NOT NULL").orderBy("cluster_id", "parent", "k").select(F.concat_ws("\n", head, "consensus").alias("value"))


def gene_clusters(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """read_name, cluster_id, cluster_size, by cluster and file order."""
    return clusters.join(cluster_sizes(clusters), "cluster_id").join(names, "read_idx").orderBy("cluster_id", "read_idx").select(F.col("name").alias("read_name"), "cluster_id", "cluster_size")


def cluster_assignments(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """read_name, cluster_id in file order."""
    return clusters.join(names, "read_idx").orderBy("read_idx").select(F.col("name").alias("read_name"), "cluster_id")


def cluster_histogram(clusters: DataFrame) -> DataFrame:
    return size_histogram(clusters).orderBy("cluster_size")


def cluster_summary(clusters: DataFrame, facts: dict, options) -> DataFrame:
    """The 19 rows (key, value) of a clustering's summary, in order."""
    sizes = size_summary(clusters)
    top = [r["cluster_size"] for r in cluster_sizes(clusters).orderBy(F.desc("cluster_size"), "cluster_id").limit(20).collect()]
    s = sizes.first()
    many = s["multi_read_clusters"]
    rows = [
        ("reads", facts["reads"]), ("k", options.k), ("s", options.s), ("levels", options.levels), ("min_occ", options.min_occ), ("max_occ", facts["max_occ"]), ("max_occ_frac", options.max_occ_frac),
        ("min_shared", options.min_shared), ("min_shared_frac", options.min_shared_frac), ("level_weights", ",".join(map(str, options.level_weights))), ("distinct_seeds", facts["distinct_seeds"]), ("informative_seeds", facts["informative_seeds"]),
        ("clusters", s["clusters"]), ("singleton_clusters", s["singleton_clusters"]), ("multi_read_clusters", many), ("largest_cluster", s["largest_cluster"]), ("mean_size_multi_clusters", f"{s['reads_in_multi'] / many if many else 0:.2f}"),
        ("pct_reads_in_multi_clusters", f"{100 * s['reads_in_multi'] / s['reads'] if s['reads'] else 0:.2f}"), ("top20_sizes", ",".join(map(str, top))),
    ]
    return clusters.sparkSession.createDataFrame([(i, k, str(v)) for i, (k, v) in enumerate(rows)], "ord int, key string, value string").orderBy("ord").select("key", "value")


def save(df: DataFrame, path: str, header: bool = True, one_file: bool = False) -> None:
    """Write a result under `path`, in its order: text for one column named value, else tab-separated.

    A folder of sorted part files, each with the header; with `one_file` a file of that name, which
    all rows reach through one task.
    """
    spark = df.sparkSession
    to = f"{path}.parts" if one_file else path
    out = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    if df.columns == ["value"]:
        out.text(to)
    else:
        out.option("sep", "\t").option("header", header).option("quote", "").csv(to)
    if one_file:
        jvm = spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in fs.listStatus(at(to)) if f.getPath().getName().startswith("part-"))
        fs.delete(at(path), True)
        fs.rename(part, at(path))
        fs.delete(at(to), True)
