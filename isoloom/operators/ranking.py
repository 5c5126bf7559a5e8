"""Row numbers over a whole table without sending it through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoloom.runtime import partitions, written


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """`df` with the 0-based number of each row in `order`, which must tell all rows apart.

    Rows are dealt by range, numbered within their partition, and shifted by the sizes of the
    partitions before: only these sizes, one a partition, are gathered.
    """
    n = partitions(df.sparkSession)
    dealt = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")
