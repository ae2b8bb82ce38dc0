"""Running numbers in a global order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.session import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, 1, 2, ... in the given order, which must be total.

    Rows are range-partitioned and written with their partition's number; each partition is numbered on its own, and
    the partitions' sizes, as many as there are partitions, become offsets.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = sorted((r["__p"], r["count"]) for r in placed.groupBy("__p").count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    offset = F.create_map(*offsets)[F.col("__p")] if offsets else F.lit(0)
    return placed.withColumn(name, (inside + offset).cast("long")).drop("__p")
