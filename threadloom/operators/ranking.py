"""Row numbers within groups of any size.

A window sorts a whole group in one task.  Groups up to ``big`` rows take that path; rows of
larger groups are range-partitioned by (key, order), numbered inside each partition, and shifted by
what the same group has in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.runtime import materialise


def grouped_row_number(df: DataFrame, key: str, size: str, order: list[Column], out: str, big: int = 1_000_000) -> DataFrame:
    """``df`` with ``out`` = 1, 2, ... within ``key`` by ``order``; column ``size`` has the group's number of rows."""
    plain = Window.partitionBy(key).orderBy(*order)
    small = df.where(F.col(size) <= big).withColumn(out, F.row_number().over(plain))
    hot = df.where(F.col(size) > big)
    if hot.isEmpty():
        return small
    ranged = materialise(hot.repartitionByRange(F.col(key), *order).withColumn("_p", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p", key).orderBy(*order)))
    counts = ranged.groupBy(key, "_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    shifted = inside.join(before, [key, "_p"]).withColumn(out, (F.col("_k") + F.col("_before")).cast("int"))
    return small.unionByName(shifted.drop("_p", "_k", "_before").select(*small.columns))
