"""Global row numbers without a global window, and pages by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators import graph


def numbered(rows: DataFrame, order: list[Column], column: str = "n") -> DataFrame:
    """rows with their number from 1 in an order. Each partition numbers its own range, and one count a partition is handed on."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = graph.stored(rows.repartitionByRange(parts, *order).withColumn("_block", F.spark_partition_id()), "ordered")
    counts = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_count"))
    before = counts.select("_block", F.coalesce(F.sum("_count").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return blocks.join(F.broadcast(before), "_block").withColumn(column, here + F.col("_before")).drop("_block", "_before")  # one row a partition


def write_pages(found: DataFrame, path: str, rows_in_file: int = 1_000_000) -> None:
    """Captures in order of recency with their rank, in files and row groups of consecutive ranks: a page needs no sort and opens what holds its ranks."""
    ranked = numbered(found, [F.desc("updated_at"), F.col("id")], "rank")
    files = max(1, -(-found.count() // rows_in_file))
    ranked.repartitionByRange(files, "rank").sortWithinPartitions("rank").write.mode("overwrite").parquet(path)


def read_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """A page of stored captures: the rank's bounds reach the scan, whose statistics rule out all other row groups."""
    first = (max(1, number) - 1) * size
    return spark.read.parquet(path).where(F.col("rank").between(first + 1, first + size)).orderBy("rank")
