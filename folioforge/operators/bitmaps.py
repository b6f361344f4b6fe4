"""Memberships as bitmaps: 64 captures a word, so set operations are bit operations, and counts that changes keep up.

For captures whose identifiers are whole numbers. A bitmap table has collection_id, word and mask: the bit of a capture is
its identifier's last six bits in the word of the others. Word tables are joined by word, never by capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(items: DataFrame) -> DataFrame:
    """The bitmaps of memberships (collection_id, capture_id). Rows fold where they lie."""
    n = F.col("capture_id").cast("long")
    bit = F.expr("shiftleft(1L, cast(pmod(n, 64) as int))")
    return items.select("collection_id", n.alias("n")).select("collection_id", F.shiftright("n", 6).alias("word"), bit.alias("bit")).groupBy("collection_id", "word").agg(F.bit_or("bit").alias("mask"))


def members(maps: DataFrame) -> DataFrame:
    """collection_id, capture_id (long) of bitmaps."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1)
    return maps.select("collection_id", (F.shiftleft("word", 6)).alias("base"), F.explode(bits).alias("bit")).select("collection_id", (F.col("base") + F.col("bit")).alias("capture_id"))


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.withColumnRenamed("mask", "other"), keys, "left").withColumn("other", F.coalesce("other", F.lit(0).cast("long")))


def difference(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("collection_id", "word")) -> DataFrame:
    """What bitmaps have that others don't."""
    return _met(left, right, list(keys)).withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not("other"))).where("mask != 0").select(*left.columns)


def common(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("collection_id", "word")) -> DataFrame:
    """What bitmaps have that others have too."""
    return _met(left, right, list(keys)).withColumn("mask", F.col("mask").bitwiseAND(F.col("other"))).where("mask != 0").select(*left.columns)


def counts(maps: DataFrame) -> DataFrame:
    """collection_id, count."""
    return maps.groupBy("collection_id").agg(F.sum(F.bit_count("mask")).cast("long").alias("count"))


def changed_counts(known: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts (collection_id, count) kept up by the memberships that a change added and removed; collections without any go."""
    signed = lambda items, sign: items.groupBy("collection_id").agg((sign * F.count(F.lit(1))).alias("count"))
    met = known.select("collection_id", "count").unionByName(signed(added, 1)).unionByName(signed(removed, -1))
    return met.groupBy("collection_id").agg(F.sum("count").alias("count")).where("count != 0")


def drift(known: DataFrame, items: DataFrame) -> DataFrame:
    """collection_id, count, recount where kept counts are not those of the memberships: a recount as proof."""
    recount = items.groupBy("collection_id").agg(F.count(F.lit(1)).alias("recount"))
    met = known.join(recount, "collection_id", "full").select("collection_id", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("recount", F.lit(0)).alias("recount"))
    return met.where("count != recount")
