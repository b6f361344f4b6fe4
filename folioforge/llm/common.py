"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.cluster import spread
from folioforge.operators.graph import shared_dir, stored  # noqa: F401

#: ASCII white space, the separator between words in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for queries that work long on each row: small ones are dealt to all cores."""
    return spread(table(spark, sf_dir, name))


def whole(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; reads no more than one row beyond that."""
    return df.limit(most + 1).count() <= most


#: Keys that more than one in HEAVY rows has, fewer than HEAVY in all, are joined by broadcast.
HEAVY = 1000


def joined_by_weight(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows with the facts of their keys, null keys included. facts: one row a key; `weight` is how many of the `total` rows have it.

    Heavy keys are broadcast, so no task gathers the rows of one; all others meet by a shuffle. Both are read twice.
    """
    named = facts.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in facts.columns if c not in (*on, weight)], F.col(weight).alias("_weight"))
    heavy, light = named.where(F.col("_weight") * HEAVY > total), named.where(F.col("_weight") * HEAVY <= total)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    keys = F.broadcast(heavy.select(*[f"_{c}" for c in on]))  # fewer than HEAVY rows
    met = rows.join(F.broadcast(heavy), same).unionByName(rows.join(keys, same, "left_anti").join(light, same))
    return met.drop("_weight", *[f"_{c}" for c in on])


def bits_for(count: int, most: int) -> int:
    """Bits of a bitmap for so many values, a power of two: 16 a value, but at most `most`."""
    return min(most, 1 << max(16, (16 * count - 1).bit_length() if count else 0))


def bitmap(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """word, mask: a bitmap of the hashes (longs) in a column, 64 bits a row, so at most bits / 64 rows whatever the data."""
    bit = hashes.select(F.pmod(F.col(column), F.lit(bits)).alias("bit"))
    return bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))


def maybe_held(rows: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """The rows whose hash (a long) may be in a bitmap: all that are, and few others. The bitmap is broadcast: at most bits / 64 rows of two longs."""
    bit = F.pmod(F.col(column), F.lit(bits))
    probed = rows.withColumn("_word", F.shiftright(bit, 6)).withColumn("_place", bit.bitwiseAND(F.lit(63)).cast("int"))
    probed = probed.join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))), "_word")
    return probed.where(F.expr("_mask & shiftleft(1L, _place) != 0")).select(*rows.columns)
