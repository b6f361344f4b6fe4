"""Full-text index: a postings table of folded tokens by capture and field, its rebuild and its verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.strings import text, unaccented

#: What separates tokens: all but letters, numbers and private-use characters.
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


def tokens(c: Column, fold=unaccented) -> Column:
    """The different tokens of a text."""
    return F.filter(F.array_distinct(F.split(fold(text(c)), SEPARATORS)), lambda t: t != "")


def postings(captures: DataFrame, texts: DataFrame, fold=unaccented) -> DataFrame:
    """capture_id, field, token. captures: id, title; texts: capture_id, content_text. Captures without text are indexed by title."""
    body = texts.select("capture_id", F.lit("content_text").alias("field"), F.explode(tokens(F.col("content_text"), fold)).alias("token")).join(captures.select(F.col("id").alias("capture_id")), "capture_id", "left_semi")
    title = captures.select(F.col("id").alias("capture_id"), F.lit("title").alias("field"), F.explode(tokens(F.col("title"), fold)).alias("token"))
    return title.unionByName(body)


def matching(captures: DataFrame, texts: DataFrame, terms: list[str], fold=unaccented) -> DataFrame:
    """capture_id: captures of which every term starts some token of title or text, found without an index. One bit a term and row moves, never a text."""

    def bit(ts: Column, i: int) -> Column:
        return F.when(F.exists(ts, lambda t: t.startswith(terms[i])), F.lit(1 << i)).otherwise(F.lit(0))

    def bits(c: Column) -> Column:
        # The array binds the tokens, which each term looks at.
        return F.transform(F.array(tokens(c, fold)), lambda ts: reduce(Column.bitwiseOR, [bit(ts, i) for i in range(len(terms))]))[0]

    known = captures.select(F.col("id").alias("capture_id"), bits(F.col("title")).alias("terms"), F.lit(True).alias("known"))
    found = texts.select("capture_id", bits(F.col("content_text")).alias("terms"), F.lit(False).alias("known")).where("terms > 0")
    both = known.unionByName(found).groupBy("capture_id").agg(F.bit_or("terms").alias("terms"), F.bool_or("known").alias("known"))
    return both.where(F.col("known") & (F.col("terms") == (1 << len(terms)) - 1)).select("capture_id")


def write_postings(index: DataFrame, path: str) -> None:
    """Sorted by token within files, so that a prefix reads few row groups; a common token has as many files as it needs."""
    index.repartitionByRange("token", "capture_id").sortWithinPartitions("token", "capture_id").write.mode("overwrite").parquet(path)


def verify(captures: DataFrame, indexed: DataFrame) -> DataFrame:
    """captures, indexed, missing, extra, ok: one row. captures: id; indexed: capture_id, one row per indexed capture."""
    ids, have = captures.select("id"), indexed.select(F.col("capture_id").alias("id"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(ids, "captures").crossJoin(one(have, "indexed")).crossJoin(one(ids.join(have, "id", "left_anti"), "missing")).crossJoin(one(have.join(ids, "id", "left_anti"), "extra"))
    return counts.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0))


def repair(captures: DataFrame, texts: DataFrame, index: DataFrame, fold=unaccented) -> DataFrame:
    """The index without what belongs to no capture, with what is missing."""
    known = index.join(captures.select(F.col("id").alias("capture_id")), "capture_id", "left_semi")
    missing = captures.join(index.select(F.col("capture_id").alias("id")).distinct(), "id", "left_anti")
    return known.unionByName(postings(missing, texts.join(missing.select(F.col("id").alias("capture_id")), "capture_id", "left_semi"), fold))
