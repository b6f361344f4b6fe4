"""Substring search by an index of trigrams: few candidates are read, and only these are held against the pattern.

The index has each different run of three characters of a text, ASCII case aside, with its capture, in files sorted by gram,
and for each gram how many captures have it. A fragment's grams are those between its wildcards; the rarest of them are
looked up, and a capture that has them all is a candidate. A fragment without three characters in a row between wildcards
has no grams: then all rows are held against the pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.strings import LOWER, UPPER, ascii_lower, like_any_case, text

#: Grams of a fragment that are looked up, at most: the rarest.
LOOKED_UP = 4


def grams(c: Column) -> Column:
    """The different trigrams of a text, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text(c)), F.lit("(?s)(?=(...))"), F.lit(1)))


def fragment_grams(fragment: str) -> list[str]:
    """The trigrams that every match of a fragment has: % and _ are wildcards."""
    plain = fragment.translate(str.maketrans(UPPER, LOWER))
    return sorted({run[i : i + 3] for run in re.split("[%_]", plain) for i in range(len(run) - 2)})


def write_index(rows: DataFrame, id_col: str, columns: list[str], path: str) -> None:
    """The index of some columns of a table: path/grams (gram, id) and path/counts (gram, n). A common gram has many files."""
    found = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))).alias("gram"))
    found.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/grams")
    counts = rows.sparkSession.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, fragment: str) -> DataFrame | None:
    """id: rows that may hold a fragment; None where the index can't tell."""
    wanted = fragment_grams(fragment)
    if not wanted:
        return None
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(wanted)).collect()}  # a row a gram of the fragment
    rarest = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
    held = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(rarest))
    return held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("id")


def search(rows: DataFrame, id_col: str, columns: list[str], path: str, fragment: str) -> DataFrame:
    """The rows of an indexed table of which some of the indexed columns holds a fragment, ASCII case aside, % and _ being wildcards."""
    found = candidates(rows.sparkSession, path, fragment)
    if found is not None:
        rows = rows.join(found.withColumnRenamed("id", id_col), id_col, "left_semi")
    hit = F.lit(False)
    for c in columns:
        hit = hit | like_any_case(text(F.col(c)), fragment)
    return rows.where(hit)
