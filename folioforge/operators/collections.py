"""Collections of captures: counts, membership, and changes as set differences.

Changes take the tables as they are and return them as they become, with the number of changed rows as a DataFrame where it
is asked for; writing them back is the caller's business (see sources.store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.strings import ascii_lower


class CollectionError(ValueError):
    """A change that the data don't allow."""


def with_counts(collections: DataFrame, items: DataFrame) -> DataFrame:
    """id, name, count: all collections with their number of captures, by name (ASCII case aside), then id."""
    counts = items.groupBy("collection_id").agg(F.count("capture_id").alias("count"))
    joined = collections.join(counts, collections["id"] == counts["collection_id"], "left")
    return joined.select("id", "name", F.coalesce("count", F.lit(0)).alias("count")).orderBy(ascii_lower(F.col("name")), "id")


def membership(collections: DataFrame, items: DataFrame, capture_id) -> DataFrame:
    """id, name, selected: all collections with whether they hold a capture."""
    held = items.where(F.col("capture_id") == capture_id).select(F.col("collection_id").alias("id"), F.lit(1).alias("selected"))
    return collections.join(held, "id", "left").select("id", "name", F.coalesce("selected", F.lit(0)).alias("selected")).orderBy(ascii_lower(F.col("name")), "id")


def to_add(current: DataFrame, selected: DataFrame) -> DataFrame:
    return selected.join(current, selected.columns, "left_anti")


def to_remove(current: DataFrame, selected: DataFrame) -> DataFrame:
    return current.join(selected, selected.columns, "left_anti")


def added(items: DataFrame, ids: DataFrame, collection_id, added_at: str) -> DataFrame:
    """The new rows of adding captures (capture_id) to a collection; those it holds stay as they are."""
    new = ids.select("capture_id").distinct().select(F.lit(collection_id).cast(items.schema["collection_id"].dataType).alias("collection_id"), "capture_id")
    return new.join(items, ["collection_id", "capture_id"], "left_anti").withColumn("added_at", F.lit(added_at))


def removed(items: DataFrame, ids: DataFrame, collection_id) -> DataFrame:
    """The rows that removing captures from a collection takes away."""
    return items.where(F.col("collection_id") == collection_id).join(ids.select("capture_id"), "capture_id", "left_semi")


def without(table: DataFrame, ids: DataFrame, key: str = "capture_id") -> DataFrame:
    """A table without the rows of deleted captures."""
    return table.join(ids.select(F.col("capture_id").alias(key)), key, "left_anti")


def touched(captures: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Captures with updated_at moved on for the listed ones."""
    listed = ids.select(F.col("capture_id").alias("id"), F.lit(True).alias("listed")).distinct()
    return captures.join(listed, "id", "left").withColumn("updated_at", F.when(F.col("listed"), F.lit(at)).otherwise(F.col("updated_at"))).drop("listed").select(*captures.columns)


def set_for_capture(tables: dict[str, DataFrame], capture_id: str, selected: list[int], now: str) -> dict[str, DataFrame]:
    """One capture's collections replaced by those selected (existing ones, else an error): others go, new ones come with the time, and the capture is touched."""
    items, wanted = tables["items"], sorted(set(selected))
    if tables["captures"].where(F.col("id") == capture_id).isEmpty():
        raise CollectionError("Capture not found.")
    if tables["collections"].where(F.col("id").isin(wanted)).count() < len(wanted):
        raise CollectionError("Collection not found.")
    mine = F.col("capture_id") == capture_id
    stay = items.where(~mine | F.col("collection_id").isin(wanted))
    spark = items.sparkSession
    chosen = spark.createDataFrame([(c, capture_id, now) for c in wanted], items.schema)
    new = chosen.join(items.where(mine), ["collection_id", "capture_id"], "left_anti").select(*items.columns)
    ids = spark.createDataFrame([(capture_id,)], "capture_id string")
    return {"items": stay.unionByName(new), "captures": touched(tables["captures"], ids, now)}


def created(collections: DataFrame, name: str, at: str) -> DataFrame:
    name = (name or "").strip()
    if not name:
        raise CollectionError("Name required.")
    if not collections.where(F.col("name") == name).isEmpty():
        raise CollectionError("Collection already exists.")
    top = collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return collections.unionByName(top.select((F.col("top") + 1).alias("id"), F.lit(name).alias("name"), F.lit(at).alias("created_at")))


def renamed(collections: DataFrame, collection_id: int, name: str) -> DataFrame:
    name = (name or "").strip()
    if not name:
        raise CollectionError("Name required.")
    if collections.where(F.col("id") == collection_id).isEmpty():
        raise CollectionError("Collection not found.")
    if not collections.where((F.col("name") == name) & (F.col("id") != collection_id)).isEmpty():
        raise CollectionError("Collection name already exists.")
    return collections.withColumn("name", F.when(F.col("id") == collection_id, F.lit(name)).otherwise(F.col("name")))
