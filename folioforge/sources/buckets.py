"""Tables kept in buckets by DOI, so that captures meet a registry of any size without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioforge.functions.metadata import one_a_doi


def save(df: DataFrame, table: str, buckets: int, key: str = "doi") -> DataFrame:
    """df as a table of the warehouse, dealt to buckets by a key and sorted by it; a bucket is one file. Captures without DOI fall into one bucket, so keep them apart if they are many."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def save_registry(registry: DataFrame, table: str, buckets: int) -> DataFrame:
    """A registry reduced to one row a DOI when it is saved. metadata.filled() joins it with captures in as many buckets in place."""
    return save(one_a_doi(registry), table, buckets)
