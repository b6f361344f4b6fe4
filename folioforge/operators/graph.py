"""Connected components by alternating large-star and small-star steps on stored tables, until nothing changes; few links are joined by one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all of Spark runs in one process may the session name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="folioforge-"))
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        removed(df.sparkSession, file.rsplit("/", 1)[0])


#: Links up to which one task joins them: a round of the steps below takes longer.
FEW_EDGES = 50_000


def _of_few(edges: DataFrame) -> DataFrame:
    """The components of at most FEW_EDGES links (u, v)."""

    def order(x):
        return (x is not None, tuple(map(order, x.values())) if isinstance(x, dict) else x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, value = {}, {}

        def top(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for batch in batches:
            kind = batch.column(0).type
            for ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = (top(root.setdefault(k, k)) for k in map(order, ends))
                value |= zip(map(order, ends), ends, strict=True)
                root[max(a, b)] = min(a, b)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(value.values()), kind), pa.array([value[top(k)] for k in value], kind)], ["node", "root"])

    node = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {node}, root {node}")


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (a, b) with the smallest node that it reaches. There is no bound on the rounds."""
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    before = state(edges)
    if before[0] <= FEW_EDGES:
        return _of_few(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, old = stored(small, "components"), edges
        dropped(old)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
