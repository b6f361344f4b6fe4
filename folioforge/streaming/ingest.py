"""Captures as a stream: files of JSON payloads become parsed captures and a quarantine, exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators import ingest
from folioforge.streaming import feed


def start(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Read what lies in `source` (one payload a line), write target/captures and target/quarantine by batch, and stop.

    A batch that is run again after a failure replaces its own files, and its captures have the numbers they had: they can be
    fed to a library (changes.feed), also when payloads repeat.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = ingest.validated(feed.arrivals(batch, number)).persist()
        bad = checked.where("error_code is not null").select("seq", "captured_at", "value", "error_code")
        bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch={number}")
        ingest.parsed(checked.where("error_code is null")).write.mode("overwrite").parquet(f"{target}/captures/batch={number}")
        checked.unpersist()

    return feed.lines(spark, source, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_window(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window, site, arrivals: how many captures each site sent, counting rows that are late by up to `late`. stream: captured_at, site."""
    return stream.withWatermark("captured_at", late).groupBy(F.window("captured_at", width), "site").agg(F.count(F.lit(1)).alias("arrivals"))
