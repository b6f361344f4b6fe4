"""A library fed by a stream: files of payloads are validated, parsed and put into a segmented library, each batch once.

An arrival's number is its batch and its place in the batch: files in order of time and path, lines in order. It is the
same whenever a batch is read again. The library's ledger tells which batches are in, so a batch that comes again after a
failure is left out or replaces what the failed one wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.functions import metadata
from folioforge.operators import changes, graph, ingest
from folioforge.operators.ordering import numbered
from folioforge.operators.segments import Library

SCHEMAS = {
    "captures": "id string, url string, url_canon string, url_hash string, title string, doi string, year int, container_title string, created_at string, updated_at string",
    "texts": "capture_id string, content_text string", "items": "collection_id long, capture_id string, added_at string", "postings": "capture_id string, field string, token string",
}
#: Arrivals that a batch can have.
PLACES = 1 << 32


def lines(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    """value, captured_at, file, block: the payloads of a folder as they come."""
    read = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    return read.select("value", F.col("_metadata.file_modification_time").alias("captured_at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def arrivals(batch: DataFrame, number: int) -> DataFrame:
    """A batch's lines with seq. Lines of a block are read in order by one task, so their order doesn't hang on how files are cut."""
    ordered = numbered(batch.withColumn("line", F.monotonically_increasing_id()), [F.col(c) for c in ("captured_at", "file", "block", "line")])
    return ordered.select("value", "captured_at", (F.lit(number * PLACES) + F.col("n")).alias("seq"))


def apply(library: Library, batch: DataFrame, number: int, quarantine: str | None = None, now: str | None = None) -> bool:
    """Put one batch of lines into a library, unless it is in."""
    if number <= library.applied():
        return False
    checked = graph.stored(ingest.validated(arrivals(batch, number)), "feed-checked")
    if quarantine:
        checked.where("error_code is not null").select("seq", "captured_at", "value", "error_code").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
    good = graph.stored(ingest.parsed(checked.where("error_code is null")), "feed-parsed")  # pages are parsed once
    now = now or library.spark.range(1).select(metadata.now_iso().alias("now")).first()["now"]
    return library.add(number, changes.feed(library.tables(), good, now))


def start(spark: SparkSession, source: str, library: Library, checkpoint: str, files_per_batch: int = 100, quarantine: str | None = None) -> StreamingQuery:
    """Feed what lies in a folder (one payload a line) into a library, batch by batch, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        apply(library, batch, number, quarantine)

    return lines(spark, source, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
