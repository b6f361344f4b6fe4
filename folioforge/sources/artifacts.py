"""The file tree of captures, root/<capture id>/<name>: what is there, bounded previews, and writing it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The names that count, and the bytes of a preview.
NAMES = ("page.html", "content.html", "article.html", "article.txt", "references.html", "references.txt", "references.json", "article.json", "raw.json", "reduced.json", "sections.json", "paper.md")
PREVIEW_BYTES = 200_000
TRUNCATED = "\n… (truncated)"


def files(spark: SparkSession, root: str) -> DataFrame:
    """capture_id, name, length, content: the known files below root; content is read only where it is used."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return read.select(part(-2).alias("capture_id"), part(-1).alias("name"), "length", "content").where(F.col("name").isin(*NAMES))


def present(spark: SparkSession, root: str) -> DataFrame:
    """capture_id, names: the sorted names of each capture's files."""
    return files(spark, root).groupBy("capture_id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", errors="replace"))


def preview(found: DataFrame, most: int = PREVIEW_BYTES) -> DataFrame:
    """capture_id, name, text, truncated, chars of files(): the first bytes as text, invalid ones replaced."""
    cut = F.substring("content", 1, most)
    decoded = F.pandas_udf(_decoded, StringType())(cut)
    shown = found.select("capture_id", "name", (F.col("length") > most).alias("truncated"), decoded.alias("raw"))
    whole: Column = F.when(F.col("truncated"), F.concat(F.regexp_replace("raw", r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit(TRUNCATED))).otherwise(F.col("raw"))
    return shown.select("capture_id", "name", whole.alias("text"), "truncated", F.length(whole).alias("chars"))


def write(spark: SparkSession, artifacts: DataFrame, root: str) -> int:
    """Write capture_id, name, text as files, each whole or not at all; rows of other names or without text are left out. Returns how many.

    Tasks write through pyarrow's file systems, so root may be on any store that those reach; a task that is run again
    writes the same files.
    """
    from pyarrow import fs

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for frame in frames:
            for row in frame.itertuples():
                folder = f"{base}/{row.capture_id}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/.{row.name}.tmp") as out:
                    out.write(row.text.encode())
                store.move(f"{folder}/.{row.name}.tmp", f"{folder}/{row.name}")
            yield pd.DataFrame({"n": [len(frame)]})

    rows = artifacts.where(F.col("name").isin(*NAMES) & F.col("text").isNotNull() & ~F.col("capture_id").contains("/")).select("capture_id", "name", "text")
    return rows.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
