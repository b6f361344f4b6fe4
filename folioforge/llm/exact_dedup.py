"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations only.

Rows come in memtables. Each is flushed as one run: a sorted table with one entry a digest (the identifier that stays and
the number of rows), its smallest and largest digest, and a filter, a bitmap of hashed digests. Before that its digests are
looked up in the older runs: the run's range and filter leave few of them, which meet the run's entries. What is met, or
occurs twice in the memtable, is a hit. FANOUT runs of a level are merged into one run of the next level, which keeps one
identifier a digest. The texts of hits are grouped byte by byte at the end, so texts that share a digest without being
equal are told apart.

Defined results: null texts count as empty and are equal to empty ones. Null identifiers lose against others; a group
of nothing but null identifiers keeps null. Rows that repeat the identifier which stays are all kept, as nothing tells
them apart. An empty table gives an empty result. Other columns are ignored, whatever their names. Rows of one text may be
any part of the table: they fold to one entry a task before they move, and texts of hits likewise. How many memtables the
rows come in makes no difference to the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import bitmap, bits_for, maybe_held, scratch_path, small_enough, stored, table, whole

#: Hit groups up to which the hits are broadcast (56 bytes each, so 28 MB); beyond it they are joined by a shuffle.
BROADCAST_HITS = 500_000
#: Memtables that a table is dealt to, and runs of a level that are merged into one of the next.
MEMTABLES, FANOUT = 4, 2
#: Bits of a filter, at most: 16 MB, 2 million rows when broadcast. Beyond 8 million digests it lets more through, never less.
FILTER_BITS = 1 << 27


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hashed(digests: DataFrame) -> DataFrame:
    return digests.withColumn("h", F.xxhash64("digest"))


@dataclass
class Run:
    """A flushed or merged run: digest, keep, n, sorted by digest within each file; its filter and range of digests."""

    entries: DataFrame
    words: DataFrame
    bits: int
    low: bytes
    high: bytes

    def holds(self, digests: DataFrame) -> DataFrame:
        """The digests that the run has: by range, then filter, then entries."""
        inside = hashed(digests.where(F.col("digest").between(F.lit(self.low), F.lit(self.high))))
        likely = maybe_held(inside, "h", self.words, self.bits).select("digest")
        return likely.join(self.entries.select("digest"), "digest", "left_semi")


class DigestIndex:
    """Levels of runs under one path of a shared file system."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "largest", fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.pick = {"largest": F.max, "smallest": F.min}[keep]
        self.levels: list[list[Run]] = [[]]
        self.written = 0

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _write(self, entries: DataFrame) -> Run | None:
        path = f"{self.path}/run-{self.written}"
        self.written += 1
        entries.sortWithinPartitions("digest").write.parquet(f"{path}/entries")
        run = self.spark.read.schema(entries.schema).parquet(f"{path}/entries")
        n, low, high = run.agg(F.count(F.lit(1)), F.min("digest"), F.max("digest")).first()
        if not n:
            return None
        bits = bits_for(n, FILTER_BITS)
        words = bitmap(hashed(run), "h", bits)
        words.write.parquet(f"{path}/filter")
        return Run(run, self.spark.read.schema(words.schema).parquet(f"{path}/filter"), bits, bytes(low), bytes(high))

    def flush(self, rows: DataFrame) -> DataFrame:
        """Add a memtable (id, digest) as a run. Returns its hits, by digest: those met in older runs or twice in the memtable."""
        older = self.runs()
        run = self._write(rows.groupBy("digest").agg(self.pick("id").alias("keep"), F.count(F.lit(1)).alias("n")))
        if run is None:
            return rows.select("digest").limit(0)
        met = [run.entries.where("n > 1").select("digest"), *(r.holds(run.entries.select("digest")) for r in older)]
        hits = stored(reduce(DataFrame.unionByName, met).distinct(), "digest-hits")
        self.levels[0].append(run)
        self._settle()
        return hits

    def _settle(self) -> None:
        """Merge the runs of each full level into one of the next."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._merged(self.levels[k]))
                self.levels[k] = []

    def _merged(self, runs: list[Run]) -> Run:
        entries = reduce(DataFrame.unionByName, [r.entries for r in runs])
        return self._write(entries.groupBy("digest").agg(self.pick("keep").alias("keep"), F.sum("n").alias("n")))

    def compact(self) -> DataFrame | None:
        """Merge all levels into one run: digest, keep, n; nothing if nothing was flushed."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [*([] for _ in self.levels), [self._merged(runs)]]
        return self.runs()[0].entries if runs else None


def _sized(df: DataFrame) -> DataFrame:
    """A broadcast hint only for a side whose size was counted."""
    return F.broadcast(df) if small_enough(df, BROADCAST_HITS) else df


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256, memtables: int = MEMTABLES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest. `digest` maps a text column to a digest column."""
    spark = docs.sparkSession
    text = whole(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), digest(text).alias("digest"), text.alias("text"))
    log_path = scratch_path(spark, "digest-log")
    log = rows.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int").alias("memtable"))
    log.write.partitionBy("memtable").parquet(log_path)
    entries = spark.read.schema(log.schema).parquet(log_path)
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), keep)
    found_hits = [index.flush(entries.where(F.col("memtable") == m).select("id", "digest")) for m in range(memtables)]
    hits = stored(reduce(DataFrame.unionByName, found_hits).distinct(), "digest-hits")
    # Byte verification: the hits' whole texts are grouping keys. A filter lets hits through where they lie, so copies fold before the shuffle.
    bits = bits_for(hits.count(), FILTER_BITS)
    likely = maybe_held(hashed(rows), "h", stored(bitmap(hashed(hits), "h", bits), "digest-filter"), bits)
    texts = likely.groupBy("digest", "text").agg(index.pick("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    per_digest = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), index.pick("keep").alias("keep"), F.sum("n").alias("n"))
    verified = stored(per_digest.join(_sized(hits), "digest", "left_semi"), "digest-verified")
    single = verified.where("texts = 1").select("digest", "keep", "n")
    mixed = verified.where("texts > 1").select("digest")
    entries = entries.select("id", "digest")
    if mixed.isEmpty():
        found = entries.join(_sized(single), "digest", "left")
    else:  # different texts under one digest: their rows are matched by text
        told = rows.join(_sized(mixed), "digest").join(texts.withColumnRenamed("text", "same"), "digest").where("text = same").select("digest", "id", "keep", "n")
        found = entries.join(_sized(mixed), "digest", "left_anti").join(_sized(single), "digest", "left").unionByName(told)
    return found.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        "digest",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
