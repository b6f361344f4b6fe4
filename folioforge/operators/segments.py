"""A library kept as segments: each change adds one, at the cost of what it changes, and small segments are merged now and then.

A segment of a table has the rows that came and the captures whose rows in earlier segments are dead. Reading leaves dead
rows out. After a change, a table's last segments are merged as long as the one before them is less than twice their size:
so there are about as many segments as the logarithm of the library's size, and a row is rewritten about as often.

The ledger tells which segments count: one entry a change, written last, with the number of the batch that it applied. What
is written before it counts for nothing until then and is replaced when the batch comes again; a batch that the ledger has
is not applied again. So changes are put in once, whenever a run is cut off. There is one writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import graph
from folioforge.operators.changes import KEY_OF, Delta

LEDGER = "entry long, batch long, name string, low long, high long, size long"
#: Tables whose rows lie in a segment's files by range; others lie as they come, sorted by capture within files.
ORDER = {"postings": ("token", "capture_id")}
#: Segments are merged with those after them that have more than one in TIER of their size.
TIER = 2


class Library:
    """Tables of a library under one root of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def ledger(self) -> list:
        """The latest entry: a row a segment that counts; as many as tables times the logarithm of their size."""
        try:
            found = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        latest = found.agg(F.max("entry")).first()[0]
        return sorted(found.where(F.col("entry") == latest).collect(), key=lambda r: (r["name"] or "", r["low"] or 0)) if latest is not None else []

    def applied(self) -> int:
        """The number of the last batch that is in; -1 if none is."""
        return max((r["batch"] for r in self.ledger()), default=-1)

    def _path(self, name: str, kind: str, low: int, high: int) -> str:
        return f"{self.root}/{name}/{kind}/{low}-{high}"

    def _rows(self, name: str, segments: list) -> DataFrame:
        """The rows of some consecutive segments that are alive after the last of them."""
        empty = self.spark.createDataFrame([], self.schemas[name])
        if not segments:
            return empty
        each = lambda kind, schema: [self.spark.read.schema(schema).parquet(self._path(name, kind, r["low"], r["high"])).withColumn("_high", F.lit(r["high"])) for r in segments]
        rows, key = reduce(DataFrame.unionByName, each("rows", empty.schema)), KEY_OF[name]
        dead = reduce(DataFrame.unionByName, each("gone", "capture_id string")).groupBy("capture_id").agg(F.max("_high").alias("_dead"))
        alive = rows.join(dead, rows[key] == dead["capture_id"], "left") if key != "capture_id" else rows.join(dead, key, "left")
        return alive.where(F.col("_dead").isNull() | (F.col("_high") >= F.col("_dead"))).select(*empty.columns)

    def read(self, name: str) -> DataFrame:
        return self._rows(name, [r for r in self.ledger() if r["name"] == name])

    def tables(self) -> dict[str, DataFrame]:
        entry = self.ledger()
        return {name: self._rows(name, [r for r in entry if r["name"] == name]) for name in self.schemas}

    def _write(self, name: str, rows: DataFrame, gone: DataFrame, low: int, high: int) -> int:
        order = ORDER.get(name, (KEY_OF[name],))
        dealt = rows.repartitionByRange(*order) if name in ORDER else rows
        dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(self._path(name, "rows", low, high))
        gone.write.mode("overwrite").parquet(self._path(name, "gone", low, high))
        count = lambda kind: self.spark.read.parquet(self._path(name, kind, low, high)).count()
        return count("rows") + count("gone")

    def add(self, batch: int, delta: Delta) -> bool:
        """Put a change in, unless the ledger has its batch."""
        entry = self.ledger()
        if batch <= max((r["batch"] for r in entry), default=-1):
            return False
        number = 1 + max((r["high"] for r in entry), default=-1)
        told = []
        for name in self.schemas:
            segments = [r.asDict() for r in entry if r["name"] == name]
            if name in delta.comes or name in delta.goes:
                rows = delta.comes[name].select(*self.spark.createDataFrame([], self.schemas[name]).columns) if name in delta.comes else self.spark.createDataFrame([], self.schemas[name])
                gone = delta.goes[name].select("capture_id").distinct() if name in delta.goes else self.spark.createDataFrame([], "capture_id string")
                size = self._write(name, rows, gone, number, number)
                segments.append({"name": name, "low": number, "high": number, "size": size})
            told += self._merged(name, segments)
        rows = [(number, batch, r["name"], r["low"], r["high"], r["size"]) for r in told]
        self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")
        return True

    def vacuum(self) -> int:
        """Delete the files of segments that were merged into others; readers of earlier entries lose them. Returns how many segments went."""
        counts = {(r["name"], r["low"], r["high"]) for r in self.ledger()}
        if not counts:
            return 0
        ever = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger").select("name", "low", "high").distinct().collect()  # a row a segment that ever was
        old = [tuple(r) for r in ever if tuple(r) not in counts]
        for name, low, high in old:
            for kind in ("rows", "gone"):
                graph.removed(self.spark, self._path(name, kind, low, high))
        return len(old)

    def _merged(self, name: str, segments: list[dict]) -> list[dict]:
        tail, size = len(segments), 0
        while tail and (tail == len(segments) or segments[tail - 1]["size"] < TIER * size):
            tail -= 1
            size += segments[tail]["size"]
        if len(segments) - tail < 2:
            return segments
        old = segments[tail:]
        low, high = old[0]["low"], old[-1]["high"]
        gone = [self.spark.read.schema("capture_id string").parquet(self._path(name, "gone", r["low"], r["high"])) for r in old]
        gone = reduce(DataFrame.unionByName, gone).distinct() if tail else gone[0].limit(0)  # nothing lies before the first segment
        return [*segments[:tail], {"name": name, "low": low, "high": high, "size": self._write(name, self._rows(name, old), gone, low, high)}]
