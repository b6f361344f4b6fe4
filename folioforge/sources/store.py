"""A set of tables that changes as one: each change writes new versions, then moves one pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables under one root of any file system that Spark reaches. Readers see a whole version; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict[str, str]:
        """Where each table's data are."""
        fs = self._files()
        if not fs.exists(self._path("CURRENT")):
            return {}
        stream = fs.open(self._path("CURRENT"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()[name]}")

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Replace some tables at once; the others stay. A failure before the last step changes nothing."""
        version = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        pointer = json.dumps(self.current() | {name: f"{version}/{name}" for name in tables}, sort_keys=True)
        jvm, new = self.spark._jvm, self._path(f"CURRENT-{version}")
        stream = self._files().create(new)
        stream.write(bytearray(pointer.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else jvm.java.net.URI.create("file:///"), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path("CURRENT"), options)
