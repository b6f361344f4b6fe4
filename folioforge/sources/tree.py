"""Spark data source `capture_tree`: captures' artifacts as files, root/batch-<n>/<task>/<capture>/<name>, a write at a time.

    spark.dataSource.register(CaptureTree)
    tree.put(artifacts, root)                                    # capture_id, name, text
    spark.read.format("capture_tree").load(root)                 # batch, capture_id, name, length, content

A write's tasks put their files into a hidden folder, each attempt into one of its own. The commit drops the attempts that
did not count and gives the folder its number: one rename, after which all files of the write are there. A task that fails
removes its own files, and an abort the folder, so nothing is left of a write that fails; what a killed driver left goes with the
next commit. Only the attempts' names reach the driver, never the files'. There is one writer at a time. On stores without renames of folders
the commit is no single step.

The reader has a partition for each task's folder. Comparisons of batch, capture_id and name with constants choose folders and
files before any is opened, and content is read only if the schema asked for has it. Where several batches have a file, `latest` keeps the last.

Defined results: rows without text are left out; a null capture or name, a name that does not count and a file that comes twice
in a write raise. Captures may have any name: what no folder can be called is percent-encoded. An empty write commits an empty batch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from folioforge.sources.artifacts import NAMES

SCHEMA = "batch int, capture_id string, name string, length long, content binary"
#: Bytes of content that a task hands to Spark at once.
PORTION = 8 << 20


def folder(capture_id: str) -> str:
    """The folder of a capture. A first `_` or `.` would hide it from Spark's own sources."""
    name = quote(capture_id, safe="")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in ("_", ".") else name or "%00"


def capture_of(name: str) -> str:
    return "" if name == "%00" else unquote(name)


def _below(store: fs.FileSystem, base: str, kind: fs.FileType = fs.FileType.Directory) -> list[fs.FileInfo]:
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((f for f in found if f.type == kind), key=lambda f: f.base_name)


def _batches(store: fs.FileSystem, base: str) -> dict[int, str]:
    return {int(m[1]): f.path for f in _below(store, base) if (m := re.fullmatch(r"batch-(\d+)", f.base_name))}


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task's attempt."""

    name: str


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, columns: list[str], overwrite: bool):
        self.root, self.columns, self.overwrite = root, columns, overwrite
        self.hidden = f"_write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, base = fs.FileSystem.from_uri(self.root)
        attempt = f"part-{uuid.uuid4().hex}"
        own = f"{base}/{self.hidden}/{attempt}"
        store.create_dir(own, recursive=True)
        try:
            for batch in iterator:
                for capture, name, text in zip(*(batch.column(self.columns.index(c)).to_pylist() for c in ("capture_id", "name", "text")), strict=True):
                    if capture is None or name not in NAMES:
                        raise ValueError(f"No artifact's name: {capture!r}, {name!r}")
                    if text is not None:
                        self._put(store, f"{own}/{folder(capture)}", name, text)
        except BaseException:
            store.delete_dir(own)
            raise
        return Attempt(attempt)

    @staticmethod
    def _put(store: fs.FileSystem, where: str, name: str, text: str) -> None:
        store.create_dir(where, recursive=True)
        if store.get_file_info(f"{where}/{name}").type != fs.FileType.NotFound:
            raise ValueError(f"A file comes twice: {where.rsplit('/', 1)[1]}/{name}")
        with store.open_output_stream(f"{where}/{name}") as out:
            out.write(text.encode("utf-8", "replace"))

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        hidden, count = f"{base}/{self.hidden}", {m.name for m in messages if m}
        store.create_dir(hidden, recursive=True)
        for f in _below(store, hidden):
            if f.base_name not in count:
                store.delete_dir(f.path)
        before = _batches(store, base)
        store.move(hidden, f"{base}/batch-{max(before, default=0) + 1:09d}")
        gone = [f.path for f in _below(store, base) if f.base_name.startswith("_write-")] + (list(before.values()) if self.overwrite else [])
        for path in gone:
            store.delete_dir(path)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        if store.get_file_info(f"{base}/{self.hidden}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.hidden}")


@dataclass
class Folder(InputPartition):
    batch: int
    path: str


class TreeReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType):
        self.root, self.schema = root, schema
        self.only: dict[str, set] = {}

    def pushFilters(self, filters):
        """Takes over what says which batches, captures and names; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("batch",), ("capture_id",), ("name",)):
                column, values = f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only[column] & values if column in self.only else values
            else:
                yield f

    def _asked(self, column: str, value) -> bool:
        return column not in self.only or value in self.only[column]

    def partitions(self) -> list[Folder]:
        store, base = fs.FileSystem.from_uri(self.root)
        return [Folder(n, f.path) for n, path in sorted(_batches(store, base).items()) if self._asked("batch", n) for f in _below(store, path)]

    def _captures(self, store: fs.FileSystem, path: str) -> Iterator[str]:
        if "capture_id" in self.only:
            asked = [f"{path}/{folder(c)}" for c in sorted(c for c in self.only["capture_id"] if c is not None)]
            return (f.path for f in store.get_file_info(asked) if f.type == fs.FileType.Directory) if asked else iter(())
        return (f.path for f in _below(store, path))

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is there
            return
        store, _ = fs.FileSystem.from_uri(self.root)
        names, kinds = self.schema.fieldNames(), {"batch": pa.int32(), "capture_id": pa.string(), "name": pa.string(), "length": pa.int64(), "content": pa.binary()}
        rows, size = {c: [] for c in names}, 0

        def portion() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in rows.items()})

        for capture in self._captures(store, partition.path):
            for f in _below(store, capture, fs.FileType.File):
                if not self._asked("name", f.base_name):
                    continue
                row = {"batch": partition.batch, "capture_id": capture_of(capture.rsplit("/", 1)[1]), "name": f.base_name, "length": f.size}
                if "content" in names:
                    with store.open_input_stream(f.path) as source:
                        row["content"] = source.read()
                    size += f.size
                for c in names:
                    rows[c].append(row[c])
                size += 100
                if size >= PORTION:
                    yield portion()
                    rows, size = {c: [] for c in names}, 0
        if size:
            yield portion()


class CaptureTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known, and let it take filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureTree)


def put(artifacts: DataFrame, root: str, overwrite: bool = False) -> None:
    """Write capture_id, name, text as one batch. Keys are counted first, so that no text is shuffled; rows that are costly to make are made twice, so store them."""
    register(artifacts.sparkSession)
    rows = artifacts.select("capture_id", "name", "text")
    if not rows.where("text is not null").groupBy("capture_id", "name").count().where("count > 1").isEmpty():
        raise ValueError("A file comes twice.")
    rows.write.format("capture_tree").mode("overwrite" if overwrite else "append").save(root)


def files(spark: SparkSession, root: str, columns: tuple[str, ...] = ("batch", "capture_id", "name", "length", "content")) -> DataFrame:
    """The files of a tree; without `content` among the columns none is opened."""
    register(spark)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    return spark.read.format("capture_tree").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(root)


def latest(found: DataFrame) -> DataFrame:
    """Of each file, the one of the last batch."""
    last = F.max("batch").over(Window.partitionBy("capture_id", "name"))
    return found.withColumn("last", last).where("batch = last").drop("last")
