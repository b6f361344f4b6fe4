import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioforge.sources import artifacts, tree

ROWS = "capture_id string, name string, text string"


def everything(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names)


def test_batches_and_the_latest_of_each_file(spark, tmp_path):
    root = str(tmp_path / "tree")
    odd = ["", ".", "..", "_a", "x/y", "%41", "%00", "é 漢", "a"]
    tree.put(spark.createDataFrame([(c, n, f"1 {c} {n}") for c in odd for n in ("paper.md", "raw.json")] + [("b", "page.html", None)], ROWS), root)
    tree.put(spark.createDataFrame([("a", "paper.md", "é" * 70), ("n", "raw.json", "")], ROWS), root)
    found = tree.latest(tree.files(spark, root)).collect()
    got = {(r.capture_id, r.name): (r.batch, bytes(r.content).decode(), r.length) for r in found}
    want = {(c, n): (1, t := f"1 {c} {n}", len(t.encode())) for c in odd for n in ("paper.md", "raw.json")}
    assert got == want | {("a", "paper.md"): (2, "é" * 70, 140), ("n", "raw.json"): (2, "", 0)} and len(found) == len(got)
    assert artifacts.files(spark, root).where("name = 'paper.md'").count() == len(odd) + 1  # Spark's own source sees the files of both batches
    tree.put(spark.createDataFrame([("z", "paper.md", "z")], ROWS), root, overwrite=True)
    assert [(r.batch, r.capture_id) for r in tree.files(spark, root).collect()] == [(3, "z")] and len(os.listdir(root)) == 1
    tree.put(spark.createDataFrame([], ROWS), root)
    assert tree.files(spark, root).count() == 1


def test_filters_choose_files_before_they_are_opened(spark, tmp_path):
    root = str(tmp_path / "tree")
    tree.put(spark.createDataFrame([(str(i), n, f"{i}") for i in range(30) for n in ("paper.md", "page.html")], ROWS), root)
    for path in everything(root):
        if path.endswith("page.html"):
            os.unlink(path)
            os.symlink("/proc/self/mem", path)  # whoever reads it fails
    found = tree.files(spark, root)
    with pytest.raises(PySparkException):
        found.where("length(name) > 8").collect()
    assert found.where("name = 'paper.md'").count() == 30
    one = found.where(F.col("name").isin("paper.md", "raw.json") & (F.col("capture_id") == "7") & (F.length("content") == 1))
    assert [bytes(r.content) for r in one.collect()] == [b"7"]
    assert found.where("capture_id = 'no' or capture_id = 'none'").count() == 0 and found.where("batch = 2").count() == 0
    assert found.where("capture_id = '1' and capture_id = '2' and name = 'paper.md'").count() == 0
    with_all = tree.files(spark, root, ("capture_id", "name"))
    assert with_all.columns == ["capture_id", "name"] and with_all.where("name = 'paper.md'").distinct().count() == 30


@pytest.mark.parametrize("bad", [("5", "paper.md", "again"), (None, "paper.md", "x"), ("q", "other.bin", "x"), ("q", None, "x")])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, bad):
    root = str(tmp_path / "tree")
    rows = [(str(i), "paper.md", "text") for i in range(40)]
    with pytest.raises((PySparkException, ValueError)):
        tree.put(spark.createDataFrame([*rows, bad], ROWS), root)
    assert everything(root) == [] and not (os.path.exists(root) and os.listdir(root))
    tree.put(spark.createDataFrame(rows, ROWS), root)
    before = everything(root)
    with pytest.raises((PySparkException, ValueError)):
        tree.put(spark.createDataFrame([*rows, bad], ROWS), root, overwrite=True)
    assert everything(root) == before and tree.files(spark, root).count() == 40


def test_attempts_that_do_not_count_and_killed_drivers(tmp_path):
    """A second attempt of a task and what a driver that was killed left go with the commit."""
    import pyarrow as pa

    root = str(tmp_path)
    batch = pa.RecordBatch.from_pydict({"capture_id": ["a"], "name": ["paper.md"], "text": ["t"]})
    killed, writer = (tree.TreeWriter(root, ["capture_id", "name", "text"], False) for _ in range(2))
    killed.write(iter([batch]))
    lost, counts = writer.write(iter([batch])), writer.write(iter([batch]))
    assert len(everything(root)) == 3 and not [p for p in os.listdir(root) if not p.startswith("_")]
    writer.commit([counts, None])
    assert everything(root) == [f"{root}/batch-000000001/{counts.name}/a/paper.md"] and lost.name != counts.name
    writer = tree.TreeWriter(root, ["capture_id", "name", "text"], False)
    writer.write(iter([batch]))
    writer.abort([None])
    assert len(everything(root)) == 1
    with pytest.raises(ValueError):
        writer.write(iter([batch, batch]))  # whoever writes without put() is told within a task
    assert len(everything(root)) == 1
