from pyspark.sql import functions as F

from folioforge.sources import artifacts, exports


def test_tree(spark, tmp_path):
    rows = spark.createDataFrame([("a", "paper.md", "# é\n"), ("a", "article.txt", "x" * 50 + " \n" + "y" * 50), ("b", "raw.json", "{}"), ("b", "other.bin", "no"), ("b", "page.html", None), ("../c", "paper.md", "no")], "capture_id string, name string, text string")
    root = (tmp_path / "tree").as_uri()
    assert artifacts.write(spark, rows, root) == 3
    assert {r.capture_id: r.names for r in artifacts.present(spark, root).collect()} == {"a": ["article.txt", "paper.md"], "b": ["raw.json"]}
    shown = {(r.capture_id, r.name): (r.text, r.truncated, r.chars) for r in artifacts.preview(artifacts.files(spark, root), 52).collect()}
    assert shown["a", "article.txt"] == ("x" * 50 + artifacts.TRUNCATED, True, 64) and shown["a", "paper.md"] == ("# é\n", False, 4)


def test_master_markdown_and_names(spark):
    c = spark.createDataFrame([("b", "2", "# B\n"), ("a", "1", "# A"), ("n", "3", " ")], "id string, updated_at string, paper_md string")
    parts = exports.master_markdown(c, "All", ["updated_at", "id"]).orderBy("pos").collect()
    assert "".join(p.value for p in parts) == "# All\n\n_Items: 3_\n\n# A\n\n\n---\n\n# B\n"
    assert exports.file_name("bib", capture_id="ABC def ghi jkl") == "library_abc-def-ghi-.bib" and exports.file_name("md", collection="My X", suffix="master") == "library_my-x_master.md" and exports.file_name("ris", collection=4, selected=True) == "library_col4_selected.ris"
    items = spark.createDataFrame([(4, "a")], "collection_id int, capture_id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(exports.scope(c, items, capture_id="b")) == ["b"] and ids(exports.scope(c, items, collection=4)) == ["a"] and len(ids(exports.scope(c, items))) == 3


def test_best_markdown(spark):
    df = spark.createDataFrame([("T", "10.1/x", "J", 2020, "http://u", " ", " body ", "ref"), ("T", "", "", None, "", "stored \n\n", "", "")], "title string, doi string, container_title string, year int, url string, md string, article string, refs string")
    got = [r[0] for r in df.select(exports.best_markdown(F.col("md"), F.col("article"), F.col("refs"))).collect()]
    assert got == ["# T\n\n**DOI: `10.1/x` · J · 2020 · http://u**\n\nbody\n\n## References\nref\n", "stored\n"]
