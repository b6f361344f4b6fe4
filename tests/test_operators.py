import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.operators import collections, fulltext, identity, library, sections
from folioforge.sources import exports, html
from tests.folds import fold


def test_identity_by_components_equals_one_fold(spark):
    rng = random.Random(9)
    for trial in range(3):
        log = pd.DataFrame([(rng.choice("abcdefgh") * 20, rng.choice(["", "", "10.1/x", "10.1/y", "10.1/z"]), f"2024-01-{rng.randint(1, 9):02d}", i) for i in range(40)], columns=["url_hash", "doi", "captured_at", "seq"])
        whole = fold(log)
        got = identity.resolve(spark.createDataFrame(log)).toPandas()
        order = lambda x: x.sort_values("capture_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(order(got), order(whole), check_dtype=False)


def test_a_doi_joins_what_urls_had_apart(spark):
    log = [("u1", "", "1", 1), ("u2", "10.1/x", "2", 2), ("u1", "10.1/x", "3", 3)]
    rows = identity.resolve(spark.createDataFrame(log, "url_hash string, doi string, captured_at string, seq long")).collect()
    assert [(r.doi, r.url_hash, r.merged) for r in rows] == [("10.1/x", "u1", 1)]


def test_sections(spark):
    t = "Lead text here.\nKeywords: a, b\nIntroduction\nFirst line of it.\net\nal.\n\n1. Methods\nWe did it all.\nFunding\n"
    rows = sections.split_sections(spark.createDataFrame([(1, t), (2, None)], "id int, text string")).orderBy("section_id").collect()
    assert [(r.section_id, r.title, r.kind, r.number, r.text) for r in rows] == [
        ("s01", "Body", "other", None, "Lead text here."), ("s02", "Keywords", "keywords", None, "Keywords: a, b"), ("s03", "Introduction", "introduction", None, "First line of it. et al."), ("s04", "Methods", "methods", "1", "We did it all."),
    ]


def test_library(spark):
    captures = spark.createDataFrame([("a", "Über Café", "http://x/1", "", "1"), ("b", "plain", "http://x/2", "10.1/q", "2"), ("c", "plain too", "http://y", "", "2")], "id string, title string, url string, doi string, updated_at string")
    texts = spark.createDataFrame([("a", "nothing"), ("b", "Straße naïve")], "capture_id string, content_text string")
    items = spark.createDataFrame([(1, "a"), (1, "c")], "collection_id int, capture_id string")
    postings = fulltext.postings(captures, texts)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(library.search(captures, "naive", postings=postings)) == ["b"]
    assert ids(library.search(captures, "caf uber", postings=postings)) == ["a"]
    assert ids(library.search(captures, "ein NOTH", texts=texts)) == []
    assert ids(library.search(captures, "NOTH", texts=texts)) == ["a"]
    assert ids(library.search(captures, "10.1/Q")) == ["b"]
    assert ids(library.search(captures, "", items=items, collection=1)) == ["a", "c"]
    assert [r.id for r in library.page(captures, 1, 2).collect()] == ["b", "c"] and [r.id for r in library.page(captures, 2, 2).collect()] == ["a"]
    assert (library.page_size(None), library.page_size(-1), library.page_size(9999)) == (50, 50, 500)
    bare = postings.where("capture_id != 'a'").select("capture_id").distinct()
    v = fulltext.verify(captures, bare).first()
    assert (v.captures, v.indexed, v.missing, v.extra, v.ok) == (3, 2, 1, 0, False)
    fixed = fulltext.repair(captures, texts, postings.where("capture_id != 'a'")).select("capture_id").distinct()
    assert fulltext.verify(captures, fixed).first().ok


def test_collections(spark):
    c = spark.createDataFrame([(1, "b", ""), (2, "A", "")], "id long, name string, created_at string")
    items = spark.createDataFrame([(1, "x", "old"), (2, "x", "old")], "collection_id long, capture_id string, added_at string")
    assert [(r.name, r["count"]) for r in collections.with_counts(c, items).collect()] == [("A", 1), ("b", 1)]
    ids = spark.createDataFrame([("x",), ("y",), ("y",)], "capture_id string")
    assert [(r.capture_id, r.added_at) for r in collections.added(items, ids, 1, "now").collect()] == [("y", "now")]
    assert collections.removed(items, ids, 1).count() == 1 and collections.without(items, ids).count() == 0
    assert collections.created(c, " new ", "t").where("name = 'new'").first().id == 3
    for call, says in ((lambda: collections.created(c, " ", ""), "Name required."), (lambda: collections.created(c, "A", ""), "Collection already exists."), (lambda: collections.renamed(c, 9, "z"), "Collection not found."), (lambda: collections.renamed(c, 1, "A"), "Collection name already exists.")):
        with pytest.raises(collections.CollectionError, match=says):
            call()


PAGE = """<html><head><title> A &amp; B </title><meta name=citation_author content="Ann Lee"><meta name="Citation_Author" content="Bo Roe"><meta property="og:x" content=""></head>
<body><nav>menu</nav><div id="content"><h1>Head</h1><p>First <b>bold</b> para.<p>Inner.</p><ul><li><p>item</p></li><li>bare</li></ul><div class="cookie-bar">accept all</div></div>
<h2>References</h2><ol><li>Ref one</li></ol><script>var x = "no";</script></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<article><h2>Introduction</h2><p>Text.</p><h2>References</h2><ol><li>One</li></ol></article>")], "id int, html string")
    rows = {r.id: r for r in html.parse_pages(df, "id", "html").collect()}
    assert rows[1].title_tag == "A & B" and rows[1].meta == {"citation_author": ["Ann Lee", "Bo Roe"]}
    assert rows[1].selected_hint == "id:content" and rows[1].article_text.split("\n")[:3] == ["Head", "First bold para. Inner. item bare", "Inner."]
    assert rows[4].selected_hint == "tag:article" and rows[4].article_text == "Introduction\nText." and rows[4].references_text == "References\nOne"
    assert not rows[2].ok and not rows[3].ok and rows[2].capture_quality == "suspicious" and rows[2].confidence == 0
    texts = [r[0] for r in df.select(html.page_text(F.col("html"))).collect()]
    assert "var x" not in texts[0] and texts[0].startswith("A & B menu Head First bold para.") and texts[1] == ""


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("abcdefghij", "http://u", 'A {b} "c" \\', "10.1/x", 2020, "J", ["A B", "C"], ["k"], " x\n y ")], "id string, url string, title string, doi string, year int, container_title string, authors array<string>, keywords array<string>, abstract string")
    bib, ris = df.select(exports.bibtex_entry(), exports.ris_entry()).first()
    assert bib == '@article{pc2020_abcdefgh,\n  title = {A \\{b\\} \\"c\\" \\\\},\n  author = {A B and C},\n  journal = {J},\n  year = {2020},\n  doi = {10.1/x},\n  url = {http://u},\n  abstract = {x y},\n  keywords = {k}\n}'
    assert ris == 'TY  - JOUR\nTI  - A {b} "c" \\\nAU  - A B\nAU  - C\nJO  - J\nPY  - 2020\nDO  - 10.1/x\nUR  - http://u\nAB  - x y\nKW  - k\nER  -'
    assert exports.slug(" Über X! ") == "ber-x" and exports.slug("") == "export"
    exports.write_lines(df.withColumn("e", exports.ris_entry()), "e", ["id"], str(tmp_path / "ris"), "\n\n")
    assert sum("TY  - JOUR" in p.read_text() for p in (tmp_path / "ris").glob("part*")) == 1


def test_collections_come_by_name_in_ascii_case_only(spark):
    """`_` sorts before letters, `A` and `a` are one and go by id, letters beyond ASCII keep their case and come last."""
    c = spark.createDataFrame([(1, "ä"), (2, "b"), (3, "a"), (4, "Ä"), (5, "A"), (6, "_"), (7, "B"), (8, "")], "id long, name string")
    items = spark.createDataFrame([(3, "x"), (3, "y"), (9, "x")], "collection_id long, capture_id string")
    want = [8, 6, 3, 5, 2, 7, 4, 1]
    counted, told = collections.with_counts(c, items).collect(), collections.membership(c, items, "x").collect()
    assert [r.id for r in counted] == [r.id for r in told] == want
    assert {r.id: r["count"] for r in counted if r["count"]} == {3: 2} and [r.id for r in told if r.selected] == [3]
