import json

import pytest

from folioforge.operators import ingest
from folioforge.sources.store import Store
from folioforge.streaming import ingest as streaming

HEAD = '<html><head><title>Tag</title><meta name="citation_title" content="Real title"><meta name="citation_doi" content="https://doi.org/10.1234/Ab.C"><meta name="prism.publicationdate" content="2020-05-01"><meta name="citation_keywords" content="alpha, beta;gamma"></head><body><article>'
BODY = "<h2>Introduction</h2>" + "".join(f"<p>Paragraph {i} says enough about the methods and the results of this work to count.</p>" for i in range(40))
PAYLOADS = [
    json.dumps({"source_url": " https://Ex.org/a?utm_source=x ", "dom_html": HEAD + BODY + "<h2>References</h2><ol><li>One</li></ol></article></body></html>", "extraction": {"meta": {"Citation_Author": ["Ann Lee", "Bo Roe"], "citation_title": "Client title"}, "content_html": "<p>plain</p>"}}),
    json.dumps({"source_url": "https://ex.org/b", "extraction": "nope", "dom_html": 7}),
    "[1, 2]", "{broken", json.dumps({"dom_html": "x"}),
]


def test_validation_and_fields(spark):
    raw = spark.createDataFrame([(p, "2024-01-01", i) for i, p in enumerate(PAYLOADS)], "value string, captured_at string, seq int")
    checked = ingest.validated(raw)
    assert [r.error_code for r in checked.orderBy("seq").collect()] == [None, None, "invalid_json", "invalid_json", "missing_field"]
    a, b = ingest.parsed(checked.where("error_code is null")).orderBy("seq").collect()
    assert (a.url_canon, a.title, a.doi, a.year, a.keywords, a.authors) == ("https://ex.org/a", "Client title", "10.1234/ab.c", 2020, ["alpha", "beta", "gamma"], ["Ann Lee", "Bo Roe"])
    assert a.used_for_index and a.content_text.startswith("Introduction\nParagraph 0") and a.references_text == "References\nOne" and a.capture_quality == "ok"
    assert (b.url_canon, b.title, b.content_text, b.used_for_index, b.article_text) == ("https://ex.org/b", "https://ex.org/b", "", False, None)


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, p in enumerate(PAYLOADS):
        (source / f"{i}.json").write_text(p + "\n")
    streaming.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "captures"))
    assert sorted(r.url_canon for r in got.collect()) == ["https://ex.org/a", "https://ex.org/b"]
    assert sorted(r.error_code for r in spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()) == ["invalid_json", "invalid_json", "missing_field"]
    assert sorted(r.arrivals for r in streaming.arrivals_per_window(got.select("captured_at", "site")).collect()) in ([2], [1, 1])


def test_the_store_changes_as_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current() == {}
    store.commit({"a": spark.range(3), "b": spark.range(1)})
    before = store.read("a")
    store.commit({"a": store.read("a").union(spark.range(2))})
    assert store.read("a").count() == 5 and store.read("b").count() == 1 and before.count() == 3
    with pytest.raises(Exception):
        store.commit({"a": spark.range(9), "b": spark.range(1).selectExpr("raise_error('no') AS x")})
    assert store.read("a").count() == 5
