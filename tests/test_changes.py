import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions import metadata
from folioforge.operators import changes, collections, fulltext, identity, library
from folioforge.sources import bundles
from tests.folds import fold

CAPTURES = "id string, url_hash string, doi string, title string, created_at string, updated_at string"


def empty_library(spark):
    schemas = {"captures": CAPTURES, "texts": "capture_id string, content_text string", "items": "collection_id long, capture_id string, added_at string", "postings": "capture_id string, field string, token string"}
    return {name: spark.createDataFrame([], s) for name, s in schemas.items()}


def kept(spark, tables, path):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}


def test_a_feed_in_batches_gives_what_one_fold_gives(spark, tmp_path):
    rng = random.Random(3)
    log = pd.DataFrame([(rng.choice("abcdef") * 20, rng.choice(["", "", "10.1/x", "10.1/y"]), f"2024-01-{i // 4 + 1:02d}", i) for i in range(36)], columns=["url_hash", "doi", "captured_at", "seq"])
    log["title"] = [f"title {i}" for i in log["seq"]]
    log["content_text"] = [f"text{i} shared" for i in log["seq"]]
    tables = empty_library(spark)
    for k in range(3):
        tables = kept(spark, changes.fed(tables, spark.createDataFrame(log.iloc[12 * k : 12 * k + 12]), f"now{k}"), tmp_path / str(k))
    whole = fold(log).set_index("capture_id")
    rows = {r.id: r for r in tables["captures"].collect()}
    assert set(rows) == set(whole.index)
    texts = {r.capture_id: r.content_text for r in tables["texts"].collect()}
    tokens = {(r.capture_id, r.token) for r in tables["postings"].where("field = 'content_text'").collect()}
    for i, w in whole.iterrows():
        r = rows[i]
        assert (r.doi, r.url_hash, r.title, texts[i]) == (w.doi, w.url_hash, f"title {w.last_seq}", f"text{w.last_seq} shared")
        assert r.created_at == log.loc[w.first_seq, "captured_at"] and (i, f"text{w.last_seq}") in tokens
    assert len(texts) == len(rows) and len(tokens) == 2 * len(rows)


def random_log(rng, n, first=0):
    """Arrivals with negative and unordered numbers; some come twice."""
    rows = [(rng.choice("abcdefgh") * 20, rng.choice(["", "", "10.1/x", "10.1/y", "10.1/z"]), f"2024-01-{(first + i) // 4 + 1:02d}", (-1) ** i * (first + i) * 7919) for i in range(n)]
    log = pd.DataFrame(rows, columns=["url_hash", "doi", "captured_at", "seq"])
    log["title"] = [f"title {i}" for i in log["seq"]]
    log["content_text"] = [f"text{abs(i)} shared" for i in log["seq"]]
    return log


def library_of(tables):
    return {name: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str) for name, df in tables.items()}


def test_only_what_arrivals_reach_is_folded(spark, tmp_path, monkeypatch):
    rng = random.Random(21)
    log = random_log(rng, 40)
    far = spark.createDataFrame([(f"far{i}", f"url{i}", f"10.9/{i}", "t", "c", "u") for i in range(200)], CAPTURES)
    tables = empty_library(spark) | {"captures": far}
    folded = []
    flows = identity.flows
    monkeypatch.setattr(identity, "flows", lambda rows: folded.append(rows.count()) or flows(rows))
    for k in range(2):
        batch = pd.concat([log.iloc[20 * k : 20 * k + 20], log.iloc[20 * k : 20 * k + 3]])  # three arrivals repeat
        tables = kept(spark, changes.fed(tables, spark.createDataFrame(batch), f"now{k}"), tmp_path / str(k))
    whole = fold(log).set_index("capture_id")
    rows = {r.id: r for r in tables["captures"].collect() if not r.id.startswith("far")}
    assert set(rows) == set(whole.index) and tables["captures"].count() == 200 + len(rows) == tables["captures"].select("id").distinct().count()
    assert all((rows[i].doi, rows[i].url_hash, rows[i].title) == (w.doi, w.url_hash, f"title {w.last_seq}") for i, w in whole.iterrows())
    assert folded[0] == 20 and folded[1] <= 20 + 8  # as many owners as there are URLs, whatever the library holds


def test_arrivals_that_cannot_be_told_apart(spark):
    tables = empty_library(spark)
    row = lambda seq, at, text: (text * 20, "", at, seq, "t", text)
    feed = lambda *rows: changes.fed(tables, spark.createDataFrame(rows, "url_hash string, doi string, captured_at string, seq long, title string, content_text string"), "now")
    for bad in ([row(None, "1", "a")], [row(1, None, "a")], [row(1, "1", "a"), row(1, "1", "b")], [row(1, "1", "a"), row(1, "2", "a")]):
        with pytest.raises(changes.ArrivalError):
            feed(*bad)
    assert [r.id for r in feed(row(-5, "1", "a"), row(-5, "1", "a"))["captures"].collect()] == ["a" * 16 + "--5"]
    tables["captures"] = spark.createDataFrame([("b" * 16 + "-1", "elsewhere", "", "t", "", "")], CAPTURES)
    with pytest.raises(changes.ArrivalError):
        feed(row(1, "1", "b"))


def test_chains_and_circles_of_merges(spark):
    tables = empty_library(spark)
    tables["captures"] = spark.createDataFrame([(i, "", "", i, "", "") for i in "abcdefgh"], CAPTURES)
    tables["texts"] = spark.createDataFrame([(i, i) for i in "abcdefgh"], "capture_id string, content_text string")
    tables["items"] = spark.createDataFrame([(1, i, i) for i in "abcdefgh"], "collection_id long, capture_id string, added_at string")
    tables["postings"] = spark.createDataFrame([(i, "title", i) for i in "abcdefgh"], "capture_id string, field string, token string")
    merges = [("b", "a"), ("c", "b"), ("e", "d"), ("d", "e"), ("g", "f"), ("h", "f"), ("nowhere", "h")]
    after = library_of(changes.merged(tables, spark.createDataFrame(merges, "keep string, gone string")))
    assert [r[3] for r in after["captures"]] == ["c", "d", "g", "h"]
    assert after["items"] == [(i, i, 1) for i in "cdgh"]
    assert [r[0] for r in after["texts"]] == [r[0] for r in after["postings"]] == list("cdgh")


def test_a_late_batch(spark):
    """A DOI, a URL or both taken meanwhile, by a new capture and by an old one; a taken key that the batch frees; a rerouted owner."""
    base = empty_library(spark)
    base["captures"] = spark.createDataFrame([("old", "u-old", "10.1/old", "old", "0", "0"), ("moves", "u-moves", "", "moves", "0", "0"), ("drop", "u-both", "", "drop", "0", "0")], CAPTURES)
    base["items"] = spark.createDataFrame([(1, "drop", "1")], "collection_id long, capture_id string, added_at string")
    arrivals = [("u-new", "10.1/a", 1), ("u-taken", "", 2), ("u-old2", "10.1/old", 3), ("u-moves", "10.1/b", 4), ("u-both", "10.1/old", 5), ("u-free", "10.1/free", 6), ("u-plain", "", 7)]
    delta = changes.feed(base, spark.createDataFrame([(u, d, "1", s, f"t{s}", f"word{s}") for u, d, s in arrivals], "url_hash string, doi string, captured_at string, seq long, title string, content_text string"), "now")
    meanwhile = [("x", "u-x", "10.1/a", "x", "1", "1"), ("y", "u-taken", "", "y", "1", "1"), ("z", "u-z", "10.1/b", "z", "1", "1"), ("old", "u-old", "10.1/free", "old", "0", "1"), ("moves", "u-moves", "", "moves", "0", "0"), ("drop", "u-both", "", "drop", "0", "0")]
    tables = dict(base)
    tables["captures"] = spark.createDataFrame(meanwhile, CAPTURES)
    tables["items"] = spark.createDataFrame([(1, "drop", "1"), (2, "drop", "2")], "collection_id long, capture_id string, added_at string")
    tables["postings"] = spark.createDataFrame([(r[0], "title", r[3]) for r in meanwhile], "capture_id string, field string, token string")
    tables["artifacts"] = spark.createDataFrame([("x", "page.html", "x's"), ("moves", "page.html", "own"), ("moves", "old.txt", "kept along")], "capture_id string, name string, text string")
    written = spark.createDataFrame([("u-new-1", "page.html", "n"), ("u-new-1", "article.txt", "n"), ("moves", "paper.md", "m"), ("old", "paper.md", "o")], "capture_id string, name string, text string")
    change, rerouted = changes.rebased(tables, delta, written)
    assert sorted(map(tuple, rerouted.select("capture_id", "owner").collect())) == [("moves", "z"), ("u-new-1", "x")]
    after = changes.applied(tables, change)
    rows = {r.id: r for r in after["captures"].collect()}
    assert sorted(rows) == ["moves", "old", "u-free-6", "u-plain-7", "u-taken-2", "x", "y", "z"]
    assert (rows["old"].doi, rows["old"].url_hash, rows["old"].created_at, rows["moves"].doi, rows["x"].title) == ("10.1/old", "u-both", "0", "", "x")
    tokens = {(r.capture_id, r.token) for r in after["postings"].collect()}
    assert {("x", "word1"), ("z", "word4"), ("old", "word5"), ("moves", "moves")} <= tokens and ("x", "x") not in tokens and not any(c == "drop" for c, _ in tokens)
    assert sorted((r.collection_id, r.capture_id) for r in after["items"].collect()) == [(1, "old"), (2, "old")]
    files = sorted(map(tuple, after["artifacts"].select("capture_id", "name", "text").collect()))
    assert files == [("old", "paper.md", "o"), ("x", "article.txt", "n"), ("x", "page.html", "x's"), ("z", "old.txt", "kept along"), ("z", "page.html", "own"), ("z", "paper.md", "m")]
    both = changes.rebased(tables, delta, unique=("doi", "url_hash"))[1]
    assert sorted(map(tuple, both.select("capture_id", "owner").collect())) == [("moves", "z"), ("u-new-1", "x"), ("u-taken-2", "y")]


def test_an_owner_whose_own_row_is_rerouted_keeps_its_key(spark):
    captures = spark.createDataFrame([("p", "", "k1", "", "", ""), ("q", "", "k2", "", "", ""), ("r", "", "k9", "", "", "")], CAPTURES)
    rows = spark.createDataFrame([("n", "", "k1", "", "", ""), ("p", "", "k2", "", "", ""), ("s", "", "k9", "", "", ""), ("r", "", "k8", "", "", "")], CAPTURES)
    none = spark.createDataFrame([], "capture_id string")
    assert sorted(map(tuple, changes.taken(captures, rows, none).collect())) == [("n", "p"), ("p", "q")]


def test_what_a_merge_moves(spark):
    tables = empty_library(spark)
    tables["captures"] = spark.createDataFrame([(i, "", "", "", "", "") for i in "abc"], CAPTURES)
    tables["items"] = spark.createDataFrame([(1, "a", "2"), (1, "b", "1"), (2, "b", "5"), (2, "c", "4"), (3, "c", "9")], "collection_id long, capture_id string, added_at string")
    after = changes.merged(tables, spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a")], "keep string, gone string"))
    assert sorted(map(tuple, after["items"].collect())) == [(1, "a", "2"), (2, "a", "4"), (3, "a", "9")]
    assert [r.id for r in after["captures"].collect()] == ["a"]


def test_a_null_url_hash_is_one_url(spark):
    log = spark.createDataFrame([(None, "", "1", 1), (None, "", "2", 2), ("u", "", "3", 3)], "url_hash string, doi string, captured_at string, seq long")
    assert sorted((r.url_hash, r.arrivals) for r in identity.resolve(log).collect()) == [("", 2), ("u", 1)]


def test_guards(spark):
    tables = empty_library(spark)
    tables["captures"] = spark.createDataFrame([("a", "", "", "t", "", "old"), ("b", "", "", "t", "", "old")], CAPTURES)
    tables["items"] = spark.createDataFrame([(1, "a", "old")], "collection_id long, capture_id string, added_at string")
    tables["collections"] = spark.createDataFrame([(1, "one", "")], "id long, name string, created_at string")
    for call, says in (
        (lambda: changes.add_selected(tables, [" ", None], 1, "now"), "No captures selected."), (lambda: changes.add_selected(tables, "a", None, "now"), "Choose a collection."),
        (lambda: changes.add_selected(tables, ["zz"], 1, "now"), "No matching captures found."), (lambda: changes.add_selected(tables, ["a"], 999, "now"), "Collection not found."),
        (lambda: changes.delete_selected(tables, []), "No captures selected."), (lambda: changes.delete_selected(tables, ["zz"]), "No matching captures found."), (lambda: changes.delete_collection(tables, 9), "Collection not found."),
    ):
        with pytest.raises(collections.CollectionError, match=says):
            call()
    added = changes.add_selected(tables, [" b ", "a", "b", "zz"], 1, "now")
    assert sorted(map(tuple, added["items"].collect())) == [(1, "a", "old"), (1, "b", "now")] and {r.updated_at for r in added["captures"].collect()} == {"now"}
    removed = changes.remove_selected(tables, ["a"], 1, "now")
    assert removed["items"].count() == 0 and sorted(r.updated_at for r in removed["captures"].collect()) == ["now", "old"]
    gone = changes.delete_selected(tables, ["a"])
    assert [r.id for r in gone["captures"].collect()] == ["b"] and gone["items"].count() == 0 and set(gone) == set(changes.KEYS)
    assert changes.delete_collection(tables, 1)["collections"].count() == 0
    assert changes.form_ids([" x", "x", "", None, 3]) == ["x", "3"] and changes.form_ids("y") == ["y"] and changes.form_ids(None) == []


def test_pages_tell_whether_more_follow(spark):
    found = spark.range(7).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("updated_at"))
    pages = [[(r.id, r.has_more) for r in library.page_and_more(found, n, 3).orderBy("id").collect()] for n in (1, 2, 3, 4)]
    assert pages == [[("0", True), ("1", True), ("2", True)], [("3", True), ("4", True), ("5", True)], [("6", False)], []]


def test_search_without_index_equals_search_by_index(spark):
    captures = spark.createDataFrame([("a", "Über Café"), ("b", "plain"), ("c", None)], "id string, title string")
    texts = spark.createDataFrame([("a", "naïve Straße"), ("b", None), ("zz", "cafe naive")], "capture_id string, content_text string")
    for q in ("caf naiv", "uber", "stra", "pla", "nothing", "caf"):
        terms = library.query_terms(q)
        by_index = library.matching_ids(fulltext.postings(captures, texts), terms).collect()
        assert sorted(r.capture_id for r in by_index) == sorted(r.capture_id for r in fulltext.matching(captures, texts, terms).collect()), q


def test_bundles_and_records(spark):
    captures = spark.createDataFrame([("a", "u", "row", "", 2000, "J", "c", "")], "id string, url string, title string, doi string, year int, container_title string, created_at string, updated_at string")
    artifacts = spark.createDataFrame([("a", "references.json", '[{"n": "1", "text": "R", "doi": "10.1/x"}]'), ("a", "paper.md", "# x"), ("a", "reduced.json", "[]")], "capture_id string, name string, text string")
    r = bundles.bundles(captures, artifacts).first()
    assert (r.title, r.year, r.captured_at, r.paper_md, r.references[0].doi, r.sections, r.parse_ok) == ("row", 2000, "c", "# x", "10.1/x", [], False)
    names = spark.createDataFrame([(' {"given": "Ann", "last": "Lee"}',), ("Bo Roe ",), ('{"given": "Cy"}',), (None,)], "p string").select(metadata.person_name(F.col("p"))).collect()
    assert [n[0] for n in names] == ["Ann Lee", "Bo Roe", "", ""]
    assert len(spark.range(1).select(metadata.now_iso()).first()[0]) == 25
