import json
import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import metadata, records
from folioforge.operators import bitmaps, collections, library
from folioforge.sources import buckets, bundles, exports


def test_records_of_every_shape(spark):
    rows = [
        {"keywords": "a, b", "authors": [{"given": "Ann", "last": "Lee"}, "ann lee", {"name": " Group "}, {"given": "x"}, 7], "abstract": 5, "meta": {"k": ["x", ["y", ["z", None]]], "n": 1, "e": []}, "client": {"v": "1", "ext": None}, "published_date_raw": " 2020 "},
        {"keywords": ["x", "X", None, " ", 3], "authors": "Bo Roe", "abstract": None, "client": "no", "meta": 3},
        {"keywords": {"k": "v"}, "authors": {"name": "x"}}, {},
    ]
    texts = [json.dumps(r) for r in rows] + ["", "[1]", "{broken", None, '"text"']
    found = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(records.meta_record(F.col("t"))).collect()]
    assert (found[0].keywords, found[0].authors, found[0].abstract, found[0].published_date_raw) == (["a, b"], ["Ann Lee", "Group", "7"], "5", "2020")
    assert (found[0].meta, found[0].client) == ({"k": ["x", "y; z"], "n": ["1"], "e": []}, {"v": "1", "ext": ""})
    assert (found[1].keywords, found[1].authors, found[1].abstract, found[1].meta, found[1].client) == (["x", "3"], ["Bo Roe"], "", {}, {})
    empty = ({}, [], [], "", "", {})
    assert [(r.meta, r.keywords, r.authors, r.abstract, r.published_date_raw, r.client) for r in found[3:]] == [empty] * 6


def test_a_record_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(records.meta_record(F.col("t")).alias("r")).select("r.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1
    captures = spark.createDataFrame([("a", "u", "t", "", 1999, "J", "c", "")], "id string, url string, title string, doi string, year int, container_title string, created_at string, updated_at string")
    told = {"title": "0", "doi": 0, "year": 0, "parse": {"ok": 1, "parser": "p", "confidence_fulltext": "0.5", "used_for_index": False}, "authors": [" A ", 0, None, ""]}
    artifacts = spark.createDataFrame([("a", "reduced.json", json.dumps(told)), ("a", "page.html", "x")], "capture_id string, name string, text string")
    b = bundles.bundles(captures, artifacts)
    assert b._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    r = b.first()
    assert (r.title, r.doi, r.year, r.authors, r.parse_ok, r.parse_parser, r.confidence_fulltext, r.used_for_index) == ("0", "", 0, ["A"], True, "p", 0.5, False)


def test_the_array_export_is_one_file_over_many_parts(spark, tmp_path):
    section = "array<struct<title: string, kind: string, text: string, level: int>>"
    rows = [(f"{i:02d}", f'T "{i}" \\ é\n', None if i % 3 else 2000 + i, [] if i % 4 == 0 else [("S", "other", "line\tx", 1), (None, "k", "", None)], None if i == 5 else ["x"]) for i in range(23)]
    df = spark.createDataFrame(rows, f"id string, title string, year int, sections {section}, authors array<string>").repartition(5)
    whole = lambda df, name: (exports.write_parts(exports.json_array(df, [F.col("id")]), ["n"], str(tmp_path / name), 4), "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*"))))[1]
    names = ("title", "kind", "text", "level")
    want = [{"id": i, "title": t, "year": y, "sections": [dict(zip(names, x, strict=True)) for x in s], "authors": a} for i, t, y, s, a in rows]
    text = whole(df, "many")
    assert text == json.dumps(want, ensure_ascii=False, indent=2, sort_keys=True) + "\n" and len(list((tmp_path / "many").glob("part-*"))) > 1
    assert whole(df.limit(0), "none") == "[]\n"
    assert json.loads(whole(df.limit(1), "one"))[0]["id"]


def test_bitmaps_equal_sets(spark):
    rng = random.Random(3)
    ids = [-200, -64, -1, 0, 63, 64, 10**12, *(rng.randrange(300) for _ in range(200))]
    of = lambda pairs: spark.createDataFrame(sorted(pairs), "collection_id long, capture_id long")
    a, b = ({(rng.randrange(3), i) for i in ids if rng.random() < 0.6} for _ in range(2))
    x, y = bitmaps.bitmaps(of(a)), bitmaps.bitmaps(of(b))
    members = lambda maps: {tuple(r) for r in bitmaps.members(maps).collect()}
    assert members(x) == a and members(bitmaps.difference(x, y)) == a - b and members(bitmaps.common(x, y)) == a & b
    assert {tuple(r) for r in bitmaps.counts(x).collect()} == {(c, sum(p[0] == c for p in a)) for c in {p[0] for p in a}}


def test_kept_counts_equal_a_recount_after_many_changes(spark):
    rng = random.Random(5)
    held, kept = set(), spark.createDataFrame([], "collection_id long, count long")
    of = lambda pairs: spark.createDataFrame(sorted(pairs), "collection_id long, capture_id long")
    for _ in range(5):  # ten changes at a time
        added, removed = set(), set()
        for _ in range(10):
            pair = (rng.randrange(4), rng.randrange(8))
            (removed if pair in held else added).add(pair)
        held = held - removed | added
        kept = spark.createDataFrame(bitmaps.changed_counts(kept, of(added), of(removed)).collect(), "collection_id long, count long")
        assert bitmaps.drift(kept, of(held)).isEmpty()
    assert bitmaps.drift(kept, of(held | {(9, 9)})).count() == 1


def test_one_registry_row_counts_for_a_doi(spark):
    captures = spark.createDataFrame([("a", "u", "", "10.1/x", None, "", "", ["Own"])], "id string, url string, title string, doi string, year int, container_title string, published_date_raw string, authors array<string>")
    registry = spark.createDataFrame([("10.1/X", "No authors", "", "", 1, []), (" 10.1/x", "B", "", "", 2, ["R"]), ("10.1/x", "A", "", "", 3, ["S"]), ("", "blank", "", "", 4, ["T"])], "doi string, title string, container_title string, published_date_raw string, year int, authors array<string>")
    [row] = metadata.with_registry(captures, registry).collect()
    assert (row.title, row.year, row.authors, row.local_authors) == ("A", 3, ["S"], ["Own"])


def test_buckets_meet_a_registry_without_a_shuffle(spark):
    captures = spark.createDataFrame([(str(i), f"u{i}", "", f"10.1/{i}" if i % 3 else "", None, "", "", ["Own"]) for i in range(40)], "id string, url string, title string, doi string, year int, container_title string, published_date_raw string, authors array<string>")
    registry = spark.createDataFrame([(f"10.1/{i // 2}", f"T{i}", "J", "", 1990, ["R"] if i % 2 else []) for i in range(60)], "doi string, title string, container_title string, published_date_raw string, year int, authors array<string>")
    try:
        left, right = buckets.save(captures, "bucketed_captures", 4), buckets.save_registry(registry, "bucketed_registry", 4)
        found = metadata.filled(left, right.hint("merge"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(found) == rows(metadata.with_registry(captures, registry)) and "title='T3'" in "".join(rows(found))
    finally:
        for name in ("bucketed_captures", "bucketed_registry"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_collections_of_one_capture(spark):
    tables = {
        "captures": spark.createDataFrame([("a", "old"), ("b", "old")], "id string, updated_at string"), "collections": spark.createDataFrame([(i, str(i)) for i in (1, 2, 3)], "id long, name string"),
        "items": spark.createDataFrame([(1, "a", "old"), (2, "a", "old"), (2, "b", "old")], "collection_id long, capture_id string, added_at string"),
    }
    after = collections.set_for_capture(tables, "a", [2, 3, 3], "now")
    assert sorted(map(tuple, after["items"].collect())) == [(2, "a", "old"), (2, "b", "old"), (3, "a", "now")]
    assert sorted(map(tuple, after["captures"].collect())) == [("a", "now"), ("b", "old")]
    assert [r.collection_id for r in collections.set_for_capture(tables, "b", [], "now")["items"].where("capture_id = 'b'").collect()] == []
    for capture, wanted, says in (("zz", [1], "Capture not found."), ("a", [9], "Collection not found.")):
        with pytest.raises(collections.CollectionError, match=says):
            collections.set_for_capture(tables, capture, wanted, "now")


def test_parameters_of_a_request():
    p = library.params
    assert p({}) == {"q": "", "collection": 0, "number": 1, "size": 50} and p({"q": " x ", "col": " 7", "page": "-2", "page_size": "9999"}) == {"q": "x", "collection": 7, "number": 1, "size": 500}
    assert p({"collection": "3", "col": "7", "page": "2", "page_size": "0"}) == {"q": "", "collection": 3, "number": 2, "size": 50} and p({"collection": "", "col": "7"})["collection"] == 7
    assert [library.whole_number(x) for x in ("1_0", "", None, "x", "99999999999", "+4", 5)] == [None, None, None, None, None, 4, 5]
