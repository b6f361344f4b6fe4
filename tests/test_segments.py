import json
import os
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import changes, fulltext, graph, library, ordering, segments, trigrams
from folioforge.streaming import feed, ingest
from tests.folds import fold

SCHEMAS = {"captures": "id string, title string", "texts": "capture_id string, content_text string", "postings": "capture_id string, field string, token string"}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_segments_hold_what_the_whole_tables_hold(spark, tmp_path):
    rng = random.Random(1)
    lib = segments.Library(spark, str(tmp_path / "lib"), SCHEMAS)
    want = {name: [] for name in SCHEMAS}
    sizes, counts = [], []
    for batch in range(7):
        ids = [str(i) for i in rng.sample(range(20), 4)]
        gone = [*ids, str(rng.randrange(20))]
        new = {"captures": [(i, f"title {batch}") for i in ids], "texts": [(i, f"text {batch}") for i in ids], "postings": [(i, "title", t) for i in ids for t in ("title", str(batch))]}
        if batch == 3:
            del new["texts"]
        for name in new:
            want[name] = [r for r in want[name] if r[0] not in gone] + new[name]
        goes = spark.createDataFrame([(g,) for g in gone], "capture_id string")
        delta = changes.Delta({name: spark.createDataFrame(r, SCHEMAS[name]) for name, r in new.items()}, {name: goes for name in new})
        assert lib.add(10 + batch, delta) and not lib.add(10 + batch, delta)
        entry = lib.ledger()
        counts.append(sum(r["name"] == "captures" for r in entry))
        sizes.append(max(r["high"] for r in entry))
        assert all(rows_of(lib.read(name)) == sorted(want[name], key=str) for name in SCHEMAS)
    assert lib.applied() == 16 and max(counts) <= 4 and sizes == list(range(7))
    terms = library.query_terms("tit 6")
    assert rows_of(library.matching_ids(lib.read("postings"), terms)) == sorted({(r[0],) for r in want["postings"] if r[2] == "6"})
    assert fulltext.verify(lib.read("captures"), lib.read("postings").select("capture_id").distinct()).first().ok
    assert lib.vacuum() > 0 and all(rows_of(lib.read(name)) == sorted(want[name], key=str) for name in SCHEMAS)


def test_what_a_feed_writes_follows_the_batch(spark, tmp_path, monkeypatch):
    lib = segments.Library(spark, str(tmp_path / "lib"), {"texts": SCHEMAS["texts"]})
    batch = lambda k, n: changes.Delta({"texts": spark.range(n).select(F.concat(F.lit(f"{k}-"), "id").alias("capture_id"), F.lit("x").alias("content_text"))})
    lib.add(0, batch(0, 5000))
    written = []
    write = segments.Library._write
    monkeypatch.setattr(segments.Library, "_write", lambda *a: written.append(write(*a)) or written[-1])
    for k in range(1, 6):
        lib.add(k, batch(k, 10))
    assert sum(written) <= 5 * 10 * 3 and lib.read("texts").count() == 5050


def payload(url, doi, text):
    return json.dumps({"source_url": url, "dom_html": "<title>t</title>", "extraction": {"meta": {"citation_doi": doi}, "content_html": f"<p>{text}</p>"}})


def payloads():
    rng = random.Random(4)
    out = [payload(f"https://ex.org/{rng.choice('abcde')}", rng.choice(["", "", "10.1234/x", "10.1234/y"]), f"word{i}") for i in range(18)]
    return [*out, out[3], out[3], "{broken"]


def state(lib):
    tables = lib.tables()
    met = tables["captures"].join(tables["texts"].withColumnRenamed("capture_id", "id"), "id").join(tables["postings"].groupBy(F.col("capture_id").alias("id")).agg(F.sort_array(F.collect_set("token")).alias("tokens")), "id")
    return rows_of(met.select("url_hash", "doi", "title", "content_text", F.col("tokens").cast("string")))


def test_a_stream_cut_off_in_the_middle_gives_what_one_batch_gives(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    given = payloads()
    for i, part in enumerate((given[:11], given[11:])):
        (source / f"{i}.json").write_text("\n".join(part) + "\n")
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    whole = segments.Library(spark, str(tmp_path / "whole"), feed.SCHEMAS)
    read = spark.read.text(str(source)).select("value", F.col("_metadata.file_modification_time").alias("captured_at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    assert feed.apply(whole, read, 0, now="now")
    cut = segments.Library(spark, str(tmp_path / "cut"), feed.SCHEMAS)
    calls, write, ledger = [], segments.Library._write, segments.Library.ledger

    def failing(self, name, *a):
        calls.append(name)
        if len(calls) == 6:  # the second batch has written one of its tables
            raise RuntimeError("cut off")
        return write(self, name, *a)

    monkeypatch.setattr(segments.Library, "_write", failing)
    run = lambda: feed.start(spark, str(source), cut, str(tmp_path / "check"), files_per_batch=1, quarantine=str(tmp_path / "bad")).awaitTermination()
    with pytest.raises(Exception, match="cut off"):
        run()
    assert cut.applied() == 0
    run()
    assert cut.applied() == 1 and len({r["batch"] for r in ledger(cut)}) == 1
    assert state(cut) == state(whole) and state(cut)
    assert [r.error_code for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["invalid_json"]
    assert not feed.apply(cut, read, 1)  # the ledger has it


def test_what_a_stream_wrote_can_be_fed_in_two_parts(spark, tmp_path):
    """Payloads that repeat, in one file and in several, are arrivals of their own."""
    source = tmp_path / "in"
    source.mkdir()
    given = payloads()
    for i, part in enumerate((given[:10] + given[:2], given[10:] + given[:3])):
        (source / f"{i}.json").write_text("\n".join(part) + "\n")
    ingest.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=1).awaitTermination()
    came = spark.read.parquet(str(tmp_path / "out" / "captures"))
    tables = {name: spark.createDataFrame([], schema) for name, schema in feed.SCHEMAS.items()}
    for batch in (0, 1):
        tables = {name: graph.stored(df, "fed") for name, df in changes.fed(tables, came.where(F.col("batch") == batch).drop("batch"), "now").items()}
    log = came.toPandas()
    log["captured_at"] = log["captured_at"].astype(str)
    want = fold(log)
    assert came.count() == came.select("seq").distinct().count() == 25
    assert sorted((r.url_hash, r.doi) for r in tables["captures"].collect()) == sorted(zip(want.url_hash, want.doi, strict=True))
    assert sorted(r.id for r in tables["captures"].collect()) == sorted(want.capture_id)


def test_numbers_do_not_hang_on_partitions(spark):
    batch = spark.createDataFrame([(f"v{i}", f"2024-01-0{1 + i % 3}", f"f{i % 5}", 0) for i in range(40)], "value string, captured_at string, file string, block long").coalesce(1)
    one = {r.value: r.seq for r in feed.arrivals(batch, 3).collect()}
    ordered = sorted(range(40), key=lambda i: (i % 3, i % 5, i))
    assert one == {f"v{i}": 3 * feed.PLACES + k + 1 for k, i in enumerate(ordered)}


def test_pages_by_rank_read_what_they_need(spark, tmp_path):
    found = spark.range(4000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("updated_at"))
    path = str(tmp_path / "pages")
    ordering.write_pages(found, path, rows_in_file=500)
    for n in (1, 2, 80, 81):
        assert [r.id for r in ordering.read_page(spark, path, n, 50).collect()] == [r.id for r in library.page(found, n, 50).collect()], n
    plan = ordering.read_page(spark, path, 40, 50)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(rank), GreaterThanOrEqual(rank,1951), LessThanOrEqual(rank,2000)]" in plan
    page = ordering.read_page(spark, path, 40, 50)
    assert page.select(F.input_file_name().alias("f")).distinct().count() == 1


def test_substring_search_by_trigrams_equals_a_scan(spark, tmp_path):
    rng = random.Random(2)
    letters = "abAB _%é\\"
    rows = [(str(i), "".join(rng.choices(letters, k=rng.randrange(40))), None if i % 9 == 0 else "".join(rng.choices(letters, k=rng.randrange(9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, title string, url string")
    path = str(tmp_path / "grams")
    trigrams.write_index(df, "id", ["title", "url"], path)
    texts = [r[1] for r in rows if len(r[1]) > 8]
    fragments = ["", "a", "ab", "zzz", "%", "_", "ab%AB", "a_b%", "\\a%"] + [t[3 : 3 + rng.randrange(3, 7)] for t in texts[:8]]
    for q in fragments:
        want = rows_of(library.search(df.withColumn("doi", F.lit("")), q).select("id")) if q else rows_of(df.select("id"))
        assert rows_of(trigrams.search(df, "id", ["title", "url"], path, q).select("id")) == want, q
    assert trigrams.candidates(spark, path, "zzz").count() == 0 and trigrams.candidates(spark, path, "a_") is None
    assert trigrams.fragment_grams("aBCd%xy_zzz") == ["abc", "bcd", "zzz"]


def test_a_common_token_has_many_files(spark, tmp_path):
    """A token that most postings have is dealt to several tasks, and a prefix still opens few files."""
    index = spark.range(20_000).select(F.col("id").cast("string").alias("capture_id"), F.lit("title").alias("field"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("z"), "id")).otherwise("common").alias("token"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small files would be put together
    try:
        fulltext.write_postings(index, str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    read = spark.read.parquet(str(tmp_path / "index"))
    files = read.withColumn("file", F.input_file_name()).groupBy("token").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"))
    assert files.where("token = 'common'").first()["files"] >= 3 and files.where("token != 'common' and files > 1").isEmpty()
    assert library.matching_ids(read, ["comm"]).count() == 18_000 and library.matching_ids(read, ["z19"]).count() == index.where("token like 'z19%'").count()


def test_a_capture_with_most_memberships_is_split(spark):
    """The join that moves memberships is left to adaptive execution, which splits the hot capture's."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        items = spark.range(60_000).repartition(8).select(F.lit(1).cast("long").alias("collection_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("capture_id"), F.lit("x").alias("added_at"))
        merges = spark.createDataFrame([("kept", "hot"), ("other", "3")], "keep string, gone string")
        found = changes.merged({"items": items}, merges)["items"]
        assert len(found.collect()) == 20_001 and not {"hot", "3"} & {r.capture_id for r in found.collect()}
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
