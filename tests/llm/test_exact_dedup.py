from pyspark.sql import functions as F

from folioforge.llm import exact_dedup
from tests.llm.fixtures import docs, edge_docs, empty_docs


def brute(rows, pick):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = pick([i for i in ids if i is not None], default=None)
        out.append((str(r.doc_id), str(keep), len(ids), r.doc_id == keep))
    return sorted(out)


def got(df):
    return sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in df.collect())


def test_edges_and_both_ways_to_keep(spark):
    edge = edge_docs(spark)
    assert got(exact_dedup.exact_dedup(edge)) == brute(edge.collect(), max)
    assert got(exact_dedup.exact_dedup(edge, keep="smallest")) == brute(edge.collect(), min)
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0


def test_texts_that_share_a_digest_are_told_apart(spark, monkeypatch):
    given = docs(spark, ["a", "b", "a", "c", "c", "aa", None, ""])
    weak = lambda t: F.when(t == "c", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    for most in (0, 1000):  # joined by a shuffle and by broadcast
        monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", most)
        assert got(exact_dedup.exact_dedup(given, digest=weak)) == brute(given.collect(), max)
        assert got(exact_dedup.exact_dedup(given)) == brute(given.collect(), max)


def entries(index):
    return sorted((bytes(r.digest), r.keep, r.n) for r in index.compact().collect())


def test_batches_equal_one_and_older_runs_are_looked_up(spark, tmp_path):
    digest = lambda c: F.unhex(F.sha2(c.cast("string"), 256))
    rows = spark.range(400).select("id", digest(F.col("id") % 150).alias("digest"))
    once = exact_dedup.DigestIndex(spark, str(tmp_path / "once"))
    all_hits = {bytes(r.digest) for r in once.flush(rows).collect()}
    index, hits = exact_dedup.DigestIndex(spark, str(tmp_path / "index")), set()
    for k in range(5):
        hits |= {bytes(r.digest) for r in index.flush(rows.where(F.col("id").between(80 * k, 80 * k + 79))).collect()}
    assert index.flush(rows.limit(0)).count() == 0
    assert [len(level) for level in index.levels] == [1, 0, 1]  # four runs are one two levels up
    assert hits == all_hits
    for part in (tmp_path / "index").rglob("entries/*.parquet"):
        digests = [bytes(r.digest) for r in spark.read.parquet(str(part)).collect()]
        assert digests == sorted(digests)
    run = index.runs()[0]
    probe = spark.range(1000, 2000).select(digest(F.col("id")).alias("digest"))
    likely = exact_dedup.maybe_held(exact_dedup.hashed(probe), "h", run.words, run.bits).count()
    assert likely < 100 and run.holds(probe.unionByName(run.entries.select("digest").limit(7))).count() == 7
    assert entries(index) == entries(once)


def test_memtables_make_no_difference_and_the_query_is_brute_force(spark):
    d = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{d}/documents.parquet")
    want = brute(given.collect(), max)
    assert got(exact_dedup.exact_dedup(given, memtables=1)) == got(exact_dedup.exact_dedup(given, memtables=7)) == want
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.op10_exact_dedup(spark, d).collect()) == want
