import re
from collections import defaultdict
from types import SimpleNamespace

import duckdb
from pyspark.sql import functions as F

from folioforge.llm import mixing
from tests.llm.fixtures import docs, edge_docs, empty_docs


def targets(sizes, repeats=3):
    """By the contract's own words: share, stop at the limit, share the excess anew by weight."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            free.discard(s)


def held(rows, source):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in source:
        sizes[r.source] += words(r.text)
    want = targets(sizes)
    assert len(rows) == len(source)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_targets_are_met(spark):
    sources = [["a", "b", "c", "d", None, "é"][min(5, i * i % 11)] for i in range(300)]
    given = docs(spark, ["w " * (i * 37 % 400) for i in range(300)], sources)
    rows = mixing.mix(given, block_words=64).collect()
    held(rows, given.collect())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(given, block_words=1000).collect()))  # blocks only cut the work


def test_edges(spark):
    given = edge_docs(spark)
    held(mixing.mix(given).collect(), given.collect())
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_the_schedule_spreads_sources(spark):
    s = spark.createDataFrame([(0, "a", 6400, 6400.0, 6400), (1, "b", 6400, 12800.0, 12800)], "sid long, source string, source_size long, target double, take long")
    rows = sorted(mixing.schedule(s, 64).collect(), key=lambda r: r.slot)
    assert len(rows) == 300 and len({r.slot for r in rows}) == 300
    for sid, n in ((0, 100), (1, 200)):
        own = [r for r in rows if r.sid == sid]
        assert [r["rank"] for r in own] == list(range(n)) and {(r.epoch, r.block) for r in own} == {(e, b) for e in range(n // 100) for b in range(100)}
    half = [r.sid for r in rows[:150]]
    assert abs(half.count(0) - 50) <= 10  # of any stretch, each source has its share


def test_reversed_bits(spark):
    x = [0, 1, 2, 5, 1 << 40, -1, -(1 << 63), 123456789]
    got = spark.createDataFrame([(i,) for i in x], "x long").select("x", mixing.reversed_bits(F.col("x")).alias("r")).collect()
    assert all(f"{r.r & (2**64 - 1):064b}" == f"{r.x & (2**64 - 1):064b}"[::-1] for r in got)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{d}/documents.parquet").collect()
    rows, of = mixing.op4_mixing(spark, d).collect(), {r.doc_id: r.source for r in source}
    held([SimpleNamespace(**r.asDict(), source=of[r.doc_id]) for r in rows], source)
    want = duckdb.sql(mixing.SQL.replace("FROM documents", f"FROM '{d}/documents.parquet'")).fetchall()
    assert sorted(tuple(r) for r in rows) == sorted(want)
