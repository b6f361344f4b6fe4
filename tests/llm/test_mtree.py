import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.llm import mtree


def brute(ids, v, k, asks):
    out = set()
    for i in np.flatnonzero(asks):
        scores = v @ v[i]
        best = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist(), strict=True) if j != ids[i])[:k]
        out |= {(int(ids[i]), r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def tree_of(ids, v):
    return mtree.Tree(pd.DataFrame(mtree.build(np.asarray(ids), v)), v.shape[1])


def best(ids, v, q, own, k):
    return sorted((-s, j) for s, j in zip((v @ q).tolist(), ids.tolist(), strict=True) if j != own)[:k]


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (40, 8))
    v = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 3, (3000, 8))).astype(np.int64)
    v[:400] = v[0]  # many equal vectors and so many ties
    ids = rng.permutation(3000)
    asks = np.arange(0, 3000, 60)
    tree = tree_of(ids, v)
    got = tree.search(ids[asks], v[asks], np.full(len(asks), -np.inf), 20)
    for i, (found, scores) in zip(asks, got, strict=True):
        assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == best(ids, v, v[i], ids[i], 20)
    assert tree.computed < 0.3 * len(asks) * 3000
    # with cuts, only what reaches them is found
    cuts = np.array([float(s[9]) for _, s in got])
    again = tree.search(ids[asks], v[asks], cuts, 20)
    assert all((s >= c).all() and list(f[:10]) == list(g[0][:10]) for (f, s), c, g in zip(again, cuts, got, strict=True))


def test_nodes_cover_what_is_below():
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (2000, 5))
    nodes = mtree.build(np.arange(2000), v)
    point = lambda n: np.frombuffer(nodes[n]["pivot"], np.int64)
    below = {}
    for n in nodes:
        if n["parent"] >= 0:
            assert abs(np.linalg.norm(point(n["node"]) - point(n["parent"])) - n["parent_distance"]) < 1e-9
        if n["ids"] is not None:
            i, at = np.frombuffer(n["ids"], np.int64), n["node"]
            assert (np.diff(np.frombuffer(n["distances"])) <= 0).all() and len(i) <= mtree.PAGE
            while at >= 0:
                below.setdefault(at, []).extend(i.tolist())
                at = nodes[at]["parent"]
    assert sorted(below[0]) == list(range(2000))
    assert all(np.linalg.norm(v[i] - point(n), axis=1).max() <= nodes[n]["radius"] + 1e-9 for n, i in below.items())


def test_large_numbers_stay_exact():
    v = np.array([[2**30, 1], [2**30, 2], [2**30 - 1, 3]], dtype=np.int64)
    [(ids, scores)] = tree_of(np.arange(3), v).search(np.array([9]), v[:1], np.array([-np.inf]), 3)
    assert ids.tolist() == [1, 0, 2] and scores.tolist() == sorted((v @ v[0]).tolist(), reverse=True)


@pytest.mark.parametrize("routed", [mtree.ROUTED, 0])
def test_query_against_brute_force(spark, monkeypatch, routed):
    monkeypatch.setattr(mtree, "ROUTED", routed)
    monkeypatch.setattr(mtree, "TREE_ROWS", 150)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 10)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 6))
    rows = [(int(i), [float(c) for c in e], "clash", "clash") for i, e in enumerate(x)]
    bad = [(600, None, "", ""), (620, [1.0, None, 1.0, 1.0, 1.0, 1.0], "", ""), (640, [float("nan")] * 6, "", ""), (660, [float("inf")] * 6, "", ""), (680, [], "", ""), (None, [1.0] * 6, "", ""), (700, [1.0, 2.0], "", "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, id string, score string")
    got = {tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()}
    v = np.floor(64 * x).astype(np.int64)
    assert got == brute(np.arange(600), v, 7, np.arange(600) % 20 == 0)
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0
    assert mtree.top_k(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0, 7).count() == 2


def test_a_third_of_all_vectors_may_be_equal(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 100)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (600, 4))
    x[::3] = x[0]
    df = spark.createDataFrame([(int(i), [float(c) for c in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(64 * x).astype(np.int64)
    assert {tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, 9).collect()} == brute(np.arange(600), v, 9, np.arange(600) % 20 == 0)


def test_query_rows_that_repeat(spark):
    """Equal rows ask once; an identifier with two vectors asks with each; candidates that repeat count each."""
    rng = np.random.default_rng(7)
    x = [[float(c) for c in e] for e in rng.normal(0, 1, (60, 4))]
    rows = [*enumerate(x), (20, x[20]), (40, x[5]), (7, x[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = [(i, tuple(int(np.floor(64 * c)) for c in e)) for i, e in rows]
    want = []
    for i, q in {(i, e) for i, e in v if i % 20 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, e, strict=True)), j) for j, e in v if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    got = [tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == sorted(want) and len(got) == 4 * 20
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(con.execute(mtree.SQL).fetchall()) == sorted(want)


def test_query_equals_its_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    assert sorted(tuple(r) for r in mtree.op6_mtree(spark, "/root/testdata/sf0.001").collect()) == sorted(duckdb.sql(mtree.SQL).fetchall())
