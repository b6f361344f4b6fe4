import numpy as np
from pyspark.sql import functions as F

from folioforge.llm import toxicity
from tests.llm.fixtures import edge_docs, empty_docs

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    train, rest = labels.where("doc_id % 5 > 0"), labels.where("doc_id % 5 = 0")
    model = toxicity.learn(docs, toxicity.toxic_labels(train))
    rows = toxicity.score(docs.join(rest.select("doc_id"), "doc_id", "left_semi"), model).join(rest.withColumnRenamed("doc_id", "id"), "id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.chance >= toxicity.REJECT for r in toxic]) >= 0.9
    assert np.mean([r.chance < toxicity.REJECT for r in clean]) >= 0.99
    assert np.mean([r.severity for r in toxic]) > 1 + np.mean([r.severity for r in clean])


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [[int(x) for x in np.flatnonzero(rng.random(4) < [0.2 + 0.35 * g, 0.9 - 0.35 * g, 0.5, 0.5])] for g in grades]
    w, theta = toxicity.fit(rows, grades, 4)
    assert w[0] > 0.5 and w[1] < -0.5 and abs(w[2]) < 0.4 and theta[0] < theta[1]


def test_edges(spark):
    docs = edge_docs(spark)
    graded = spark.createDataFrame([(1, 0), (6, 0), (7, 1), (7, 0), (None, 1), (4, None)], "id long, toxic int")
    model = toxicity.learn(docs, graded)
    rows = toxicity.score(docs, model, carry={"lang": F.col("lang")}).collect()
    assert len(rows) == docs.count() and all(0 <= r.severity <= 3 for r in rows)
    none = toxicity.learn(docs, graded.limit(0))
    assert none.thetas == [] and {(r.severity, r.grade) for r in toxicity.score(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.score(empty_docs(spark), model).count() == 0


def test_query_against_the_model_row_by_row(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.learn(docs, toxicity.toxic_labels(labels))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = toxicity.op5_toxicity(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        x = sum(w for t, w in model.weights.items() if t in toxicity.features_of(texts[r.doc_id]))
        above = [1 / (1 + np.exp(t - x)) for t in model.thetas]
        each = -np.diff([1.0, *above, 0.0])
        assert abs(r.severity - sum(above)) < 1e-6 and r.toxic == bool(above and above[0] >= toxicity.REJECT) and each[r.grade] >= each.max() - 1e-9
