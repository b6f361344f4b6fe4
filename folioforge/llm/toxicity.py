"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w * x): one weight a word, shared by all thresholds theta_1 <= theta_2 <= ... The
prediction is the expected severity, the sum over k of P(grade >= k). Features say which words (runs of letters, lower
case) and beginnings of words a text holds; those are used whose presence goes with toxic labels, or against them, beyond chance.

Labels say toxic or not. A toxic document's grade (1 to GRADES) comes from outside its own evidence: the sample is cut into
FOLDS by hash, each fold is judged by a model of toxic or not fitted on the other folds, and the toxic documents are cut at
equal shares of those out-of-fold scores. So severity means how surely documents of a kind are told from clean ones by
what others teach.

The model is fitted on a bounded sample of labelled rows (SAMPLE, the smallest hashes of their identifiers); counting
and choosing words are Spark aggregations over that sample, and at most FEATURES weights reach the executors. Every
document is scored over its whole text.

Defined results: a null or empty text has no features. Without both toxic and other labels nothing is learned, all
severities are 0 and nothing is toxic. Labels that are null are left out; a document labelled twice is toxic if one label
says so. Repeated rows give repeated results. An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import spread_table, stored, table, whole

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Words with a weight, at most.
FEATURES = 4096
#: Standard deviations by which a word's toxic documents must differ from what chance gives.
EVIDENCE = 5.0
#: Documents of the sample that a word must occur in: this many, and this part of the sample.
LEAST_DOCS, LEAST_PART = 3, 0.0005
#: A document is rejected from this probability of any severity on.
REJECT = 0.5
#: Weight of the squared weights in the loss of the whole sample.
RIDGE = 0.05
#: Grades of toxic documents, cut at equal shares of their out-of-fold scores, and the folds for these.
GRADES, FOLDS = 3, 3
#: Letters of a word's beginning that are a feature of their own.
BEGINNING = 4

_words = re.compile(r"[^\W\d_]+").findall


def features_of(text: str) -> set[str]:
    """The different words, and their beginnings with an asterisk, which know forms of a word that training has not seen."""
    words = set(_words(text.lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) >= BEGINNING}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thetas: list[float]

    def at_least(self, features: set[str]) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        get = self.weights.get
        x = sum([w for t in features if (w := get(t))])
        return [float(_sigmoid(np.float64(x - t))) for t in self.thetas]


def fit(rows: list[list[int]], grades: np.ndarray, features: int, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the mean log likelihood and a ridge. rows: feature numbers of each document."""
    n, top = len(rows), int(grades.max())
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((f for r in rows for f in r), dtype=np.int64, count=len(row))
    share = np.array([np.mean(grades >= k) for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.05))])  # steps between thresholds stay positive
    m, v = np.zeros_like(p), np.zeros_like(p)
    index = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = p[:features], np.exp(p[features + 1 :])
        theta = np.concatenate([[-np.inf], np.cumsum(np.concatenate([p[features : features + 1], gaps])), [np.inf]])
        x = np.bincount(row, weights=w[col], minlength=n)
        upper, lower = _sigmoid(theta[grades + 1] - x), _sigmoid(theta[grades] - x)
        chance = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        g_x = (du - dl) / n
        g_theta = np.zeros(top + 2)
        np.add.at(g_theta, grades[index] + 1, -du / n)
        np.add.at(g_theta, grades[index], dl / n)
        inner = g_theta[1:-1]
        g = np.concatenate([np.bincount(col, weights=g_x[row], minlength=features) + 2 * RIDGE / n * w, [inner.sum()], [inner[k + 1 :].sum() * gaps[k] for k in range(top - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:features], np.cumsum(np.concatenate([p[features : features + 1], np.exp(p[features + 1 :])]))


def graded(rows: list[list[int]], toxic: np.ndarray, fold: np.ndarray, features: int) -> np.ndarray:
    """Grades from 0: toxic rows at equal shares of the scores that models of the other folds give them. Without toxic and other rows outside every fold, all toxic rows have grade 1."""
    scores = np.zeros(len(rows))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(toxic[rest].tolist())) < 2:
            return toxic.copy()
        w, _ = fit([rows[i] for i in rest], toxic[rest], features, steps=300)
        scores[own] = [w[rows[i]].sum() for i in own]
    order = scores[toxic == 1]
    cuts = np.quantile(order, np.arange(1, GRADES) / GRADES)
    grade = toxic.copy()
    grade[toxic == 1] += np.searchsorted(cuts, order, side="left")
    return np.searchsorted(np.unique(grade), grade)  # grades that nothing has are left out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """labels: id, toxic (0 or 1). Fits on the labelled documents of the sample."""
    chosen = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = stored(chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")), "toxicity-sample")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features_of(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["toxic", "fold", "words"])

    texts = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "id").select("toxic", "fold", "text")  # at most `sample` rows
    bags = stored(labelled.mapInArrow(bag, "toxic int, fold int, words array<string>"), "toxicity-bags")
    n, toxic = bags.agg(F.count(F.lit(1)), F.sum((F.col("toxic") > 0).cast("long"))).first()
    if not n or not toxic or toxic == n:
        return OrdinalModel({}, [])
    p = toxic / n
    each = bags.select(F.explode("words").alias("word"), (F.col("toxic") > 0).cast("long").alias("toxic")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    z = F.abs(F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    best = each.where(F.col("n") >= max(LEAST_DOCS, LEAST_PART * n)).withColumn("z", z).where(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), "word").limit(FEATURES)
    vocabulary = [r["word"] for r in best.collect()]
    if not vocabulary:
        return OrdinalModel({}, [])
    number = {w: i for i, w in enumerate(vocabulary)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[number[w] for w in words.as_py() if w in number] for words in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "fold", "found"])

    kept = sorted((r["toxic"], r["fold"], sorted(r["found"])) for r in bags.mapInArrow(numbered, "toxic int, fold int, found array<int>").collect())  # at most `sample` rows of known words
    rows, is_toxic, fold = [r[2] for r in kept], np.array([int(r[0] > 0) for r in kept]), np.array([r[1] for r in kept])
    weights, thetas = fit(rows, graded(rows, is_toxic, fold, len(vocabulary)), len(vocabulary))
    return OrdinalModel(dict(zip(vocabulary, weights.tolist(), strict=True)), thetas.tolist())


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, the columns of `carry`, severity (expected grade), chance (of any), grade (the likeliest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, chance, grade = [], [], []
            for cell in batch.column(0):
                above = model.at_least(features_of(cell.as_py()))
                each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
                severity.append(float(sum(above)))
                chance.append(above[0] if above else 0.0)
                grade.append(max(range(len(each)), key=each.__getitem__))
            columns = [pa.array(severity, pa.float64()), pa.array(chance, pa.float64()), pa.array(grade, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "severity", "chance", "grade"])

    rows = docs.select(whole(docs[text_col]).alias("scored_text"), docs[id_col].alias("id"), *(c.alias(n) for n, c in (carry or {}).items()))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kept}, severity double, chance double, grade int")


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of docs whose chance of any severity stays below REJECT, unchanged. Rows cross to Python once, whatever their columns are named."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = (model.at_least(features_of(cell.as_py() or "")) for cell in batch.column(at))
            yield batch.filter(pa.array([not a or a[0] < REJECT for a in above], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxic_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, toxic_labels(table(spark, sf_dir, "labels"))))
    return found.select(F.col("id").alias("doc_id"), "severity", "grade", (F.col("chance") >= REJECT).alias("toxic"))
