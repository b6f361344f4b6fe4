import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm import language
from tests.llm.fixtures import edge_docs, empty_docs


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = language.op2_language(spark, d).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_short_texts(spark):
    """Three words are enough for nine of ten, in documents that training has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null").select("doc_id", "text", "lang")
    known = language.learn(docs.where("doc_id % 5 > 0").select("text", "lang"))
    short = docs.where("doc_id % 5 = 0 and size(split(text, ' ')) > 20").select("doc_id", "lang", F.array_join(F.slice(F.split("text", " "), 11, 3), " ").alias("text"))
    rows = language.identify(short, known, carry={"lang": F.col("lang")}).where("lang_pred != 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)


def test_a_bundle_is_the_sum_of_bound_letter_vectors():
    import numpy as np

    space = language.Space(64)
    grams = space.grams("Ab, c")
    letters = [0, *(ord(c) % (language.LETTERS - 1) + 1 for c in "ab"), 0, ord("c") % (language.LETTERS - 1) + 1, 0]
    by_hand = sum(np.roll(space.c[a], 2) * np.roll(space.c[b], 1) * space.c[c].astype(int) for a, b, c in zip(letters, letters[1:], letters[2:]))
    assert (space.bundle(np.zeros(len(grams), int), grams, 1)[0] == by_hand).all()


def test_edges(spark):
    docs = edge_docs(spark)
    known = language.learn(docs.where("text is not null and lang is not null").select("text", "lang"))
    assert sorted(known) == ["de", "en", "fr"]
    got = {(r.id, r.lang_pred, r.score > 0) for r in language.identify(docs, known).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False)} <= got and (8, "fr", True) in got
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(empty_docs(spark), known).count() == 0
    assert language.learn(docs.limit(0).select("text", "lang")) == {}
    assert language.identify(docs, known, carry={"held_out": F.lit(True)}).columns == ["id", "held_out", "lang_pred", "score"]


def test_query_by_hand(spark):
    """Every prediction and score of the query, from trigrams counted text by text and cosines taken one by one."""
    d, table = "/root/testdata/sf0.001", language.Space(language.DIMENSIONS).c.astype(np.int64)
    source = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()
    row = lambda c: table[0 if c == " " else ord(c) % (language.LETTERS - 1) + 1]
    vectors = {}

    def vector(gram):
        if gram not in vectors:
            a, b, c = gram
            vectors[gram] = np.roll(row(a), 2) * np.roll(row(b), 1) * row(c)
        return vectors[gram]

    def bundle(text):
        letters = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        letters = re.sub(" +", " ", letters)
        counts = Counter(zip(letters, letters[1:], letters[2:])) if letters.strip() else {}
        return sum((n * vector(g) for g, n in counts.items()), np.zeros(language.DIMENSIONS, np.int64))

    bundles, known = [bundle(r.text) for r in source], defaultdict(int)
    for r, v in zip(source, bundles, strict=True):
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.text is not None and r.lang is not None:
            known[r.lang] = known[r.lang] + v
    got = {r.doc_id: r for r in language.op2_language(spark, d).collect()}
    assert len(got) == len(source)
    for r, v in zip(source, bundles, strict=True):
        near = {n: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for n, p in known.items()} if v.any() else {"und": 0.0}
        told = got[r.doc_id]
        assert abs(near[told.lang_pred] - max(near.values())) < 1e-6 and abs(told.score - max(0.0, near[told.lang_pred])) < 1e-6
