import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from folioforge.llm import bpe, mixing, simhash, toxicity
from folioforge.llm.common import table
from tests.llm.fixtures import edge_docs, empty_docs

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = table(spark, D, "documents"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        if i < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        kept.append((name, before, docs))
    by = {name: (a.collect(), b.collect()) for name, a, b in kept}
    a, b = by["toxicity"]
    assert {(r.doc_id, r.text) for r in b} <= {(r.doc_id, r.text) for r in a} and 0.5 * len(a) < len(b) < len(a)
    a, b = by["lines"]
    lines = [x for r in b for x in r.text.split("\n") if x.strip(" \t\n\v\f\r")]
    assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in b)
    a, b = by["near_duplicates"]
    fps = {r.doc_id: simhash.fingerprint(r.text, corpus_pipeline.SHINGLE_WORDS) & (2**64 - 1) for r in a}
    stay = sorted(r.doc_id for r in b)
    root = {i: i for i in fps}
    for i in sorted(fps):
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= corpus_pipeline.BITS:
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert stay == sorted(set(root.values()))
    a, b = by["mix"]
    size = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    want = {r.source: r.taken for r in mixing.mix(kept[3][1]).groupBy("source").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    assert size(b) == {s: n for s, n in want.items() if n}
    a, b = by["tokens"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = sorted((r.doc_id, hashlib.sha256(",".join(map(str, enc.encode_ordinary(r.text))).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in a)
    assert ids == sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in b)
    assert toxicity.REJECT == 0.5


CLASHING = ("id", "stays", "stays_", "taken", "piece", "place", "row", "size", "shares", "mixed_size", "h", "fp", "component_id", "__text", "_word", "kept", "at")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_stages_bear_edges_and_clashing_names(spark, name, stage, rows):
    docs = edge_docs(spark) if rows == "edge" else empty_docs(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[(docs["doc_id"] * 7).cast("string").alias(c) for c in CLASHING])
    given, out = docs.collect(), stage(spark, docs, D).collect()
    if rows == "empty":
        assert out == []
    if name == "tokens":
        assert len(out) == len(given) and [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0][: len(out)]
        return
    assert stage(spark, docs, D).columns == docs.columns
    assert all(r[c] == (None if r.doc_id is None else str(7 * r.doc_id)) for r in out for c in CLASHING)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    ids = [i for none, i in ids if not none] + [None] * sum(none for none, _ in ids)
    if rows == "edge":
        if name == "toxicity":
            assert len(out) == len(given)  # nothing toxic here, and nothing else goes
        if name == "lines":
            assert ids == [1, 2, 3, 4, 6, 8, None] and {r.text for r in out if r.doc_id == 1} == {None}
        if name == "near_duplicates":
            assert ids == [1, 4, 6, 8, None]
        if name == "mix":
            words = {r.source: 0 for r in given}
            for r in out:
                words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            want = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
            assert words == want and {1, 2, 3} <= set(ids)


def test_rows_that_repeat_share_what_the_mix_takes(spark):
    docs = spark.createDataFrame([(1, "one two three four", "en", "a", 18)] * 5 + [(2, "w " * 40, "en", "b", 80)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, docs, D).collect()
    words = sum(len(r.text.split()) for r in out if r.doc_id == 1)
    assert words == sum(r.taken for r in mixing.mix(docs).where("id = 1").collect())
