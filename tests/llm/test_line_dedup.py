import random

import duckdb
import pytest

import corpus_pipeline
from folioforge.llm import line_dedup
from tests.llm.fixtures import docs, edge_docs, empty_docs


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts, near=line_dedup.NEAR_CHARS):
    seen, out = [], []
    for t in texts:
        kept = []
        for i, line in enumerate((t or "").split("\n")):
            if not line.strip(" "):
                kept.append(i)
                continue
            if line not in seen:
                if len(line) < near or not any(within_one(line, s) for s in seen if len(s) >= near):
                    kept.append(i)
                seen.append(line)
        out.append(kept)
    return out


def edited(rng, line):
    i, c = rng.randrange(len(line)), rng.choice("xyé")
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + c + line[i:], line[:i] + c + line[i + 1 :], line])


@pytest.mark.parametrize("filter_bits", [line_dedup.FILTER_BITS, 64])  # a full bitmap lets everything through
def test_decisions_equal_brute_force(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", filter_bits)
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcé ", k=rng.choice([14, 15, 16, 17, 31, 32, 33, 64, 200]))) for _ in range(60)]
    texts = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool)
            for _ in range(rng.randint(0, 2)):
                line = edited(rng, line)
            lines.append(line)
        texts.append("\n".join(lines))
    texts += ["counter line number %05d of the log" % i for i in range(150)]
    got = {r.id: r.kept for r in line_dedup.dedup_decisions(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_text_and_edges(spark):
    a, b = "a line that is long enough to count", "another line that is long enough too"
    given = docs(spark, [f"{a}\nshort\n\n{b}", f"{a}\nshort", f"{a}!\n{b}", None, "", f"{b}\nsomething else that nobody has said"])
    got = {r.doc_id: (r.text, r.source) for r in line_dedup.dedup_text(given, min_chars=16).collect()}
    assert got == {0: (f"{a}\nshort\n\n{b}", "s"), 1: ("short", "s"), 3: (None, "s"), 4: ("", "s"), 5: ("something else that nobody has said", "s")}
    edge = edge_docs(spark)
    assert line_dedup.dedup_decisions(edge).count() == 10
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in line_dedup.dedup_text(edge).collect())
    assert [k[1] for k in kept] == [1, 2, 3, 4, 6, 8, 0]  # 5 and 7 hold nothing but what came before
    assert line_dedup.dedup_text(edge).columns == edge.columns
    assert line_dedup.dedup_text(empty_docs(spark)).count() == 0 and line_dedup.dedup_decisions(empty_docs(spark)).count() == 0


def test_exact_repeats_of_short_lines_go(spark):
    given = docs(spark, ["yes\n\nno", "yes\nnot\n", "a line that is long enough to count", "a line that is long enough to count!\nno", "fifteen charact", "fifteen charact1"])
    got = {r.id: r.kept for r in line_dedup.dedup_decisions(given).collect()}
    assert got == {0: [0, 1, 2], 1: [1, 2], 2: [0], 3: [], 4: [0], 5: [0]}


def test_pipeline_keeps_no_short_repeat(spark):
    given = docs(spark, ["yes\nno", "yes\nnot"])
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, given, "").collect()} == {0: ("yes\nno", 6), 1: ("not", 3)}


def test_query_equals_its_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    got = [tuple(r) for r in line_dedup.op9_line_dedup(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(duckdb.sql(line_dedup.SQL).fetchall())
