import random
import re

import numpy as np
import pytest

from folioforge.llm import leaks
from tests.llm.fixtures import docs, edge_docs, empty_docs

ITEMS = "item_id long, text string, row string, item string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], ITEMS)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, rows, window):
    """n_words, n_hit, items, (length, doc_word, item, item_word) of each text."""
    tests = sorted({(None if i is None else str(i), t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or "", r[1] or ""))
    tests = [(i, words_of(t)) for i, t in tests]
    out = []
    for text in texts:
        w = words_of(text)
        hit, names, places = set(), set(), set()
        for i, t in tests:
            n = min(window, len(t))
            for k in range(len(t) - n + 1 if t else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == t[k : k + n]:
                        hit.update(range(p, p + n))
                        names.add(i)
                        places.add(p)
        best = None
        for p in sorted(places):
            for i, t in tests:
                for k in range(len(t) - min(window, len(t)) + 1 if t else 0):
                    n = 0
                    while p + n < len(w) and k + n < len(t) and w[p + n] == t[k + n]:
                        n += 1
                    if n >= min(window, len(t)) and (best is None or n > best[0]):
                        best = (n, p, i, k)
        out.append((len(w), len(hit), sorted(n for n in names if n is not None), best))
    return out


def got(found, key="doc_id"):
    told = lambda r: (r.n_words, r.n_hit, list(r["items"]), r.longest and (r.longest["length"], r.longest.doc_word, r.longest["item"], r.longest.item_word))
    return sorted(((r.row, *told(r)) for r in found.collect()), key=str)


def cases():
    rng = random.Random(8)
    some = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    rows = [(i, some(rng.randint(0, 14), "abc")) for i in range(12)] + [(3, "x y z"), (None, "q r s t"), (20, None), (21, "A-b. C\nÉ"), (21, "A-b. C\nÉ"), (22, "a " * 12)]
    texts = [some(rng.randint(0, 40), "abcd") for _ in range(25)] + ["a " * 30, "Q R s!t", "x,y;Z x y z", "a b c É", "é a b c", None, "", "  ,.", some(300, "abc")]
    return rows, texts


@pytest.mark.parametrize(("window", "shard", "block"), [(4, 10**6, 10**6), (10, 20, 10**6), (4, 1, 60)])
def test_scan_equals_brute_force(spark, window, shard, block):
    rows, texts = cases()
    given = docs(spark, texts).repartition(2)
    found = leaks.scan(given, items(spark, rows), given["doc_id"], window=window, shard_words=shard, block_chars=block)
    assert got(found) == sorted(((i, *w) for i, w in enumerate(brute(texts, rows, window))), key=str)
    for r in found.collect():
        assert r.n_hit == sum(r.ends) - sum(r.starts) and list(r.starts) == sorted(r.starts)


def test_a_suffix_array_orders_suffixes():
    rng = random.Random(9)
    for letters, n in (("12", 60), ("1", 40), ("0123", 80), ("0", 5)):
        ids = np.array([int(rng.choice(letters)) for _ in range(n)] + [0], dtype=np.int32)
        order = leaks.suffix_array(ids, n + 1)
        known = lambda p: [int(x) for x in ids[p:]][: next(k for k, x in enumerate(ids[p:]) if x == 0)]  # noqa: B023, E731
        assert sorted(order) == [p for p in range(len(ids)) if ids[p] > 0]
        assert [known(p) for p in order] == sorted(known(p) for p in order)


def test_edges_and_empty_tables(spark):
    rows, _ = cases()
    edge = edge_docs(spark)
    texts = [r.text for r in edge.collect()]
    rows = [*rows, (7, "same words are here for"), (8, " ".join(f"w{i % 977}" for i in range(500, 1500)))]
    found = leaks.scan(edge, items(spark, rows), edge["doc_id"], window=5, shard_words=50)
    by_text = {t: b for t, b in zip(texts, brute([t if t is None or len(t) < 10**4 else t[:100] for t in texts], rows, 5), strict=True)}
    for r in found.collect():
        if r.row not in (4, 5):
            assert (r.row, r.n_words, r.n_hit, list(r["items"])) in [(e.doc_id, *by_text[e.text][:3]) for e in edge.collect()]
        else:  # 60,000 words of which the item's thousand repeat throughout
            assert (r.n_words, r.n_hit, r.longest["length"], r.longest["item"]) == (60_000, 60_000, 1000, "8")
    for given, tests in ((empty_docs(spark), items(spark, rows)), (edge, items(spark, [])), (edge, items(spark, [(1, None), (2, " .")]))):
        assert all(r.n_hit == 0 and not r["items"] and r.longest is None for r in leaks.scan(given, tests, given["doc_id"]).collect())
    clean = leaks.clean(edge, items(spark, rows), window=5)
    assert clean.columns == edge.columns and sorted(map(str, clean.collect())) == sorted(str(r) for r in edge.collect() if by_text[r.text][1] == 0 and r.doc_id not in (4, 5))


def test_characters_part_words_as_said():
    every = "".join(map(chr, range(0x250))) + "漢　字\U0001f600 z"
    assert [w.decode() for w in leaks.words(every.encode()) if w] == words_of(every)
