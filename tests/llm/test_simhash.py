import random

import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import simhash
from folioforge.operators.graph import components
from tests.llm.fixtures import edge_docs, empty_docs, words


def by_hand(text, n=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50):
        text = words(rng, n, "abÉÀZ").replace(" ", rng.choice([" ", "\n", " \t", "  "]))
        assert simhash.fingerprint(text, 3) & (2**64 - 1) == by_hand(text)
    assert simhash.fingerprint("A  b\tC d", 3) == simhash.fingerprint("a b c D", 3)


def groups(fps, bits):
    """Smallest index that links reach, by brute force."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("crowd", [2, 24])
def test_components_equal_brute_force(spark, bits, crowd):
    rng = random.Random(bits * 100 + crowd)
    fps = []
    for _ in range(25):  # clusters: chains and crowds of close fingerprints, some of them just too far
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.append(x)
            if rng.random() < 0.3:
                base = x
    fps += fps[:10]
    signed = [simhash.signed(x) for x in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    nodes = df.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(simhash.links(nodes.select("fp"), bits, crowd))
    root_of = {r.node: r.root for r in roots.collect()}
    first = {r.fp: r["first"] for r in nodes.collect()}
    least = {}
    for fp, i in first.items():
        r = root_of.get(fp, fp)
        least[r] = min(i, least.get(r, i))
    assert [least[root_of.get(x, x)] for x in signed] == groups(fps, bits)


@pytest.mark.parametrize("bits", [2, 3])
def test_a_crowded_key_is_split_by_its_other_bits(spark, bits):
    rng = random.Random(bits)
    ring = simhash.Ring(bits)
    key = ring.keys[4] & (2**64 - 1)
    fixed = rng.getrandbits(64) & key
    fps = [fixed | rng.getrandbits(64) & ~key for _ in range(200)]  # all share a key, few are close
    fps += [x ^ 1 << next(i for i in range(64) if not key >> i & 1) for x in fps[:40]]
    df = spark.createDataFrame([(simhash.signed(x),) for x in dict.fromkeys(fps)], "fp long")
    found = simhash.links(df, bits)
    want = {tuple(sorted((simhash.signed(x), simhash.signed(y)))) for i, x in enumerate(fps) for y in fps[:i] if 0 < (x ^ y).bit_count() <= bits}
    assert {(r.a, r.b) for r in found.collect()} == want  # pairs, not points


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    fps = [by_hand(r.text or "") for r in rows]
    want = {(r.doc_id, f"{fp:016x}", rows[g].doc_id) for r, fp, g in zip(rows, fps, groups(fps, 2))}
    assert {tuple(r) for r in simhash.op8_simhash(spark, d).collect()} == want


def test_edges(spark):
    rows = simhash.near_duplicates(edge_docs(spark)).collect()
    found = {r.id: (r.fp, r.component_id) for r in rows}
    assert len(rows) == 10 and found[1] == found[2] == found[3] == (0, 1) and found[4] == found[5] and found[7][1] == 6
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
