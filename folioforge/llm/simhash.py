"""SimHash near-duplicate detection with pigeonring candidates and distributed components.

Fingerprints within b bits are found by cutting 64 bits into b + 1 consecutive segments on a ring. If two fingerprints
differ in b bits or fewer, some segment starts a chain along the ring in which the first l segments together differ in
at most l * b / (b + 1) bits, for every l: the first not at all, the first two in one bit at most, and so on. So
candidates are looked up by the first segment and the second one without one of its three parts (one bit can spoil
only one part); the longer chains prune them, and then the full Hamming distance decides.

A bucket of many different fingerprints is not paired up. It is split by the bits outside its key, cut into b + 1 parts of
which a pair shares one. Where that leaves a crowd, which only fingerprints close to each other make, the members are linked
through the points between them instead: two fingerprints are within b bits exactly if some point is within b // 2 bits of one and the rest of b bits
of the other, so everything near a point is linked to one fingerprint there, which loses no connection. Links then
become components by alternating large-star and small-star steps on stored tables. Joins on a fingerprint that many
documents have, or on a node of many links, rely on adaptive execution to split the skewed side.

Defined results: null texts count as empty; a text without words has fingerprint 0 and is linked like any other. Shorter
texts than a shingle are one shingle. Null identifiers lose against others as a component's name. Repeated rows share
their fingerprint and so their component. An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import spread_table, stored, whole
from folioforge.operators.graph import components

#: Fingerprints in a bucket that are still compared in pairs.
CROWD = 24
#: Parts of a chain's second segment, one of which is left out of the key.
PARTS = 3
#: Shingle hashes whose bits are counted at once.
PORTION = 32_768


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, words: int) -> int:
    """The fingerprint of a text as a signed 64-bit number: XXH64 (seed 42) of word shingles, majority by bit."""
    found = text.encode("utf-8", "replace").lower().split()  # on bytes: ASCII case and ASCII white space only
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in found))
    n = max(1, len(found) - words + 1)
    starts = [0, *ends[: n - 1]]
    stops = ends[min(words, len(found)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, PORTION):
        h = np.array([hashed(joined[a : b - 1], 42) for a, b in zip(starts[i : i + PORTION], stops[i : i + PORTION], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(cell.as_py(), words) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class Ring:
    """The masks of b + 1 segments: keys[k] for lookup, chains[l][k] for the first l + 1 segments from a key's start, rests[p][k] for part p of what is outside the key."""

    def __init__(self, bits: int):
        m = bits + 1
        cuts = [round(64 * i / m) for i in range(m + 1)]
        ones = lambda a, b: ((1 << (b - a)) - 1) << a
        segments = [ones(cuts[i], cuts[i + 1]) for i in range(m)]
        self.keys, self.chains = [], [[] for _ in range(m)]
        for i in range(m):
            j = (i + 1) % m
            part = [round(cuts[j] + (cuts[j + 1] - cuts[j]) * p / PARTS) for p in range(PARTS + 1)]
            for p in range(PARTS):
                self.keys.append(signed(segments[i] | segments[j] & ~ones(part[p], part[p + 1])))
                for length in range(m):
                    self.chains[length].append(signed(sum(segments[(i + x) % m] for x in range(length + 1))))
        self.rests = []
        for p in range(m):
            self.rests.append([])
            for key in self.keys:
                free = [i for i in range(64) if not key >> i & 1]
                self.rests[p].append(signed(sum(1 << i for i in free[len(free) * p // m : len(free) * (p + 1) // m])))
        self.budgets = [(length + 1) * bits // m for length in range(m)]

    def passes(self, x: Column, k: Column) -> Column:
        """Whether differing bits x keep within the budget of every chain from key k, the full distance last."""
        checks = [F.bit_count(x.bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), k + 1))) <= most for masks, most in zip(self.chains, self.budgets, strict=True)]
        out = checks[0]
        for c in checks[1:]:
            out = out & c
        return out


def balls(fp: Column, radius: int) -> Column:
    """All points within so many bits (0 to 2) of a fingerprint."""
    flips = [0] + [1 << i for i in range(64)] * (radius > 0) + [1 << i | 1 << j for i in range(64) for j in range(i)] * (radius > 1)
    return F.transform(F.array(*[F.lit(signed(x)) for x in flips]), lambda x: fp.bitwiseXOR(x))


def _shared(keyed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, fp, n: the fingerprints that share a key with another, and how many do. keyed: keys, fp."""
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(keyed.join(sizes, keys), name)


def _pairs(few: DataFrame, keys: list[str], ring: Ring) -> DataFrame:
    """a, b: pairs within a key whose chains keep their budgets."""
    a, b = few.select(*keys, F.col("fp").alias("a")), few.select(*keys, F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    return a.join(b, keys).where((F.col("a") < F.col("b")) & ring.passes(x, F.col("k"))).select("a", "b")


def links(distinct: DataFrame, bits: int, crowd: int = CROWD) -> DataFrame:
    """a, b: links whose components are those of all pairs of different fingerprints within `bits` bits. distinct: fp."""
    if not 1 <= bits <= 3:
        raise ValueError("bits must be 1 to 3")
    ring, fp = Ring(bits), F.col("fp")
    keys = F.array(*[F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(ring.keys)])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("key.k", "key.v", "fp")
    shared = _shared(keyed, ["k", "v"], "simhash-shared")
    # A crowd that only shares a key parts by its other bits; one that stays a crowd is close together.
    parts = F.array(*[F.struct(F.lit(p).alias("p"), fp.bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("k") + 1)).alias("w")) for p, masks in enumerate(ring.rests)])
    split = shared.where(F.col("n") > crowd).select("k", "v", "fp", F.explode(parts).alias("part")).select("k", "v", "part.p", "part.w", "fp")
    narrow = _shared(split, ["k", "v", "p", "w"], "simhash-narrow")
    pairs = _pairs(shared.where(F.col("n") <= crowd), ["k", "v"], ring).unionByName(_pairs(narrow.where(F.col("n") <= crowd), ["k", "v", "p", "w"], ring))
    many = narrow.where(F.col("n") > crowd).select("fp").distinct()
    near = many.select("fp", F.explode(balls(fp, bits // 2)).alias("point"))
    hubs = near.groupBy("point").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n"))
    if bits % 2:
        far = many.select("fp", F.explode(balls(fp, bits // 2 + 1)).alias("point"))
    else:
        far, hubs = near, hubs.where("n > 1")
    stars = far.join(hubs, "point").where("fp != hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, fp, component_id (the smallest identifier that links reach)."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), bits, crowd)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread_table(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
