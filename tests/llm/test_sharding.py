import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import xxhash

from folioforge.llm import sharding
from tests.llm.fixtures import docs, edge_docs, empty_docs, words


def laws(rows, source, shards):
    texts = defaultdict(list)
    for r in source:
        texts[r.doc_id].append(r.text or "")
    assert len(rows) == len(source)
    for r in rows:
        assert any((r.size, r.crc) == (len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.id])
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_loads_are_bounded_and_copies_stay_together(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(20, 60)) for _ in range(3000)] + ["one text that many share " * 4] * 120
    given = docs(spark, texts)
    rows = sharding.shard(given, 8).collect()
    laws(rows, given.collect(), 8)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    mean = sum(load.values()) / 8
    assert max(load.values()) <= (1 + sharding.SLACK) * mean and min(load.values()) >= 0.98 * mean
    of = defaultdict(set)
    for r in rows:
        of[texts[r.id]].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_a_third_of_all_rows_in_one_group_is_dealt_out(spark):
    rng = random.Random(2)
    texts = [words(rng, 30) for _ in range(2000)] + [words(rng, 30)] * 1000
    rows = sharding.shard(docs(spark, texts), 8).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.03 * sum(load.values()) / 8


def test_a_group_that_fits_a_shard_stays_whole(spark):
    rng = random.Random(4)
    texts = [words(rng, 30) for _ in range(2000)] + [words(rng, 30)] * 250 + [words(rng, 30)] * 190
    rows = sharding.shard(docs(spark, texts), 8).collect()
    load, of = Counter(), defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        of[texts[r.id]].add(r.shard)
    assert max(load.values()) <= 1.01 * sum(load.values()) / 8 and all(len(s) == 1 for s in of.values()) and not any(r.split for r in rows)


def test_one_more_shard_moves_little(spark):
    rng = random.Random(5)
    given = docs(spark, [words(rng, rng.randint(5, 60)) for _ in range(4000)])
    a, b = ({r.id: (r.shard, r.size) for r in sharding.shard(given, n).collect()} for n in (8, 9))
    moved = sum(size for i, (s, size) in a.items() if b[i][0] != s) / sum(size for _, size in a.values())
    assert moved < 0.25  # the ideal is 1 of 9; dealing anew by hash modulo would move 8 of 9


def test_query(spark):
    d = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{d}/documents.parquet").collect()
    rows = sharding.op3_sharding(spark, d).collect()
    laws([SimpleNamespace(id=r.doc_id, size=r.size, crc=r.text_crc32, shard=r.shard, slot=r.slot) for r in rows], source, 8)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_reruns_agree_and_edges(spark):
    given = edge_docs(spark)
    a, b = (sorted(map(str, sharding.shard(given, 8).collect())) for _ in range(2))
    assert a == b
    laws(sharding.shard(given, 8).collect(), given.collect(), 8)
    assert sharding.shard(empty_docs(spark), 8).count() == 0


def test_the_ring_goes_on_clockwise():
    ring = sharding.Ring(4)
    load = [0] * 4
    placed = sharding.place([(7, 1)] * 8, ring, load, 2)
    assert placed == [s for s in ring.clockwise(7) for _ in range(2)]


def by_hand(source, shards):
    """(id, crc) -> shard, slot, split: the ring walked node by node, a row at a time."""
    hashed = lambda data, seed=42: (x := xxhash.xxh64_intdigest(data, seed)) - (x >> 63 << 64)
    both = lambda a, b: hashed(struct.pack("<q", b), hashed(struct.pack("<q", a)) % 2**64)
    rows = []
    for r in source:
        data = (r.text or "").encode()
        h = hashed(data)
        rows.append(SimpleNamespace(id=r.doc_id, crc=zlib.crc32(data), size=len(data) + 1, h=h, cell=h % sharding.CELLS))
    nodes = {}
    for s in range(shards):
        for v in range(sharding.VIRTUAL):
            nodes.setdefault(int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") % sharding.CELLS, s)
    load, mean = [0] * shards, sum(r.size for r in rows) / shards

    def next_with_room(cell, size):
        for step in range(sharding.CELLS):
            s = nodes.get((cell + step) % sharding.CELLS)
            if s is not None and load[s] + size <= (1 + sharding.SLACK) * mean:
                return s
        return None

    def put(members, s):
        s = load.index(min(load)) if s is None else s
        load[s] += sum(r.size for r in members)
        for r in members:
            r.shard = s

    groups, cells, split = defaultdict(list), defaultdict(list), []
    for r in rows:
        r.split = False
        groups[r.h].append(r)
    unit = max(1.0, sharding.HEAVY * mean)
    for size, h in sorted((-sum(r.size for r in g), h) for h, g in groups.items()):
        if -size < unit:
            for r in groups[h]:
                cells[r.cell].append(r)
        elif (s := next_with_room(groups[h][0].cell, -size)) is None:
            split.append((h, math.ceil(-size / unit)))
        else:
            put(groups[h], s)
    pieces = defaultdict(list)
    for h, n in split:
        for r in groups[h]:
            r.split = True
            pieces[h, both(r.id, h) % n, n].append(r)
    for size, h, s, n in sorted((-sum(r.size for r in p), *key) for key, p in pieces.items()):
        put(pieces[h, s, n], next_with_room((pieces[h, s, n][0].cell + s * sharding.CELLS // n) % sharding.CELLS, -size))
    for cell in sorted(cells):
        put(cells[cell], next_with_room(cell, sum(r.size for r in cells[cell])))
    slots = Counter()
    for r in sorted(rows, key=lambda r: (both(r.h, r.id) % sharding.SLOT_BUCKETS, r.id, r.h)):
        r.slot = slots[r.shard]
        slots[r.shard] += 1
    return {(r.id, r.crc, r.shard, r.slot, r.split) for r in rows}


def test_query_by_hand(spark):
    d = "/root/testdata/sf0.001"
    rows = sharding.op3_sharding(spark, d).collect()
    want = by_hand(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect(), 8)
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot, r.split) for r in rows} == want and len(rows) == len(want)


def test_groups_placed_whole_and_in_pieces_by_hand(spark):
    rng = random.Random(6)
    given = docs(spark, [words(rng, 30) for _ in range(1500)] + [words(rng, 30)] * 900 + [words(rng, 30)] * 200 + [None, ""] * 20)
    rows = sharding.shard(given, 8).collect()
    want = by_hand(given.collect(), 8)
    assert {(r.id, r.crc, r.shard, r.slot, r.split) for r in rows} == want and {r.split for r in rows} == {True, False}
