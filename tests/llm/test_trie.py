import hashlib
import random
import zlib

import pytest

from folioforge.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string, block string, place string"


def frame(spark, rows):
    """Turns with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [t for _, t in sorted(ts, key=lambda t: t[0])] for c, ts in convs.items()}
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = convs.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])
        whole = (*base[:h], *own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, d == len(whole)))
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def below(node):
        found = [node]
        for n in found:
            found += kids.get(n, [])
        return found

    out = []
    for node, of in members.items():
        under = below(node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = ",".join(map(str, sorted(c for c, end in of if end)))
        out.append((min(of)[0], len(node), min(members[node[:-1]])[0] if node else None, len(of), len(kids.get(node, [])), sum(n not in kids for n in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def conversations():
    rng = random.Random(10)
    rows = []
    for c in [*range(25), *range(100, 125), 200, 305, 306, 990, -3, -150]:
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yes", "no", "é\U0001f600"])) for t in range(rng.choice([1, 2, 2, 3, 7]))]
    rows += [(7, None, None, None), (7, None, "user", None), (8, 1, "user", "tie"), (8, 1, "bot", "tie"), (8, 1, "bot", "tie"), (None, 0, "user", "hi"), (3, None, "", "")]
    rows += [(400 + i, t, "user", "the same") for i in range(12) for t in range(4)]  # a group of copies
    return rows


def test_nodes_equal_brute_force(spark):
    rows = conversations()
    assert got(trie.prefix_trie(frame(spark, rows).repartition(3))) == brute(rows)


@pytest.mark.parametrize("heavy", [1, 8, 10**6])
def test_a_long_conversation_over_many_blocks(spark, monkeypatch, heavy):
    """One conversation holds most rows, and pointers meet by shuffle, by broadcast and by both."""
    monkeypatch.setattr(trie, "HEAVY", heavy)
    rng = random.Random(11)
    rows = [(1, t, "user", rng.choice("ab")) for t in range(40)] + [(c, t, "user", "a") for c in (100, 101, 205) for t in range(9)]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_identifiers_in_many_pieces(spark):
    ends = [(1, 5, 6, c) for c in range(50)] + [(2, 7, 8, 3), (2, 7, 9, -4), (2, 7, 9, 11)]
    found = trie.ends_digests(spark.createDataFrame(ends, "depth long, a long, b long, conv long"), piece=5)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got(found) == sorted([(1, 5, 6, digest(range(50))), (2, 7, 8, digest([3])), (2, 7, 9, digest([-4, 11]))], key=str)


def test_an_empty_table_and_one_without_turns_of_its_own(spark):
    assert got(trie.prefix_trie(frame(spark, []))) == []
    alone = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 and c % 100)
    assert got(trie.prefix_trie(frame(spark, [(alone, 0, "user", "x")]))) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert common.HEAVY == trie.HEAVY
