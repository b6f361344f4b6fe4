import hashlib
import math
import random

import pytest

from folioforge.llm import codes, common

SCHEMA = "vec_id long, embedding array<double>, label int, pos int, part string, row string, n long"


def frame(spark, rows):
    """Vectors with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, v, y, 1, "x", "x", 1) for i, v, y in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """id, code, error, label_error of each vector that takes part, and the books by length and part."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    books, found = {}, []
    for dim in {len(v) for _, v, _ in kept}:
        mine = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        for p, (start, width) in enumerate(codes.cuts(dim, parts)):
            all_parts = [v[start : start + width] for _, v, _ in mine]
            book = all_parts[:entries]
            least = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))  # noqa: B023, E731
            for _ in range(rounds):
                owners = [least(x)[1] for x in all_parts]
                means = []
                for k, e in enumerate(book):
                    of = [x for x, o in zip(all_parts, owners, strict=True) if o == k]
                    means.append([sum(c) // len(of) for c in zip(*of, strict=True)] if of else e)
                book = means
            books[dim, p] = (book, [least(x) for x in all_parts])
        for j, (i, _, y) in enumerate(mine):
            told = [books[dim, p][1][j] for p in range(parts)]
            found.append((i, "".join(f"{k:02x}" for _, k in told), sum(e for e, _ in told), y))
    total = lambda y: sum(r[2] for r in found if r[3] == y)
    return sorted(((i, c, e, total(y)) for i, c, e, y in found), key=str), {key: b for key, (b, _) in books.items()}


def got(df):
    return sorted(((r.id, r.code, r.error, r.label_error) for r in df.collect()), key=str)


def check(spark, rows, **options):
    found, books = codes.compress(frame(spark, rows), **options)
    want, want_books = brute(rows, **options)
    assert got(found) == want
    assert {key: b.tolist() for key, b in books.items()} == want_books
    return books


def test_vectors_of_every_kind(spark):
    rng = random.Random(5)
    vector = lambda d: [round(rng.uniform(-1, 1), 2) for _ in range(d)]
    rows = [(i, vector(16), rng.choice([0, 1, None])) for i in range(90)]
    rows += [(i, rows[0][1], 0) for i in range(90, 140)]  # a vector that a third of the rows have
    rows += [(3, rows[3][1], 1), (3, vector(16), 1), (None, vector(16), 1), (200, None, 1), (201, [0.5, None] * 8, 1), (202, [float("nan")] * 16, 0), (203, [float("inf")] + [0.0] * 15, 0)]
    rows += [(300 + i, vector(10), 2) for i in range(9)] + [(400, [], 3), (401, [], 3), (500, [1.0, -1.0], 4), (-1, [0.25] * 2, 4)]
    books = check(spark, rows)
    found = codes.compress(frame(spark, rows))[0]
    assert found.count() == len(rows) - 4
    assert codes.books_sha256(books, 16, 8) == hashlib.sha256(",".join(str(x) for p in range(8) for e in books[16, p].tolist() for x in e).encode()).hexdigest()


def test_few_parts_entries_and_rounds(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30), [rng.choice([-1.0, 0.0, 0.1]) for _ in range(5)], None) for _ in range(60)]
    check(spark, rows, parts=3, entries=4, rounds=2, scale=10)
    check(spark, rows[:3], parts=7, entries=256, rounds=1)
    with pytest.raises(ValueError):
        codes.compress(frame(spark, rows), entries=257)


def test_common_parts_go_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(3)) for _ in range(8)], i % 2) for i in range(40)]
    for heavy in (1, 4, 10**6):  # none, some and all of the keys
        monkeypatch.setattr(common, "HEAVY", heavy)
        check(spark, rows)


def test_numbers_beyond_64_bits(spark):
    rows = [(0, [1e9] * 8, 0), (1, [-1e9, 2.0] * 4, 0), (2, [3.0] * 8, 1), (3, [2e9, 0.0] * 4, 1)]
    want, _ = brute(rows, entries=2)
    limit = lambda r: (r[0], r[1], r[2] if r[2] < 2**63 else None)
    found = [(r.id, r.code, r.error) for r in codes.compress(frame(spark, rows), entries=2)[0].collect()]
    assert sorted(found, key=str) == sorted(map(limit, want), key=str)


def test_an_empty_table(spark):
    found, books = codes.compress(frame(spark, []))
    assert found.count() == 0 and books == {}
