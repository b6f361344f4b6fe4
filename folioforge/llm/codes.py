"""Vector code compression: product codes learned by weighted Lloyd rounds over distinct parts.

Components become whole numbers, and a vector is cut into consecutive parts. Equal parts at one position fold into one
distinct row with its weight, so everything after works on distinct values: each round assigns the distinct parts to the
nearest entry of their position's codebook and moves every entry to the weighted mean of its parts. The assignment of the
last round, code and error of each distinct part, is joined back to the vectors. Parts that a large share of the vectors
have are joined by broadcast (fewer than HEAVY a position), all others by a shuffle, so a common part meets in no task.

Codebooks are entries x length whole numbers a length of vector: they go through the driver and with the tasks, whatever
the number of vectors. Sums are whole numbers of any size, means rounded down.

Defined results: vectors that are null or hold a null or a number that is not finite take no part. Vectors are coded with
those of their own length; where it is no multiple of the number of parts, the first parts are longer by one. An empty
vector has empty parts, each at distance 0 of entry 0. The first codebooks are the parts of the vectors with the smallest
identifiers, null last, ties by the vector; fewer vectors make fewer entries. Ties in distance go to the lower entry.
Rows that repeat each have their row and their weight. Null labels are one label. An error that no long holds is null. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import joined_by_weight, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sizes of whole numbers up to which squared distances of a part, and sums, are computed in 64 bits; beyond, as Python's.
SAFE = 2**62
#: What stands for distances that no long holds.
NO_LONG = 2**63

Books = dict[tuple[int, int], np.ndarray]


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Start and width of each part of a vector of some length."""
    widths = [dim // parts + (p < dim % parts) for p in range(parts)]
    return [(sum(widths[:p]), w) for p, w in enumerate(widths)]


def exploded(rows: DataFrame, parts: int) -> DataFrame:
    """rows (dim, v, ...) with pos and part, one a part, instead of v."""
    p = F.col("pos")
    width = F.floor(F.col("dim") / parts).cast("int") + (p < F.col("dim") % parts).cast("int")
    start = p * F.floor(F.col("dim") / parts).cast("int") + F.least(p, F.col("dim") % parts) + 1
    others = [c for c in rows.columns if c != "v"]
    each = rows.select(*others, "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("pos"))
    return each.select(*others, "pos", F.slice("v", start, width).alias("part"))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """(length, position), row numbers and parts as a matrix, for each that a batch (dim, pos, part, ...) holds."""
    dim, pos, part = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    for d, p in {(int(d), int(p)) for d, p in zip(dim, pos, strict=True)}:
        at = np.flatnonzero((dim == d) & (pos == p))
        flat = part.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield (d, p), at, flat.astype(np.int64).reshape(len(at), len(flat) // len(at))


def _peak(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance, ties to the lower entry."""
    kind = np.int64 if 4 * max(_peak(parts), _peak(book)) ** 2 * max(1, parts.shape[1]) < SAFE else object
    x = parts.astype(kind)
    distances = np.stack([((x - e) ** 2).sum(axis=1) for e in book.astype(kind)])
    owner = np.argmin(distances, axis=0)
    return owner, distances[owner, np.arange(len(x))]


def _sums(parts: np.ndarray, weights: np.ndarray) -> list[int]:
    """Weighted sums of the columns, of any size."""
    kind = np.int64 if _peak(parts) * int(weights.sum()) < SAFE else object
    return [int(s) for s in (parts.astype(kind) * weights.astype(kind)[:, None]).sum(axis=0)]


def _moved(distinct: DataFrame, books: Books) -> Books:
    """The codebooks after a round: entries at the mean of their parts, rounded down; those without parts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            n = batch.column(3).to_numpy()
            for (d, p), at, parts in _groups(batch):
                owner, _ = nearest(parts, books[d, p])
                for e in np.unique(owner):
                    mine = owner == e
                    new = [*_sums(parts[mine], n[at][mine]), int(n[at][mine].sum())]
                    old = found.setdefault((d, p, int(e)), [0] * len(new))
                    found[d, p, int(e)] = [a + b for a, b in zip(old, new, strict=True)]
        rows = [(*key, i, Decimal(s)) for key, sums in found.items() for i, s in enumerate(sums)]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["dim", "pos", "entry", "i", "s"])

    sums = distinct.mapInArrow(run, "dim int, pos int, entry int, i int, s decimal(38,0)").groupBy("dim", "pos", "entry", "i").agg(F.sum("s").alias("s"))
    new, found = {key: book.copy() for key, book in books.items()}, {}
    for r in sums.collect():  # entries x (length + parts) numbers a length of vector
        found.setdefault((r["dim"], r["pos"], r["entry"]), {})[r["i"]] = int(r["s"])
    for (d, p, e), by_place in found.items():
        width = len(by_place) - 1  # the last number is the weight
        new[d, p][e] = [by_place[i] // by_place[width] for i in range(width)]
    return new


def _assigned(distinct: DataFrame, books: Books) -> DataFrame:
    """distinct with the code and error of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, err = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for key, at, parts in _groups(batch):
                code[at], err[at] = nearest(parts, books[key])
            errors = pa.array([None if e >= NO_LONG else int(e) for e in err], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), errors], ["dim", "pos", "part", "n", "code", "err"])

    return distinct.mapInArrow(run, "dim int, pos int, part array<long>, n long, code int, err long")


def whole_sum(c: str):
    """The sum of a column; null if one is, or where no long holds it."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.try_sum(c))


def books_sha256(books: Books, dim: int, parts: int) -> str:
    """Digest of a length's codebooks: all whole numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for p in range(parts) for entry in books[dim, p].tolist() for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """id, code, error, label_error, dim, one row a vector that takes part; and the codebooks by length and position."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", finite)).select("id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * float(scale))).alias("v"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "codes-vectors")
    distinct = stored(exploded(rows.select("dim", "v"), parts).groupBy("dim", "pos", "part").agg(F.count(F.lit(1)).alias("n")), "codes-distinct")
    first = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "v")
    seeds = rows.select("dim", "id", "v", F.row_number().over(first).alias("place")).where(F.col("place") <= entries).collect()  # `entries` vectors a length
    books: Books = {}
    for r in sorted(seeds, key=lambda r: (r["dim"], r["place"])):
        for p, (start, width) in enumerate(cuts(r["dim"], parts)):
            books.setdefault((r["dim"], p), []).append(r["v"][start : start + width])
    books = {(d, p): np.array(b, dtype=np.int64).reshape(len(b), cuts(d, parts)[p][1]) for (d, p), b in books.items()}
    for _ in range(rounds):
        moved = _moved(distinct, books)
        settled = all(np.array_equal(moved[key], books[key]) for key in books)
        books = moved
        if settled:  # the rounds left would change nothing
            break
    assigned = stored(_assigned(distinct, books), "codes-assigned")
    coded = joined_by_weight(exploded(rows, parts), assigned, ["dim", "pos", "part"], "n", rows.count())
    in_order = F.sort_array(F.collect_list(F.struct("pos", "code")))
    found = coded.groupBy("row", "id", "label", "dim").agg(in_order.alias("codes"), whole_sum("err").alias("error"))
    found = stored(found.select("id", "label", "dim", F.array_join(F.transform("codes", lambda c: F.format_string("%02x", c["code"])), "").alias("code"), "error"), "codes-found")
    by_label = found.groupBy("label").agg(whole_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = joined_by_weight(found, stored(by_label, "codes-labels"), ["label"], "n", found.count())
    return out.select("id", "code", "error", "label_error", "dim"), books


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    digests = {d: books_sha256(books, d, PARTS) for d in sorted({d for d, _ in books})}
    named = F.lit(None).cast("string")
    for d, digest in digests.items():
        named = F.when(F.col("dim") == d, digest).otherwise(named)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", named.alias("codebooks_sha256"))


def _sql() -> str:
    """All rounds written out: parts with weights, assignment by the least distance, means rounded down."""
    nearest_of = "arg_min(e.entry, (list_sum(list_transform(list_zip(w.part, e.c), lambda p: (p[1] - p[2]) ** 2))::BIGINT, e.entry))"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT w.pos, w.part, w.n, {nearest_of} AS entry FROM w JOIN b{r} e ON e.pos = w.pos GROUP BY w.pos, w.part, w.n),
s{r} AS (SELECT pos, entry, i, sum(part[i] * n)::BIGINT AS s, sum(n)::BIGINT AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{r}) GROUP BY pos, entry, i),
b{r + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT pos, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY pos, entry) m ON m.pos = b.pos AND m.entry = b.entry)""")
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, pos, v[pos * width + 1 : (pos + 1) * width] AS part FROM (SELECT *, unnest(range({PARTS})) AS pos FROM k)),
w AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM p GROUP BY pos, part),
b0 AS MATERIALIZED (SELECT pos, entry, part AS c FROM (SELECT pos, part, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES}),
{", ".join(steps)},
f AS MATERIALIZED (SELECT w.pos, w.part, {nearest_of} AS entry, min(list_sum(list_transform(list_zip(w.part, e.c), lambda p: (p[1] - p[2]) ** 2))::BIGINT) AS err FROM w JOIN b{ROUNDS} e ON e.pos = w.pos GROUP BY w.pos, w.part),
o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(err)::BIGINT AS error FROM p JOIN f USING (pos, part) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY pos, entry) FROM b{ROUNDS})) AS codebooks_sha256 FROM o"""


SQL = _sql()
