"""Benchmark decontamination by training suffix arrays: every test suffix is binary-searched in every shard of the documents.

A shard is a run of whole documents of one task, of about SHARD_WORDS words. Words are numbered by the vocabulary of the
tests; one that no test has is 0, which no match spans. The shard's suffix array is sorted by doubling: ties by the first
k words are resolved by the ranks of what follows them, until k words exceed the longest test item. Then all test suffixes
are searched together, a word further at each step: the suffixes that share d words are one range of the array, in which
those with a certain next word are found by binary search. The range at a window's length is all occurrences of the
window, the last range that is not empty the longest match. Where windows begin in a document, the document's suffix is
searched in the tests' own array in the same way, which gives the document's longest match.

Words of a document inside any occurrence are marked, and its result is made where it lies, so nothing is shuffled.
Tests are the query set, sent to the tasks: up to BLOCK_CHARS of text, beyond which they come in blocks of that size (an
item larger than a block is a block), each with a pass over the documents, and the passes' results meet by document.

Defined results: a window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
Null texts have no words. Items that share an identifier count as one; items without identifier mark words, but are not
named or counted. Rows of documents that repeat each have their row, null identifiers too. An empty table, or a benchmark
without windows, gives documents without hits. Other columns are ignored, whatever their names; `clean` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import scratch_path, spread_table, stored, table, whole

WINDOW = 10
#: Words in a shard, about (a longer document is one shard), and characters of test text that are sent to the tasks at once.
SHARD_WORDS, BLOCK_CHARS = 1_000_000, 16_000_000

#: Every byte that parts words as a space, A-Z as a-z. Bytes of characters beyond ASCII are parts of words.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

LONGEST = "struct<item: string, length: int, doc_word: int, item_word: int>"
SCANNED = f"n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>, longest {LONGEST}"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split(b" ")  # with empty ones


@dataclass
class Tests:
    """Test items, ready to be searched for and in: their words, where windows begin, and their own suffix array."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray  # all items' words, each item ended by -1
    item: np.ndarray  # the item of each word
    start: np.ndarray  # its place in the item
    at: np.ndarray  # where a window begins
    need: np.ndarray  # its words
    order: np.ndarray  # the suffix array of ids
    begins: np.ndarray  # where each item begins
    longest: int
    window: int
    names: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str | None, str]], window: int) -> Tests:
        vocabulary: dict[bytes, int] = {}
        ids, item, start, at, need, begins, longest = [], [], [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text.encode()) if w]
            size = min(window, len(own))
            begins.append(len(ids))
            if own:
                at += range(len(ids), len(ids) + len(own) - size + 1)
                need += [size] * (len(own) - size + 1)
            ids += [*own, -1]
            item += [k] * (len(own) + 1)
            start += range(len(own) + 1)
            longest = max(longest, len(own))
        array = lambda x, kind=np.int64: np.array(x, dtype=kind)
        numbers = array(ids, np.int32)
        return cls(vocabulary, numbers, array(item), array(start), array(at), array(need), suffix_array(numbers, longest), array(begins), longest, window, [name for name, _ in items])


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes that begin with a numbered word, in order by their first `depth` words at least."""
    n = len(ids)
    rank = np.zeros(n + 1, np.int64)  # of a suffix by its first k words; behind the end is the least
    rank[:n] = ids.astype(np.int64) + 1
    order = np.flatnonzero(ids > 0)
    order = order[np.argsort(ids[order], kind="stable")]
    groups = np.flatnonzero(np.diff(ids[order], prepend=-1))  # where suffixes of another first word begin
    base = n + 2  # above all numbers of words that begin no suffix here
    place = np.repeat(groups, np.diff(np.append(groups, len(order))))
    rank[order] = base + place
    k = 1
    while k < depth:
        first = np.flatnonzero(np.append(True, np.diff(rank[order]) != 0)) if len(order) else np.empty(0, np.int64)
        sizes = np.diff(np.append(first, len(order)))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            break
        mine = order[tied]
        group, after = rank[mine], rank[np.minimum(mine + k, n)]
        by = np.lexsort((after, group))
        mine, group, after = mine[by], group[by], after[by]
        places = np.flatnonzero(tied)
        order[places] = mine
        new = np.append(True, (np.diff(group) != 0) | (np.diff(after) != 0))
        rank[mine] = base + places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        k *= 2
    return order


def _narrowed(ids: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """In each range of suffixes that share `depth` words, where suffixes whose next word is `word` begin (or end)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        there = order[np.minimum(middle, len(order) - 1)] + depth
        found = ids[np.minimum(there, len(ids) - 1)]
        goes_up = open_ & ((found <= word) if right else (found < word))
        low, high = np.where(goes_up, middle + 1, low), np.where(open_ & ~goes_up, middle, high)
    return low


def search(ids: np.ndarray, order: np.ndarray, asked: np.ndarray, at: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the suffixes of `asked` that begin at `at`: the range of the array that shares their first `need` words, the length of the longest match and its range."""
    window, longest = np.zeros((len(at), 2), np.int64), np.zeros((len(at), 2), np.int64)
    length = np.zeros(len(at), np.int64)
    alive, low, high = np.arange(len(at)), np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    depth = 0
    while len(alive):
        word = asked[at[alive] + depth]  # a text ends with a number of no word
        going = word > 0
        alive, low, high, word = alive[going], low[going], high[going], word[going]
        left = _narrowed(ids, order, low, high, depth, word, False)
        right = _narrowed(ids, order, left, high, depth, word, True)
        depth += 1
        held = left < right
        alive, low, high = alive[held], left[held], right[held]
        length[alive] = depth
        longest[alive] = np.stack([low, high], axis=1)
        reached = need[alive] == depth
        window[alive[reached]] = longest[alive[reached]]
    return window, length, longest


def _expanded(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges (one of low and high a row), and which range each is of."""
    sizes = ranges[:, 1] - ranges[:, 0]
    of = np.repeat(np.arange(len(ranges)), sizes)
    return ranges[of, 0] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of


def _found(texts: list[np.ndarray], tests: Tests) -> list[tuple]:
    """What is found in each document of a shard (its words' numbers): starts, ends, items, longest."""
    out: list[tuple] = [([], [], [], None)] * len(texts)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    ids = np.concatenate([np.append(t, np.int32(0)) for t in texts])
    order = suffix_array(ids, tests.longest)
    if not len(order):
        return out
    window, _, _ = search(ids, order, tests.ids, tests.at, tests.need)
    there = window[:, 1] > window[:, 0]
    if not there.any():
        return out
    # Equal windows have one range, so a place occurs once for each width of window at most.
    ranges, which = np.unique(np.column_stack([window, tests.need])[there], axis=0, return_inverse=True)
    at, of = _expanded(ranges[:, :2])
    place = order[at]
    doc = np.searchsorted(begins, place, side="right") - 1
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, place, 1)
    np.add.at(marks, place + ranges[of, 2], -1)
    edges = np.diff(np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    span_doc = np.searchsorted(begins, starts, side="right") - 1
    by_range = np.unique(np.column_stack([which.ravel(), tests.item[tests.at[there]]]), axis=0)  # the items of each range
    doc_range = np.unique(np.column_stack([doc, of]), axis=0)
    # The longest match of a document begins where a window does: these places are searched in the tests' own array.
    places, nth = np.unique(place, return_inverse=True)
    _, length, in_tests = search(tests.ids, tests.order, ids, places, np.zeros(len(places), np.int64))
    short = np.zeros(len(places), np.int64)  # the longest window there
    np.maximum.at(short, nth.ravel(), ranges[of, 2])
    in_window = length < tests.window  # the match goes on from no whole window, but an item of few words is there
    length = np.where(in_window, short, length)
    place_doc = np.searchsorted(begins, places, side="right") - 1
    best = np.lexsort((places, -length, place_doc))
    best = best[np.flatnonzero(np.diff(place_doc[best], prepend=-1))]
    bounds = lambda column, d: slice(*np.searchsorted(column, [d, d + 1]))
    for j in best:
        d = int(place_doc[j])
        spans = bounds(span_doc, d)
        held = doc_range[bounds(doc_range[:, 0], d), 1]
        names = {tests.names[i] for r in held for i in by_range[bounds(by_range[:, 0], r), 1]}
        if in_window[j]:
            here = of[(nth.ravel() == j) & (ranges[of, 2] == short[j])]
            first = min(int(tests.begins[i]) for r in here for i in by_range[bounds(by_range[:, 0], r), 1])
        else:
            first = int(tests.order[slice(*in_tests[j])].min())
        longest = {"item": tests.names[tests.item[first]], "length": int(length[j]), "doc_word": int(places[j] - begins[d]), "item_word": int(tests.start[first])}
        out[d] = ((starts[spans] - begins[d]).tolist(), (ends[spans] - begins[d]).tolist(), sorted(n for n in names if n is not None), longest)
    return out


def _scan(rows: DataFrame, tests: Tests, shard_words: int) -> DataFrame:
    """row with what one block of tests finds in its text. rows: row, text (no nulls)."""
    sent = rows.sparkSession.sparkContext.broadcast(tests)  # BLOCK_CHARS of text at most, or one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number = known.vocabulary.get
        held, texts, total = [], [], 0

        def flushed() -> pa.RecordBatch:
            found = _found(texts, known)
            n_words = [len(t) for t in texts]
            n_hit = [sum(ends) - sum(starts) for starts, ends, _, _ in found]
            columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), *[pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(held), *columns], ["row", "n_words", "n_hit", "starts", "ends", "items", "longest"])

        match = pa.struct([("item", pa.string()), ("length", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())])
        kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), match)
        for batch in batches:
            begun = 0
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                numbers = [number(w, 0) for w in words(text.as_py()) if w]
                texts.append(np.array(numbers, dtype=np.int32))
                total += len(numbers)
                if total >= shard_words:
                    held.append(batch.column(0).slice(begun, i + 1 - begun))
                    yield flushed()
                    held, texts, total, begun = [], [], 0, i + 1
            held.append(batch.column(0).slice(begun))
        if texts:
            yield flushed()

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {SCANNED}")


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items' names and texts in blocks of about `most` characters."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // most))
    if count > 1:
        items = stored(items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count))), "leaks-items")
    for b in range(count):
        found = (items.where(F.col("block") == b) if count > 1 else items).select("item", "text").distinct().collect()  # about `most` characters
        yield sorted(((r["item"], r["text"]) for r in found), key=lambda r: (r[0] is not None, r))


def scan(docs: DataFrame, benchmark: DataFrame, row, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """row, n_words, n_hit, starts, ends, items, longest: one row a document. `row` is the column that stands for it.

    starts and ends bound the words that lie in windows; items are the names of those that have such; longest is the longest
    verbatim match of a window or more, with the words where it begins in the document and the item (the first, in order of items' names).
    """
    rows = docs.select(row.alias("row"), whole(docs[text_col]).alias("text"))
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), whole(benchmark[item_text]).alias("text"))
    blocks = _blocks(items, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(rows, Tests.of(first, window), shard_words)
    rows = stored(rows.withColumn("row", F.struct(F.monotonically_increasing_id().alias("number"), F.col("row").alias("row"))), "leaks-rows")
    path, passes = scratch_path(docs.sparkSession, "leaks-passes"), 0
    for block in (b for bs in ([first, second], blocks) for b in bs):
        _scan(rows, Tests.of(block, window), shard_words).write.parquet(f"{path}/{passes}")
        passes += 1
    found = [docs.sparkSession.read.parquet(f"{path}/{k}") for k in range(passes)]
    met = reduce(DataFrame.unionByName, [found[0], *[f.where("n_hit > 0") for f in found[1:]]])
    first = F.struct(-F.col("longest.length"), "longest.doc_word", "longest.item", "longest.item_word")
    longest = F.min_by("longest", F.when(F.col("longest").isNotNull(), first))
    lists = met.groupBy(F.col("row.number").alias("number")).agg(
        F.any_value("row.row").alias("row"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), longest.alias("longest"),
    )  # as many spans as a document has in each pass, at most half its words
    none = F.array().cast("array<struct<starts: int, ends: int>>")
    last = lambda joined: F.element_at(joined, -1)

    def with_span(joined, span):
        touches = (F.size(joined) > 0) & (F.try_element_at(joined, F.lit(-1))["ends"] >= span["starts"])
        longer = F.struct(last(joined)["starts"].alias("starts"), F.greatest(last(joined)["ends"], span["ends"]).alias("ends"))
        return F.when(touches, F.concat(F.slice(joined, 1, F.size(joined) - 1), F.array(longer))).otherwise(F.concat(joined, F.array(span)))

    lists = lists.withColumn("spans", F.aggregate(F.array_sort("spans"), none, with_span))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return lists.select("row", "n_words", hit.alias("n_hit"), F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a window of the benchmark, their columns as they are."""
    found = scan(docs, benchmark, F.struct(*[docs[c] for c in docs.columns]), **options)
    return found.where("n_hit = 0").select("row.*")


def op12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), F.col("doc_id"))
    return found.select(
        F.col("row").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM t))),
o AS (SELECT doc_id, k, n, item_id FROM d JOIN t USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT doc_id, k, n FROM o)) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""
