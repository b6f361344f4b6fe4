r"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are within one edit (insertion, deletion or substitution of a character) exactly if deleting at most one
character from each makes them equal. Emitting all deletions of whole lines would cost the square of their length, so
lines are first cut into four blocks and hashed without one of them: an edit falls into one block, so its partner has
the same rest. Only blocks whose rest meets another line's emit their deletion variants, as hashed keys:

* substitutions: (rest, place, block without the character there); all lines with such a key are within one edit;
* deletions: (rest, block without a character) of the longer line meets (rest, block) of the shorter.

So a key needs no pairs among its lines, only a join with the earliest line on the other side of the edit. Each such
candidate is verified with levenshtein() on the whole lines.

A line is dropped if it occurred before, or if an earlier different line is within one edit. Lines come in the order of
document identifier, then hash of the document, then place. Blank lines always stay; so do lines of under `min_chars`
characters where a caller asks for that. Lines of under `near_chars` characters go only as exact repeats, since one edit
makes another word of them. A line is what "\n" separates. Equal lines are found by 125 bits of hash, keys by 128, near lines
are verified character by character.

A rest or variant may be that of any part of all lines: each is folded to counts or first lines before the shuffle, and
what needs its lines again is a join, which adaptive execution splits where a key is skewed.

Defined results: null texts count as empty (one blank line). Null identifiers come first. Rows equal in identifier and
text are one document with one result, given for each of them. Lines of any length are compared whole. An empty table
gives an empty result. Other columns pass through dedup_text() unchanged and are ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import bitmap, bits_for, maybe_held, spread_table, stored, whole

#: Lines of fewer characters are near no other.
NEAR_CHARS = 16
#: What a line that is not blank holds.
SOMETHING = r"[^\x20\x09-\x0D]"
#: Blocks of a line; one edit falls into one of them.
BLOCKS = 4
#: Bits, at most, of the bitmaps that keep most lines and rests where they are: 16 MB. They have 16 bits a value; from 8 million
#: values on they let more through, and past some 100 million all lines move once.
FILTER_BITS = 1 << 27


def _eligible(line: Column, min_chars: int) -> Column:
    return (F.char_length(line) >= min_chars) & line.rlike(SOMETHING)


def _rests(line: Column) -> Column:
    """The hashes of a line without each block, then of the line as the shorter one of a pair, without each block."""
    n = F.char_length(line)
    out = []
    for shorter in (0, 1):
        size = n + shorter
        for j in range(BLOCKS):
            low, high = F.floor(size * j / BLOCKS), F.floor(size * (j + 1) / BLOCKS)
            out.append(F.xxhash64(size, F.lit(j), F.substring(line, F.lit(1), low), F.substring(line, high + 1 - shorter, n)))
    return F.array(*out)


def eligible_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """at (id, doc, pos), line: every eligible line of every document."""
    text = whole(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], text).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return rows.where(_eligible(F.col("line"), min_chars)).select(F.struct("id", "doc", "pos").alias("at"), "line")


def distinct_lines(lines: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """h, at, copies, keys: each different line's hash, first occurrence, occurrences (0 under near_chars characters) and rests (none under near_chars). Lines are told apart by 125 bits of hash, so texts don't move."""
    low = 2 * BLOCKS - 1
    h = F.xxhash64("line").bitwiseAND(F.lit(~low)).alias("h")  # room for a role in its last bits
    keys = F.when(F.char_length("line") >= near_chars, _rests(F.col("line"))).alias("keys")
    hashed = lines.select("at", h, F.xxhash64(F.lit(1), F.col("line")).alias("h2"), keys)
    # Rests that are used twice are computed once and ahead of the aggregation, which then sorts them and not the lines.
    first, copies = F.min(F.struct("at", "keys")).alias("first"), F.count("keys").alias("copies")
    return hashed.groupBy("h", "h2").agg(first, copies).select("h", "first.at", "copies", "first.keys")


def partners(firsts: DataFrame) -> DataFrame:
    """at, rests: the lines that share a rest with another line, with those rests. firsts: h, at, keys."""
    low = F.lit(2 * BLOCKS - 1)
    keyed = firsts.select("h", F.posexplode("keys").alias("role", "key")).select("key", F.col("h").bitwiseOR(F.col("role").cast("long")).alias("hr"))
    role = F.col("hr").bitwiseAND(low.cast("long")).cast("int")
    is_long = (role < BLOCKS).cast("long")
    counts = keyed.groupBy("key").agg(F.sum(is_long).alias("long"), F.sum(1 - is_long).alias("short"))
    met = stored(counts.where("long > 1 or (long = 1 and short > 0)").select("key", (F.col("short") > 0).alias("short")), "line-dedup-met")
    bits = bits_for(met.count(), FILTER_BITS)
    likely = maybe_held(keyed, "key", bitmap(met, "key", bits), bits).join(met, "key")
    rest = F.struct("key", role.alias("role"), "short")
    rests = likely.groupBy((F.col("hr").bitwiseAND(F.lit(~(2 * BLOCKS - 1)))).alias("h")).agg(F.collect_set(rest).alias("rests"))
    return firsts.select("h", "at").join(rests, "h").select("at", "rests")


def with_texts(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """at, rests, line: the texts of the lines asked for (at, rests). A bitmap keeps other lines out of the shuffle."""
    bits = bits_for(asked.count(), FILTER_BITS)
    words = bitmap(asked.select(F.xxhash64("at").alias("h")), "h", bits)
    likely = maybe_held(lines.withColumn("h", F.xxhash64("at")), "h", words, bits)
    return likely.select("at", "line").join(asked, "at").dropDuplicates(["at"])


def _variants(line: Column, role: Column, key: Column, short: Column) -> Column:
    """array<struct<vk, side>>: hashed keys of the block's variants; side 0 substitution, 1 longer line, 2 shorter line."""
    n = F.char_length(line)
    shorter = F.when(role >= BLOCKS, 1).otherwise(0)
    size, j = n + shorter, role % BLOCKS
    low, high = F.floor(size * j / BLOCKS), F.floor(size * (j + 1) / BLOCKS)
    block = F.substring(line, low + 1, high - low - shorter)
    places = F.sequence(F.lit(1), F.char_length(block))
    # The struct binds the block once; the optimiser would compute it anew for each place.
    held = F.array(F.struct(block.alias("b"), places.alias("p")))
    cut = lambda b, p: F.concat(F.substring(b, F.lit(1), p - 1), F.substring(b, p + 1, F.char_length(b)))
    swaps = F.flatten(F.transform(held, lambda s: F.transform(s["p"], lambda p: F.struct(F.xxhash64(key, p, cut(s["b"], p)).alias("vk"), F.lit(0).alias("side")))))
    drops = F.flatten(F.transform(held, lambda s: F.transform(s["p"], lambda p: F.struct(F.xxhash64(key, F.lit("-"), cut(s["b"], p)).alias("vk"), F.lit(1).alias("side")))))
    hub = F.array(F.struct(F.xxhash64(key, F.lit("-"), block).alias("vk"), F.lit(2).alias("side")))
    return F.when(role >= BLOCKS, hub).when(short, F.array_distinct(F.concat(swaps, drops))).otherwise(swaps)


def near_earlier(partnered: DataFrame) -> DataFrame:
    """at: the lines that have an earlier line within one edit."""
    lines = partnered.select("at", "line", "rests")
    v = lines.select("at", "line", F.explode("rests").alias("r")).select("at", "r.key", F.explode(_variants(F.col("line"), F.col("r.role"), F.col("r.key"), F.col("r.short"))).alias("v")).select("at", "key", "v.vk", "v.side")
    first = lambda side: F.min(F.when(F.col("side") == side, F.col("at"))).alias(f"first{side}")
    keys = v.groupBy("key", "vk").agg(first(0), first(1), first(2))
    other = F.when(F.col("side") == 0, F.col("first0")).when(F.col("side") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = v.join(keys, ["key", "vk"]).select("at", other.alias("earlier")).where("earlier < at").distinct()
    texts = lines.select(F.col("at").alias("earlier"), F.col("line").alias("other"))
    verified = pairs.join(lines.select("at", "line"), "at").join(texts, "earlier").where(F.levenshtein("line", "other", 1) >= 0)
    return verified.select("at").distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, near_chars: int = NEAR_CHARS) -> DataFrame:
    """id, doc, kept: the places of the eligible lines that stay, by document; documents without any are missing."""
    lines = eligible_lines(docs, id_col, text_col, min_chars)
    firsts = stored(distinct_lines(lines, near_chars), "line-dedup-firsts")
    asked = stored(partners(firsts), "line-dedup-asked")
    partnered = stored(with_texts(lines, asked), "line-dedup-texts")
    stay = firsts.select("at").join(near_earlier(partnered), "at", "left_anti")
    return stay.groupBy(F.col("at.id").alias("id"), F.col("at.doc").alias("doc")).agg(F.sort_array(F.collect_list("at.pos")).alias("kept"))


def _places(lines: Column, kept: Column, min_chars: int) -> Column:
    """All places of a document that stay, in order."""
    free = F.filter(F.transform(lines, lambda x, i: F.when(~_eligible(x, min_chars), i)), lambda i: i.isNotNull())
    return F.array_sort(F.concat(F.coalesce(kept, F.array().cast("array<int>")), free))


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, near_chars: int = NEAR_CHARS) -> DataFrame:
    """id, n_lines, n_kept, kept (places from 0 that stay): one row per document."""
    text = whole(docs[text_col])
    lines = F.split(text, "\n", -1)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], text).alias("doc"), F.size(lines).alias("n_lines"), _places(lines, F.lit(None).cast("array<int>"), min_chars).alias("free"))
    found = kept_lines(docs, id_col, text_col, min_chars, near_chars).withColumnRenamed("id", "kept_id").withColumnRenamed("doc", "kept_doc")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("doc") == F.col("kept_doc")), "left")
    joined = joined.withColumn("kept", F.array_sort(F.concat(F.coalesce("kept", F.array().cast("array<int>")), "free")))
    return joined.select("id", "n_lines", F.size("kept").alias("n_kept"), "kept")


def dedup_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the text that stays; documents that lose their last line which is not blank are gone."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # so no name of theirs can clash
    of = F.col("row").getField
    text = whole(of(text_col))
    found = kept_lines(docs, id_col, text_col, min_chars, near_chars)
    joined = rows.join(found, of(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(of(id_col), text) == F.col("doc")), "left")
    held = F.array(F.struct(F.split(text, "\n", -1).alias("x"), F.col("kept").alias("k")))
    built = F.transform(held, lambda s: F.array_join(F.transform(_places(s["x"], s["k"], min_chars), lambda i: s["x"][i]), "\n"))[0]
    out = joined.select("row", F.when(of(text_col).isNotNull(), built).alias("left")).where(~text.rlike(SOMETHING) | F.col("left").rlike(SOMETHING))
    return out.select(*[F.col("left").alias(c) if c == text_col else of(c).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_decisions(spread_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"), F.array_join("kept", ",").alias("kept_lines"))


SQL = r"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM x)),
e AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS ok FROM l),
f AS (SELECT line, doc_id, pos, length(line) AS n FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM e WHERE ok) WHERE k = 1),
fn AS (SELECT * FROM f WHERE n >= 16),
p AS (SELECT a.line AS a, b.line AS b FROM fn a JOIN fn b ON b.n = a.n AND left(a.line, a.n // 2) = left(b.line, b.n // 2) WHERE (b.doc_id, b.pos) < (a.doc_id, a.pos)
      UNION ALL SELECT a.line, b.line FROM fn a JOIN fn b ON b.n = a.n AND right(a.line, a.n // 2) = right(b.line, b.n // 2) WHERE (b.doc_id, b.pos) < (a.doc_id, a.pos)
      UNION ALL SELECT a.line, b.line FROM fn a JOIN fn b ON b.n = a.n - 1 AND left(a.line, (a.n - 1) // 2) = left(b.line, b.n // 2) WHERE (b.doc_id, b.pos) < (a.doc_id, a.pos)
      UNION ALL SELECT a.line, b.line FROM fn a JOIN fn b ON b.n = a.n - 1 AND right(a.line, (a.n - 1) // 2) = right(b.line, b.n // 2) WHERE (b.doc_id, b.pos) < (a.doc_id, a.pos)
      UNION ALL SELECT a.line, b.line FROM fn a JOIN fn b ON b.n = a.n + 1 AND left(a.line, a.n // 2) = left(b.line, (b.n - 1) // 2) WHERE (b.doc_id, b.pos) < (a.doc_id, a.pos)
      UNION ALL SELECT a.line, b.line FROM fn a JOIN fn b ON b.n = a.n + 1 AND right(a.line, a.n // 2) = right(b.line, (b.n - 1) // 2) WHERE (b.doc_id, b.pos) < (a.doc_id, a.pos)),
g AS (SELECT DISTINCT a AS line FROM p WHERE levenshtein(a, b) <= 1),
s AS (SELECT e.doc_id, e.pos, NOT ok OR (f.line IS NOT NULL AND g.line IS NULL) AS stays
      FROM e LEFT JOIN f ON e.ok AND e.line = f.line AND e.doc_id = f.doc_id AND e.pos = f.pos LEFT JOIN g ON e.ok AND e.line = g.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE stays) AS n_kept, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE stays), '') AS kept_lines
FROM s GROUP BY doc_id
"""
