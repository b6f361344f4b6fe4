"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are shuffled by a hash and laid end to end as one stream of words, cut into blocks of equal
length. The schedule's slots are the points of the van der Corput sequence in base 2: the cumulative target weights cut
[0, 1) into one interval a source, and since the points of 2^m slots are exactly the multiples of 2^-m, a source's slots
are found by reversing the bits of the multiples in its interval. Slots are ranked within their source and joined with
the source's blocks, over and over while the target asks for more; the slot in which the target is reached is cut.

Defined results: null texts have size 0 and take part with 0 words. A null source is a source of its own, the last.
Sources without words get target 0. Rows that repeat are separate rows of the stream. An empty table gives an empty
result. Other columns are ignored, whatever their names. Ties of the shuffle hash fall to doc_id, then size; rows equal
in both are interchangeable, so reruns agree. Windows over sources see one row a source, in one task: meant for up to some
million sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import spread_table, stored, word_count

#: Words in a block; a slot of the schedule takes one block.
BLOCK_WORDS = 1024
#: A source is repeated at most so many times.
MOST_REPEATS = 3
#: Slots in one chunk of the schedule's making.
CHUNK = 65_536


def reversed_bits(x: Column) -> Column:
    """The 64 bits of a long in reverse."""
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask)
        x = F.shiftrightunsigned(x, width).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), width))
    return x


def source_targets(sizes: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """sid, source, source_size, target, take: one row a source. sizes: source, size.

    Weights 1, 2, 3 repeat over the sources in code point order, null last. A source whose share would pass `repeats`
    times its size stops there and the rest is shared anew by weight: in the order of capacity to weight, the first
    source that stays below its capacity fixes the level for all that follow. The windows here see one row a source.
    """
    wide = "decimal(38,0)"
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.col("sid") % 3 + 1).withColumn("cap", F.col("source_size") * repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    level = (
        ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rest", F.col("total") - F.col("spent"))
        .withColumn("free", F.col("rest").cast(wide) * F.col("w") <= F.col("cap").cast(wide) * F.col("w_left"))
    )
    first = F.first(F.when(F.col("free"), F.struct("rest", "w_left")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = level.withColumn("at", first)
    target = F.when(F.col("free"), (F.col("at.rest") * F.col("w")).cast("double") / F.col("at.w_left")).otherwise(F.col("cap").cast("double"))
    return level.select("sid", "source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("take"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sid, slot, rank, epoch, block, words: which block each slot takes, in slot order. sources: as from source_targets()."""
    k = F.lit(block_words)
    blocks = F.ceil(F.col("source_size") / k).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0).cast("long")
    need = (
        sources.withColumn("blocks", blocks)
        .withColumn("rest", F.col("take") - full * F.col("source_size"))
        .withColumn("last", F.col("rest") % k)
        .withColumn("slots", full * F.col("blocks") + F.ceil(F.col("rest") / k).cast("long"))
        .withColumn("all", F.sum("slots").over(Window.partitionBy()))
        .withColumn("before", F.sum("slots").over(Window.orderBy("sid")) - F.col("slots"))
        .where("slots > 0")
        .withColumn("bits", F.greatest(F.lit(1), F.length(F.bin(F.col("all") - 1))))
        .withColumn("points", F.expr("shiftleft(1L, bits)"))
    )
    # Interval ends in units of 2^-bits: at least `slots` points lie between them, as 2^bits >= all.
    wide = "decimal(38,0)"
    end = lambda c: F.expr(f"cast(cast(points as {wide}) * ({c}) div all as long)")
    need = need.withColumn("lo", end("before")).withColumn("hi", end("before + slots"))
    chunks = need.withColumn("start", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(CHUNK).cast("long")))).repartition("sid", "start")
    points = chunks.withColumn("r", F.explode(F.sequence("start", F.least(F.col("start") + CHUNK, F.col("hi")) - 1)))
    placed = points.withColumn("slot", reversed_bits(F.col("r")))
    placed = placed.withColumn("slot", F.expr("shiftrightunsigned(slot, 64 - bits)")).withColumn("part", F.expr("slot >> greatest(bits - 10, 0)"))
    counts = placed.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("here"))
    offsets = counts.withColumn("offset", F.sum("here").over(Window.partitionBy("sid").orderBy("part")) - F.col("here")).drop("here")
    ranked = placed.withColumn("i", F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot"))).join(offsets.hint("merge"), ["sid", "part"])  # else the slots might be broadcast
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("i") - 1).where("rank < slots")
    block = F.col("rank") % F.col("blocks")
    length = F.least(k, F.col("source_size") - block * k)
    return ranked.select(
        "sid", "slot", "rank", F.floor(F.col("rank") / F.col("blocks")).cast("long").alias("epoch"), block.alias("block"),
        F.when((F.col("rank") == F.col("slots") - 1) & (F.col("last") > 0), F.least(F.col("last"), length)).otherwise(length).cast("long").alias("words"), length.cast("long").alias("length"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken."""
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"))
    sized = stored(sized.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))), "mix-sizes")
    sources = stored(source_targets(sized), "mix-sources")
    # Where each document starts in its source's shuffled stream: sums of hash buckets first, then sums within a bucket.
    rows = sized.withColumn("bucket", F.substring("h", 1, 3)).join(sources.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.select("sid", "bucket", (F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.withColumn("upto", F.sum("size").over(within)).join(starts, ["sid", "bucket"]).withColumn("lo", F.col("base") + F.col("upto") - F.col("size"))
    laid = laid.select("sid", "id", "size", "lo")
    plays = (
        schedule(sources, block_words).groupBy("sid", "block")
        .agg(F.sum((F.col("words") == F.col("length")).cast("long")).alias("plays"), F.max(F.when(F.col("words") < F.col("length"), F.col("words"))).alias("cut"))
    )
    k = F.lit(block_words)
    cover = F.sequence(F.floor(F.col("lo") / k), F.floor((F.col("lo") + F.col("size") - 1) / k))
    # Blocks grow with the corpus, which the optimiser can't see: without the hint it would broadcast them.
    parts = laid.where("size > 0").withColumn("block", F.explode(cover)).join(plays.hint("merge"), ["sid", "block"], "left")
    begin, stop, base = F.greatest("lo", F.col("block") * k), F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * k), F.col("block") * k
    piece = F.coalesce(F.col("plays") * (stop - begin), F.lit(0)) + F.coalesce(F.greatest(F.least(stop, base + F.coalesce("cut", F.lit(0))) - begin, F.lit(0)), F.lit(0))
    # Where a document of some words starts, no other one does.
    taken = parts.groupBy("sid", "id", "size", "lo").agg(F.sum(piece).cast("long").alias("taken")).select("sid", "id", "size", "taken")
    taken = taken.unionByName(laid.where("size = 0").select("sid", "id", "size", F.lit(0).cast("long").alias("taken")))
    return taken.join(sources, "sid").select("id", "source", "size", "source_size", "target", "taken")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spread_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 3 * sum(size)::BIGINT AS cap,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, sid) AS k,
             sum(n) OVER ()::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
             sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_left FROM s),
f AS (SELECT *, rest::HUGEINT * w <= cap::HUGEINT * w_left AS free FROM o),
t AS (SELECT f.source, f.n, CASE WHEN f.free THEN (a.rest * f.w)::DOUBLE / a.w_left ELSE f.cap::DOUBLE END AS target
      FROM f, (SELECT rest, w_left FROM f WHERE free ORDER BY k LIMIT 1) a),
l AS (SELECT d.doc_id, d.size, t.n AS source_size, t.target, floor(t.target + 0.5)::BIGINT AS take,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS lo
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (take // source_size) * size + greatest(least(lo + size, take % source_size) - lo, 0) END::BIGINT AS taken
FROM l
"""
