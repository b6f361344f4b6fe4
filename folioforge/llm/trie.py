"""The trie of conversation prefixes, rolled up by pointer jumping.

A node is a sequence of turns, known by its depth and a digest of 128 bits: the bitwise sum of a hash of every turn with its
place. So the digests of all prefixes are running sums, and a node's parent is the sum without the last turn. Running sums,
like places, are taken over blocks of the turns in order, a shuffle partition each, and what lies before a block is handed
on, so no task holds a conversation. Turns with the same node fold where they lie.

Sums over subtrees take a number of rounds that is the logarithm of the depth: each node has a pointer to an ancestor and
the sums of its subtree down to that distance; in a round every node adds its sums to its pointer's node, and takes its
pointer's pointer. Pointers that many nodes have are joined by broadcast. Each round is a stored table.

The identifiers of conversations that end at a node are put in order by range and written together in pieces, one a block,
before their digest is taken; a task that does so for a node with many pieces reads one at a time.

Defined results: turns go by turn (null first), then by the digest of role and text; null roles and texts are empty. Turns
without conversation belong to none. Turns that repeat all count. An empty table has no nodes, not even the root. Columns
other than the four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import HEAVY, stored, table, whole

#: Every conversation takes its first turns from the one whose number ends in so many zeros: how many is a digest of its number, less than HEADS.
FAMILY, HEADS = 100, 6
#: Conversations whose identifiers are written together, about.
PIECE = 65_536

NODE = ["depth", "a", "b"]


def in_blocks(rows: DataFrame, keys: list[Column], name: str, blocks: int | None = None) -> DataFrame:
    """rows stored in order of some columns; `block` numbers the consecutive blocks in which they lie, which rows of equal keys may share or not."""
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spare = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).alias("spare")
    rows = rows.withColumn("spare", spare).repartitionByRange(blocks, *keys, "spare")
    return stored(rows.withColumn("block", F.spark_partition_id()), name)


def carried(rows: DataFrame, key: str, name: str, values: dict[str, Column]) -> DataFrame:
    """block, key and for each value (an aggregate) what it is over the rows of that key in earlier blocks. Only keys that blocks share, two a block at most."""
    ends = rows.groupBy("block").agg(F.min(key).alias("low"), F.max(key).alias("high"))  # one row a block
    edges = rows.join(F.broadcast(ends), "block").where((F.col(key) == F.col("low")) | (F.col(key) == F.col("high")))
    each = edges.groupBy("block", key).agg(*[v.alias(c) for c, v in values.items()])
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return stored(each.select("block", key, *[(F.sum(c) if c == "n" else F.bit_xor(c)).over(before).alias(f"before_{c}") for c in values]), name)


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows in blocks (conv, ...) with `place`: where each is among the rows of its conversation, from 1."""
    rows = in_blocks(rows, ["conv", *[F.col(c).asc_nulls_first() for c in order]], name)
    before = carried(rows, "conv", f"{name}-before", {"n": F.count(F.lit(1))})
    here = F.row_number().over(Window.partitionBy("block", "conv").orderBy(*[F.col(c).asc_nulls_first() for c in order], "spare"))
    met = rows.join(F.broadcast(before), ["block", "conv"], "left")  # two rows a block
    return met.withColumn("place", here.cast("long") + F.coalesce("before_n", F.lit(0))).drop("before_n", "spare")


def head_count(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, place, x, chars, block: all turns of the rebuilt conversations; and conv: all conversations. turns: conv, turn, x, chars."""
    own = stored(placed(turns, ["turn", "x"], "trie-turns").drop("block"), "trie-own")
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv")
    first = own.where((F.col("place") < HEADS) & (F.col("conv") % FAMILY == 0))
    heads = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "x", "chars"))).alias("turns"))  # fewer than HEADS
    asking = convs.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), head_count(F.col("conv")).alias("h"))
    taken = asking.join(heads, "base").select("conv", F.explode(F.slice("turns", F.lit(1), F.col("h"))).alias("t"))  # a head has 2 * FAMILY conversations at most
    rest = own.where(F.col("place") > head_count(F.col("conv"))).select("conv", F.lit(1).alias("part"), F.col("place").alias("nth"), "x", "chars")
    both = taken.select("conv", F.lit(0).alias("part"), F.col("t.place").alias("nth"), "t.x", "t.chars").unionByName(rest)
    return placed(both, ["part", "nth"], "trie-rebuilt"), stored(convs, "trie-conversations")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, a, b, up_a, up_b, chars: the node and its parent of every rebuilt turn."""
    rows = stored(rows.select("conv", "block", "chars", F.col("place").alias("depth"), *[F.xxhash64("x", "place", F.lit(k)).alias(c) for k, c in enumerate("ab")]), "trie-hashes")
    before = carried(rows, "conv", "trie-sums", {c: F.bit_xor(c) for c in "ab"})
    so_far = Window.partitionBy("block", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(F.broadcast(before), ["block", "conv"], "left")  # two rows a block
    with_sums = met.select("conv", "depth", "chars", "a", "b", *[F.bit_xor(c).over(so_far).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0).cast("long"))).alias(f"sum_{c}") for c in "ab"])
    return with_sums.select("conv", "depth", F.col("sum_a").alias("a"), F.col("sum_b").alias("b"), F.col("sum_a").bitwiseXOR(F.col("a")).alias("up_a"), F.col("sum_b").bitwiseXOR(F.col("b")).alias("up_b"), "chars")


def by_pointer(rows: DataFrame, pointer: list[str], facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the facts of the node that `pointer` names (inner). Nodes that more than one in HEAVY rows point to meet by broadcast."""
    named = facts.select(*[F.col(c).alias(f"_{c}") for c in keys], *[c for c in facts.columns if c not in keys])
    crowded = stored(rows.groupBy(*pointer).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY > total).drop("n"), "trie-crowded")  # fewer than HEAVY
    same = [F.col(p) == F.col(f"_{k}") for p, k in zip(pointer, keys, strict=True)]
    heavy = named.join(F.broadcast(crowded.select(*[F.col(p).alias(f"_{k}") for p, k in zip(pointer, keys, strict=True)])), [f"_{k}" for k in keys], "left_semi")
    light = rows.join(F.broadcast(crowded), pointer, "left_anti")
    return rows.join(F.broadcast(heavy), same).unionByName(light.join(named, same)).drop(*[f"_{k}" for k in keys])


def rolled_up(nodes: DataFrame) -> DataFrame:
    """depth, a, b, leaves, saved: sums over each node's subtree. nodes: depth, a, b, up_a, up_b (null at the root), leaves, saved."""
    total = nodes.count()
    state = nodes.select(*NODE, F.when(F.col("depth") > 0, F.col("depth") - 1).alias("to_depth"), F.col("up_a").alias("to_a"), F.col("up_b").alias("to_b"), "leaves", "saved")
    pointer = ["to_depth", "to_a", "to_b"]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        state = stored(state, "trie-state")
        jumping = state.where("to_depth is not null")
        given = jumping.groupBy(*pointer).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        given = given.select(*[F.col(p).alias(k) for p, k in zip(pointer, NODE, strict=True)], "more_leaves", "more_saved")
        onward = state.where("to_depth is not null").select(*NODE, *[F.col(p).alias(f"on_{p}") for p in pointer])
        jumped = by_pointer(jumping.select(*NODE, *pointer), pointer, onward, NODE, total).select(*NODE, *[F.col(f"on_{p}").alias(p) for p in pointer])
        summed = state.drop(*pointer).join(given, NODE, "left").select(*NODE, *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        state = summed.join(jumped, NODE, "left")
        step *= 2
    return state.select(*NODE, "leaves", "saved")


def ends_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """depth, a, b, ends_sha256: digests of the identifiers that end at a node, ascending, joined by commas. ends: depth, a, b, conv."""
    ends = stored(ends, "trie-ending")
    blocks = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ends.count() // piece))
    rows = stored(ends.repartitionByRange(blocks, *NODE, "conv").withColumn("block", F.spark_partition_id()), "trie-ends")
    pieces = stored(rows.groupBy("block", *NODE).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")), "trie-pieces")
    counted = pieces.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))  # one piece: the least is it
    single = counted.where("n = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    many = F.broadcast(counted.where("n > 1").select(*NODE))  # a block has two such nodes at most
    ordered = pieces.join(many, NODE, "left_semi").repartition(blocks, *NODE).sortWithinPartitions(*NODE, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for batch in batches:
            for *node, ids in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if node != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if at:
            out.append((*at, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])

    return single.unionByName(ordered.select(*NODE, "ids").mapInArrow(run, "depth long, a long, b long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node of the rebuilt conversations' trie."""
    role, text = whole(turns[role_col]), whole(turns[text_col])
    x = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].alias("turn"), x.alias("x"), F.length(text).cast("long").alias("chars")).where("conv is not null")
    rows, convs = rebuilt(rows)
    rows = stored(prefixes(rows), "trie-prefixes")
    found = rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("up_a", "up_b", "chars")])
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", none.alias("up_a"), none.alias("up_b"), zero.alias("chars"))
    nodes = stored(found.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stored(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-counted")
    parents = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").select(*NODE, (F.col("depth") - 1).alias("up_depth"), "up_a", "up_b")
    parent_of = by_pointer(below, ["up_depth", "up_a", "up_b"], parents, NODE, nodes.count()).select(*NODE, "parent_conv_id")
    last = rows.groupBy("conv").agg(F.max_by(F.struct(*NODE), "depth").alias("end"))
    ends = convs.join(last, "conv", "left").select(*[F.coalesce(f"end.{c}", zero).alias(c) for c in NODE], "conv")
    out = nodes.join(parent_of, NODE, "left").join(rolled_up(nodes).select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), NODE)
    out = out.join(ends_digests(ends), NODE, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: A byte into a checksum: eight shifts, by a reduction over eight elements after the first.
_SHIFTS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)"

SQL = f"""
WITH o AS (SELECT conv_id AS c, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({{'x': x, 'n': n}} ORDER BY turn NULLS FIRST, x) AS t FROM o GROUP BY c),
h AS (SELECT c, t, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {_SHIFTS.replace("[xor(c, b), 0", "[xor(c, b), 0::BIGINT")}), 4294967295::BIGINT) % {HEADS} AS h FROM l),
r AS (SELECT h.c, list_concat(coalesce(b.t[1 : h.h], []), h.t[h.h + 1 :]) AS t FROM h LEFT JOIN l b ON b.c = h.c - h.c % {FAMILY}),
p AS (SELECT c, d, array_to_string(list_transform(t[1 : d], lambda e: e.x), ',') AS k, array_to_string(list_transform(t[1 : d - 1], lambda e: e.x), ',') AS up, CASE WHEN d = 0 THEN 0 ELSE t[d].n END AS n, d = len(t) AS ends FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM r)),
g AS (SELECT k, d, min(c) AS c, any_value(up) AS up, count(*) AS m, (count(*) - 1) * max(n) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS e FROM p GROUP BY k, d),
u AS (SELECT up AS k, d - 1 AS d, count(*) AS kids FROM g WHERE d > 0 GROUP BY up, d - 1),
q AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN u USING (k, d)),
a AS (SELECT array_to_string(string_split(k, ',')[1 : i], ',') AS k, i AS d, sum((kids = 0)::INT) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS i FROM q) GROUP BY 1, 2)
SELECT q.c AS conv_id, q.d AS depth, f.c AS parent_conv_id, q.m AS n_convs, q.kids AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, q.e AS ends_sha256
FROM q JOIN a USING (k, d) LEFT JOIN g f ON q.d > 0 AND f.k = q.up AND f.d = q.d - 1
"""
