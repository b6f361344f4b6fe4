"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Each shard owns virtual nodes at hashed cells; a text hashes to a cell and belongs
to the shard of the next virtual node clockwise. A shard takes at most (1 + slack) times the mean number of bytes; what
would pass that goes on clockwise to the next shard with room, so loads are bounded whatever the data.

Groups of equal texts that weigh at least a thousandth of a mean shard go first, the largest first, each whole to the next
shard with room. A group that no shard has room for is dealt by its rows' hashes into pieces of about a thousandth of a
shard, which are placed like groups (`split` tells). The cells follow in ring order. What weighs no more than the slack
always finds a shard with room, since all shards full would hold more than there is; so a load passes its bound only by
part of a single item that outweighs the slack: one very long text, or rows equal in identifier and text.

Bounded tables reach the driver: the bytes of each cell, and at most 1,000 groups and 2,000 pieces a shard. That is meant
for up to about a thousand shards. Slots within a shard are numbered by sums over hash buckets, so no task holds a shard.

Defined results: null texts have size 1, like empty ones, and checksum 0. Repeated rows are separate rows of the same
shard, unless their group is split. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import stored, table, whole

#: Cells of the ring; their sizes are one bounded table on the driver.
CELLS = 65_536
#: Virtual nodes of a shard.
VIRTUAL = 64
#: What a shard may hold beyond the mean.
SLACK = 0.002
#: Groups of equal texts of at least this part of a mean shard are placed one by one.
HEAVY = 0.001
#: Hash buckets for numbering the rows of a shard.
SLOT_BUCKETS = 1024


class Ring:
    def __init__(self, shards: int, virtual: int = VIRTUAL):
        at = {}
        for shard in range(shards):
            for v in range(virtual):
                cell = int.from_bytes(hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest(), "big") % CELLS
                at.setdefault(cell, shard)
        self.nodes = sorted(at)
        owners = [at[c] for c in self.nodes]
        n = len(self.nodes)
        # For each virtual node the different shards in clockwise order from it, then any that own no node.
        self.order = [list(dict.fromkeys([*owners[i:], *owners[:i], *range(shards)])) for i in range(n)]

    def clockwise(self, cell: int) -> list[int]:
        return self.order[bisect.bisect_left(self.nodes, cell) % len(self.nodes)]


def room(cell: int, size: int, ring: Ring, load: list[int], cap: float) -> int | None:
    """The first shard clockwise that has room."""
    return next((s for s in ring.clockwise(cell) if load[s] + size <= cap), None)


def place(items: list[tuple[int, int]], ring: Ring, load: list[int], cap: float) -> list[int]:
    """Shards of (cell, size) in turn: the first clockwise with room; an item too large for any room goes to the emptiest."""
    out = []
    for cell, size in items:
        shard = room(cell, size, ring, load, cap)
        if shard is None:
            shard = min(range(len(load)), key=lambda s: (load[s], s))
        load[shard] += size
        out.append(shard)
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, crc, shard, slot, split (whether its group of equal texts is on several shards)."""
    spark = docs.sparkSession
    text = whole(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"))
    rows = stored(rows.withColumn("cell", F.pmod("h", F.lit(CELLS)).cast("int")).withColumn("salt", F.xxhash64("id", "h")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    unit = max(1.0, HEAVY * mean)
    groups = rows.groupBy("h").agg(F.first("cell").alias("cell"), F.sum("size").alias("size"))
    heavy = groups.where(F.col("size") >= unit).orderBy(F.desc("size"), "h").collect()  # at most shards / HEAVY rows
    ring, load, cap = Ring(shards), [0] * shards, (1 + SLACK) * mean
    units, dealt = [], []
    for g in heavy:
        to = room(g["cell"], g["size"], ring, load, cap)
        if to is None:
            dealt.append((g["h"], math.ceil(g["size"] / unit)))
        else:
            load[to] += g["size"]
            units.append((g["h"], -1, to))
    by_group = spark.createDataFrame(pd.DataFrame(dealt, columns=["h", "pieces"]).astype("int64"), "h long, pieces long")
    rows = rows.join(F.broadcast(by_group), "h", "left").withColumn("s", F.coalesce(F.pmod("salt", "pieces"), F.lit(-1)).cast("int"))  # fewer rows than heavy groups
    if dealt:
        pieces = rows.where("s >= 0").groupBy("h", "s").agg(F.first("cell").alias("cell"), F.sum("size").alias("size"), F.first("pieces").alias("pieces")).collect()  # at most 2 * shards / HEAVY rows
        pieces.sort(key=lambda p: (-p["size"], p["h"], p["s"]))
        # A piece starts elsewhere on the ring than its group, else they would all queue at the same shards.
        at = place([((p["cell"] + p["s"] * CELLS // p["pieces"]) % CELLS, p["size"]) for p in pieces], ring, load, cap)
        units += [(p["h"], p["s"], to) for p, to in zip(pieces, at, strict=True)]
    cells = {r["cell"]: r["size"] for r in rows.groupBy("cell").agg(F.sum("size").alias("size")).collect()}  # at most CELLS rows
    for g in heavy:
        cells[g["cell"]] -= g["size"]
    light = sorted((c, s) for c, s in cells.items() if s)
    cell_shards = place(light, ring, load, cap)
    by_unit = spark.createDataFrame(pd.DataFrame(units, columns=["h", "s", "unit_shard"]).astype({"h": "int64", "s": "int32", "unit_shard": "int32"}), "h long, s int, unit_shard int")
    by_cell = spark.createDataFrame(pd.DataFrame({"cell": [c for c, _ in light], "cell_shard": cell_shards}).astype("int32"), "cell int, cell_shard int")
    placed = (
        rows.join(F.broadcast(by_unit), ["h", "s"], "left")  # at most 3 * shards / HEAVY rows
        .join(F.broadcast(by_cell), "cell", "left")  # at most CELLS rows
        .withColumn("shard", F.coalesce("unit_shard", "cell_shard", F.lit(0)))
        .withColumn("bucket", F.pmod(F.xxhash64("h", "id"), F.lit(SLOT_BUCKETS)))
        .select("id", "size", "crc", "h", "shard", "bucket", (F.col("s") >= 0).alias("split"))
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    numbered = placed.withColumn("i", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "h")))
    slot = (F.col("offset") + F.col("i") - 1).cast("long").alias("slot")
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select("id", "size", "crc", "shard", slot, "split")  # shards * SLOT_BUCKETS rows


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), 8)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "split")
