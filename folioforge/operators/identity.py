"""Which captures are the same work: the arrival-order fold over DOI and URL hash.

Each live capture owns one (doi, url_hash) pair, which every arrival that hits it overwrites. An arrival with a DOI hits
that DOI's owner, and another owner of its URL hash is merged into it; else it hits its URL hash's owner; else it is new.
So a capture stays as an arrival left it until the next arrival at its DOI or its URL hash: windows by each of them tell
which arrival takes it over, and connected components of these links are the captures.
Windows go over blocks of the log in order, and what lies at their edges is handed on, so no task holds a URL hash or a DOI.
A log without DOIs needs no links: the latest row of each URL hash is the answer. (captured_at, seq) tells arrivals apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import graph


def latest_per_url(log: DataFrame) -> DataFrame:
    """The latest row of each url_hash with its first captured_at as created_at. log: url_hash, captured_at, seq, ..."""
    row = F.struct(*[F.col(c) for c in log.columns])
    # Aggregates, so that a URL with many captures folds before it moves.
    latest = log.groupBy("url_hash").agg(F.max_by(row, F.struct("captured_at", "seq")).alias("row"), F.min("captured_at").alias("created_at"))
    return latest.select("row.*", "created_at")


def _blocks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows stored in order of key and arrival; `name` numbers the consecutive blocks in which they lie. A key may have many blocks, so that no task holds all of it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return graph.stored(rows.repartitionByRange(n, key, "at").withColumn(name, F.spark_partition_id()), "identity-blocks")


def _beside(rows: DataFrame, key: str, block: str, columns: list[str], ahead: bool) -> DataFrame:
    """rows with `beside`: those columns of the key's next arrival (of the one before, if not ahead), null if there is none."""
    shift, edge_of = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    held = F.struct(key, *columns)
    edges = rows.groupBy(block).agg(edge_of(held, F.struct(key, "at")).alias("edge")).select(block, shift("edge").over(Window.orderBy(block)).alias("edge"))
    found = rows.withColumn("here", shift(held).over(Window.partitionBy(block, key).orderBy("at"))).join(F.broadcast(edges), block)  # one edge a block
    return found.withColumn("beside", F.coalesce("here", F.when(F.col("edge")[key] == F.col(key), F.col("edge")))).drop("here", "edge")


def runs(log: DataFrame) -> DataFrame:
    """first, last, url_hash, doi, arrivals, next, merges: arrivals at one URL hash, each taking over the capture of the one before. log: url_hash, doi, at (their order).

    `next` is the first arrival of the run that takes the capture over, null if it lives on; `merges` tells that it is merged there.
    An arrival leaves a capture with its own DOI and URL hash, which the next arrival at either of them takes over.
    """
    doi = F.coalesce("doi", F.lit(""))
    rows = _blocks(log.select(F.coalesce("url_hash", F.lit("")).alias("url_hash"), "doi", "at"), "url_hash", "block")
    by_url = lambda df, columns, ahead: _beside(df, "url_hash", "block", columns, ahead)
    by_doi = lambda df, columns, ahead: _beside(df, "doi", "doi_block", columns, ahead)
    rows = by_url(rows, ["at"], True).withColumn("next_url", F.col("beside.at")).drop("beside")
    no_doi = rows.where(doi == "").withColumn("next_doi", F.lit(None).cast(rows.schema["at"].dataType)).withColumn("owned", F.lit(False))
    some_doi = _blocks(rows.where(doi != ""), "doi", "doi_block")
    some_doi = by_doi(some_doi, ["at"], True).withColumn("next_doi", F.col("beside.at")).drop("beside")
    before = F.col("beside.next_url")
    # The DOI's last arrival still owns it unless its URL hash had another arrival since.
    owned = F.col("beside").isNotNull() & (before.isNull() | (before >= F.col("at")))
    some_doi = by_doi(some_doi, ["at", "next_url"], False).withColumn("owned", owned).drop("beside", "doi_block")
    rows = graph.stored(no_doi.unionByName(some_doi), "identity-next")
    rows = rows.withColumn("next", F.least("next_url", "next_doi")).withColumn("by_url", F.coalesce(F.col("next") == F.col("next_url"), F.lit(False))).withColumn("by_doi", F.coalesce(F.col("next") == F.col("next_doi"), F.lit(False)))
    # A capture reached by its URL hash alone is merged if the DOI has an owner.
    merges = F.col("by_url") & ~F.col("by_doi") & F.coalesce("beside.owned", F.lit(False))
    rows = by_url(rows, ["owned"], True).withColumn("merges", merges).withColumn("goes_on", F.col("by_url") & ~F.col("merges")).drop("beside")
    rows = by_url(rows, ["goes_on"], False).withColumn("starts", ~F.coalesce("beside.goes_on", F.lit(False))).drop("beside")
    # A run is known by its first arrival; where that is in no block of its own, in the last block before that has one.
    so_far = Window.partitionBy("block", "url_hash").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("here", F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(so_far))
    ends = rows.groupBy("block").agg(F.max_by(F.struct("here"), F.struct("url_hash", "at")).alias("end"))
    carried = ends.select("block", F.last("end.here", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.join(F.broadcast(carried), "block").withColumn("first", F.coalesce("here", "carried"))  # one row a block
    end = F.max_by(F.struct("doi", "next", "merges"), "at").alias("end")
    found = rows.groupBy("url_hash", "first").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("arrivals"), end)
    return found.select("first", "last", "url_hash", "end.doi", "arrivals", "end.next", "end.merges")


def flows(log: DataFrame) -> DataFrame:
    """tree, chain, begun, ended, last, arrivals: one row a capture that ever was. `chain` is its first arrival; captures that flowed together share a tree."""
    found = graph.stored(runs(log), "identity-runs")
    goes_on = found.where("next is not null and not merges").select(F.col("first").alias("a"), F.col("next").alias("b"))
    chains = graph.components(goes_on).select(F.col("node").alias("first"), F.col("root").alias("chain"))
    rows = graph.stored(found.join(chains, "first", "left").withColumn("chain", F.coalesce("chain", "first")), "identity-chains")
    into = rows.select(F.col("first").alias("next"), F.col("chain").alias("b"))
    trees = graph.components(rows.where("next is not null and merges").select("next", F.col("chain").alias("a")).join(into, "next").select("a", "b"))
    begun, ended = F.min_by("url_hash", "first").alias("begun"), F.max_by(F.struct("url_hash", "doi"), "last").alias("ended")
    captures = rows.groupBy("chain").agg(begun, ended, F.max("last").alias("last"), F.sum("arrivals").alias("arrivals"))
    return captures.join(trees.select(F.col("node").alias("chain"), F.col("root").alias("tree")), "chain", "left").withColumn("tree", F.coalesce("tree", "chain"))


def resolve(log: DataFrame) -> DataFrame:
    """capture_id, doi, url_hash, first_seq, last_seq, arrivals, merged: one row per live capture. log: url_hash (null as empty), doi, captured_at, seq."""
    captures = flows(log.select("url_hash", "doi", F.struct("captured_at", "seq").alias("at")))
    # The last arrival of all that flowed together is at the capture that lives on.
    live = captures.groupBy("tree").agg(F.max_by(F.struct("chain", "begun", "ended", "last", "arrivals"), "last").alias("c"), (F.count(F.lit(1)) - 1).alias("merged"))
    seq = F.col("c.chain.seq")
    return live.select(
        F.concat(F.substring("c.begun", 1, 16), F.lit("-"), seq.cast("string")).alias("capture_id"), F.col("c.ended.doi").alias("doi"), F.col("c.ended.url_hash").alias("url_hash"),
        seq.cast("long").alias("first_seq"), F.col("c.last.seq").cast("long").alias("last_seq"), F.col("c.arrivals").alias("arrivals"), "merged",
    )


def latest_artifacts(log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each key the latest value of each column that is not null: a later capture without an artifact keeps the earlier one."""
    order = F.struct("captured_at", "seq")
    return log.groupBy(key).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])
