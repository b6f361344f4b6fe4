"""Changes of a library: a feed's arrivals put in, duplicates merged, captures deleted, each over all tables at once.

A library is a dict of tables: captures (id, url_hash, doi, created_at, updated_at, ...), texts (capture_id, content_text),
items (collection_id, capture_id, added_at) and postings (capture_id, field, token). A Delta says which rows come and whose
rows go; applied() gives the tables as they become. Asking for what can't be raises collections.CollectionError or
ArrivalError, before anything is written. Null URL hashes count as the hash of nothing, one and the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators import collections, fulltext, graph, identity
from folioforge.operators.collections import CollectionError, without

#: How tables name their capture.
KEYS = {"captures": "id", "texts": "capture_id", "items": "capture_id", "postings": "capture_id"}
#: The same with the table of artifacts (capture_id, name, text), which a library may have.
KEY_OF = KEYS | {"artifacts": "capture_id"}


class ArrivalError(ValueError):
    """Arrivals that can't be told apart."""


@dataclass
class Delta:
    """A change: by table, the rows that come, and the captures (capture_id) whose rows before it go."""

    comes: dict[str, DataFrame] = field(default_factory=dict)
    goes: dict[str, DataFrame] = field(default_factory=dict)
    merges: DataFrame | None = None  # keep, gone


def applied(tables: dict[str, DataFrame], delta: Delta) -> dict[str, DataFrame]:
    """All tables as they are after a change."""
    out = dict(tables)
    for name, gone in delta.goes.items():
        out[name] = without(out[name], gone, KEY_OF[name]).select(*out[name].columns)
    for name, new in delta.comes.items():
        out[name] = out[name].unionByName(new.select(*out[name].columns))
    return out


def form_ids(values) -> list[str]:
    """Identifiers from a form: one or a list; trimmed, without blanks and repeats, in order."""
    many = values if isinstance(values, list) else [] if values is None else [values]
    return list(dict.fromkeys(s for v in many if v is not None and (s := str(v).strip())))


def deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the captures listed (capture_id)."""
    return {name: without(df, ids, KEY_OF[name]) for name, df in tables.items()}


def final_merges(merges: DataFrame) -> DataFrame:
    """keep, gone: where merges (keep, gone) lead in the end. Of several keepers the smallest counts; of captures merged in a circle the smallest stays."""
    named = graph.stored(merges.where("gone != keep").groupBy("gone").agg(F.min("keep").alias("keep")), "merges-named")
    found = graph.stored(graph.components(named.select(F.col("gone").alias("a"), F.col("keep").alias("b"))), "merges-trees")
    ends = found.join(named.select(F.col("gone").alias("node")), "node", "left_anti").select("root", F.col("node").alias("end"))  # one a tree, none in a circle
    told = found.join(ends, "root", "left").select(F.coalesce("end", "root").alias("keep"), F.col("node").alias("gone"))
    return told.where("keep != gone")


def _moved(items: DataFrame, merges: DataFrame) -> DataFrame:
    """The memberships of all captures that merges (final ones) name, as the keepers' own: of a keeper's own and those that come, its own tells when, else the earliest."""
    keepers = merges.select("keep", F.col("keep").alias("was")).distinct()
    names = keepers.unionByName(merges.select("keep", F.col("gone").alias("was")))
    moved = items.join(names, items["capture_id"] == names["was"]).select("collection_id", F.col("keep").alias("capture_id"), "added_at", (F.col("keep") != F.col("was")).alias("moved"))
    return moved.groupBy("collection_id", "capture_id").agg(F.min(F.struct("moved", "added_at"))["added_at"].alias("added_at"))


def _named_by(merges: DataFrame) -> DataFrame:
    """capture_id: all captures that merges name."""
    return merges.select(F.col("gone").alias("capture_id")).unionByName(merges.select(F.col("keep").alias("capture_id"))).distinct()


def merged(tables: dict[str, DataFrame], merges: DataFrame) -> dict[str, DataFrame]:
    """Captures merged into others (keep, gone), chains to their end: memberships move, the rest of what is gone goes. A merge into what is no capture changes nothing."""
    final = final_merges(merges)
    if "captures" in tables:
        final = final.join(tables["captures"].select(F.col("id").alias("keep")), "keep", "left_semi")
    final = graph.stored(final, "merges")
    gone = final.select(F.col("gone").alias("capture_id"))
    delta = Delta({"items": _moved(tables["items"], final)}, {name: _named_by(final) if name == "items" else gone for name in tables if name in KEY_OF})
    return applied(tables, delta)


def upserted(old: DataFrame, new: DataFrame, key: str = "id", kept: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of `new` in place of those with their key; the columns in `kept` stay as they were. Both have the same columns, and a key once."""
    o, n = old.withColumn("was", F.lit(True)).alias("o"), new.withColumn("comes", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    pick = lambda c: F.when(F.col("n.comes") & ~(F.col("o.was").isNotNull() & F.lit(c in kept)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(*[pick(c) for c in old.columns])


def _once(arrivals: DataFrame, columns: list[str]) -> DataFrame:
    """Arrivals stored, a row each: repeats of one count once. An arrival without number or time, or a number that two arrivals have, raises."""
    cells = F.xxhash64(*[F.col(c).cast("string") for c in columns])
    found = arrivals.groupBy(F.col("seq").cast("long").alias("seq")).agg(F.any_value(F.struct(*columns)).alias("row"), F.min(cells).alias("low"), F.max(cells).alias("high"))
    found = graph.stored(found, "feed-arrivals")
    if not found.where("seq is null or row.captured_at is null or low != high").isEmpty():
        raise ArrivalError("Every arrival needs captured_at and a seq of its own.")
    return found.select("seq", *[F.col(f"row.{c}").alias(c) for c in columns if c != "seq"])


def _key(kind: str, c: str | Column) -> Column:
    return F.concat(F.lit(kind), c)


def _new_id(url_hash: Column, seq: Column) -> Column:
    return F.concat(F.substring(url_hash, 1, 16), F.lit("-"), seq.cast("string"))


def touched(captures: DataFrame, arrivals: DataFrame) -> DataFrame:
    """id, url_hash, doi, created_at of the captures that arrivals may reach: those with the DOI or URL hash of one, or the identifier that one would have.

    Nothing else is reached: an arrival takes over its DOI's and its URL hash's owner as they are, and these either have
    them from before or from another arrival. Only three columns of captures are read, and no capture is shuffled by more
    than its keys.
    """
    hash_of = F.coalesce("url_hash", F.lit(""))
    keys = arrivals.select(F.explode(F.array(_key("u", hash_of), _key("d", F.nullif("doi", F.lit(""))), _key("i", _new_id(hash_of, F.col("seq"))))).alias("key")).where("key is not null").distinct()
    each = captures.select("id", hash_of.alias("url_hash"), "doi", "created_at", F.explode(F.array(_key("u", hash_of), _key("d", F.nullif("doi", F.lit(""))), _key("i", F.col("id")))).alias("key"))
    return each.join(keys, "key", "left_semi").drop("key").dropDuplicates(["id"])


def feed(tables: dict[str, DataFrame], arrivals: DataFrame, now: str) -> Delta:
    """The change that a feed's arrivals make: captured_at, seq, url_hash, doi, content_text and the other columns of captures.

    Arrivals find their capture by DOI, then URL hash, in order of (captured_at, seq); where both find one and they differ, the
    latter is merged into the former. A capture is as its last arrival was; created_at stays, or is that of its first arrival.
    Only captures that arrivals reach are folded. A seq is a whole number that no other arrival of the library has or had:
    new captures are named by it.
    """
    captures, hash_of = tables["captures"], F.coalesce("url_hash", F.lit(""))
    columns = ["captured_at", "seq", "url_hash", "doi", "content_text"]
    rows = _once(arrivals, columns + [c for c in captures.columns if c not in ("id", "created_at", "updated_at", *columns)])
    known = graph.stored(touched(captures, rows), "feed-touched")
    at = lambda new, captured_at, seq, name: F.struct(F.lit(new).alias("new"), captured_at.cast("string").alias("captured_at"), seq.cast("long").alias("seq"), name.alias("id")).alias("at")
    came = rows.select(hash_of.alias("url_hash"), "doi", at(1, F.col("captured_at"), F.col("seq"), F.lit("")))
    flows = identity.flows(known.select("url_hash", "doi", at(0, F.lit(""), F.lit(0), F.col("id"))).unionByName(came))
    is_known = F.col("chain.new") == 0
    name = F.when(is_known, F.col("chain.id")).otherwise(_new_id(F.col("begun"), F.col("chain.seq")))
    named = graph.stored(flows.select("tree", "chain", "last", name.alias("name"), is_known.alias("known")), "feed-named")
    live = named.groupBy("tree").agg(F.max_by(F.struct("name", "chain", "last", "known"), "last").alias("c")).select("tree", F.col("c.name").alias("keep"), F.col("c.chain").alias("keep_chain"), F.col("c.last").alias("last"), F.col("c.known").alias("known"))
    live = graph.stored(live, "feed-live")
    if not live.where("not known").join(known.select(F.col("id").alias("keep")), "keep", "left_semi").isEmpty():
        raise ArrivalError("An earlier arrival had this seq.")
    merges = named.where("known").join(live.select("tree", "keep", "keep_chain"), "tree").where("chain != keep_chain").select("keep", F.col("name").alias("gone"))
    merges = graph.stored(merges, "feed-merges")
    ends = live.where("last.new = 1").select("keep", F.col("keep_chain.captured_at").alias("first_at"), F.col("last.seq").alias("seq"))
    new = rows.join(ends, "seq").join(known.select(F.col("id").alias("keep"), F.col("created_at").alias("was_created")), "keep", "left")
    as_row = {"id": F.col("keep"), "created_at": F.coalesce("was_created", "first_at"), "updated_at": F.lit(now), "url_hash": hash_of}
    new_rows = new.select(*[as_row.get(c, F.col(c)).alias(c) for c in captures.columns])
    texts = new.select(F.col("keep").alias("capture_id"), "content_text")
    gone = merges.select(F.col("gone").alias("capture_id"))
    replaced_ids = graph.stored(ends.select(F.col("keep").alias("capture_id")).unionByName(gone), "feed-replaced")
    return Delta(
        {"captures": new_rows, "texts": texts, "postings": fulltext.postings(new_rows.select("id", "title"), texts), "items": _moved(tables["items"], merges)},
        {"captures": replaced_ids, "texts": replaced_ids, "postings": replaced_ids, "items": _named_by(merges)}, merges,
    )


def fed(tables: dict[str, DataFrame], arrivals: DataFrame, now: str) -> dict[str, DataFrame]:
    """The library after a feed's arrivals, see feed()."""
    return applied(tables, feed(tables, arrivals, now))


def taken(captures: DataFrame, rows: DataFrame, gone: DataFrame, unique: tuple[str, ...] = ("doi",)) -> DataFrame:
    """capture_id, owner: rows of a late change whose key (the first of `unique` that is so) another capture has.

    A capture that the change itself rewrites leaves its key free, unless its own row can't be put in. gone: capture_id.
    """
    key_of = lambda df, name: df.select(F.col("id").alias(name), F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.nullif(F.col(c), F.lit("")).alias("key")) for i, c in enumerate(unique)])).alias("k"))
    held = key_of(captures, "owner").join(gone.select(F.col("capture_id").alias("owner")), "owner", "left_anti")
    met = graph.stored(key_of(rows, "capture_id").where("k.key is not null").join(held, "k").where("owner != capture_id").select("capture_id", "owner", F.col("k.nth").alias("nth")), "late-met")
    out, before = None, -1
    while True:
        free = rows.select(F.col("id").alias("owner"))
        if out is not None:
            free = free.join(out.select(F.col("capture_id").alias("owner")), "owner", "left_anti")
        out = graph.stored(met.join(free, "owner", "left_anti").groupBy("capture_id").agg(F.min(F.struct("nth", "owner"))["owner"].alias("owner")), "late-taken")
        now = out.count()
        if now == before:
            return out
        before = now


def rebased(tables: dict[str, DataFrame], delta: Delta, written: DataFrame | None = None, unique: tuple[str, ...] = ("doi",)) -> tuple[Delta, DataFrame]:
    """A change that was made for an earlier version, for the tables as they have become meanwhile; and its rows that can't be put in (capture_id, owner).

    Where another capture has taken a row's key meanwhile, the row and its text are not put in: what is indexed is of the
    owner from now on, whose own row and text stay, and the row's artifacts, with those its capture had, go to the owner
    under the names that it has none of. Of several rows that go to one owner, the last in order of identifiers is indexed,
    and the first fills a name. Other rows, and merges into what is there, are put in as they were to be; memberships move
    from where they are now. written: the artifacts of the change's captures (capture_id, name, text).
    """
    rows, merges = delta.comes["captures"], delta.merges
    rerouted = taken(tables["captures"], rows, merges.select(F.col("gone").alias("capture_id")), unique)
    kept = lambda df, key="capture_id": without(df, rerouted, key)
    there = tables["captures"].select(F.col("id").alias("keep")).unionByName(kept(rows, "id").select(F.col("id").alias("keep")))
    still = graph.stored(merges.join(there, "keep", "left_semi"), "late-merges")
    gone = still.select(F.col("gone").alias("capture_id"))
    not_gone = merges.join(gone.select(F.col("capture_id").alias("gone")), "gone", "left_anti").select(F.col("gone").alias("capture_id"))
    goes = lambda name: without(kept(delta.goes[name]), not_gone)
    shadowed = without(rerouted, rerouted.groupBy("owner").agg(F.max("capture_id").alias("capture_id")).select("capture_id")).select("capture_id")
    postings = without(delta.comes["postings"], shadowed).join(rerouted, "capture_id", "left").select(F.coalesce("owner", "capture_id").alias("capture_id"), "field", "token")
    owners = rerouted.select(F.col("owner").alias("capture_id"))
    out = Delta(
        {"captures": kept(rows, "id"), "texts": kept(delta.comes["texts"]), "postings": postings, "items": _moved(tables["items"], still)},
        {"captures": goes("captures"), "texts": goes("texts"), "postings": goes("postings").unionByName(owners).distinct(), "items": _named_by(still)}, still,
    )
    if written is not None:
        file = ["capture_id", "name"]
        old = without(tables["artifacts"], gone).join(written.select(*file), file, "left_anti").unionByName(written)  # folders as the change leaves them
        here = kept(old)
        moved = old.join(rerouted, "capture_id").groupBy(F.col("owner").alias("owner"), "name").agg(F.min_by("text", "capture_id").alias("text"))
        filled = moved.select(F.col("owner").alias("capture_id"), "name", "text").join(here.select(*file), file, "left_anti")
        changed = gone.unionByName(rerouted.select("capture_id")).unionByName(written.select("capture_id")).unionByName(owners).distinct()
        out.comes["artifacts"], out.goes["artifacts"] = here.unionByName(filled).join(changed, "capture_id", "left_semi"), changed
    return out, rerouted


def _some_of(captures: DataFrame, ids: list[str]) -> DataFrame:
    """The captures of a list that exist."""
    if not ids:
        raise CollectionError("No captures selected.")
    there = captures.where(F.col("id").isin(ids)).select(F.col("id").alias("capture_id"))
    if there.isEmpty():
        raise CollectionError("No matching captures found.")
    return there


def _collection(tables: dict[str, DataFrame], collection_id: int | None) -> int:
    if not collection_id or collection_id <= 0:
        raise CollectionError("Choose a collection.")
    if tables["collections"].where(F.col("id") == collection_id).isEmpty():
        raise CollectionError("Collection not found.")
    return collection_id


def delete_selected(tables: dict[str, DataFrame], values) -> dict[str, DataFrame]:
    """A form's captures deleted from every table."""
    ids = _some_of(tables["captures"], form_ids(values))
    return deleted({name: df for name, df in tables.items() if name in KEY_OF}, ids)


def add_selected(tables: dict[str, DataFrame], values, collection_id: int | None, now: str) -> dict[str, DataFrame]:
    """A form's captures added to a collection; all of those that exist count as touched."""
    if not form_ids(values):
        raise CollectionError("No captures selected.")
    collection_id = _collection(tables, collection_id)
    ids = _some_of(tables["captures"], form_ids(values))
    new = collections.added(tables["items"], ids, collection_id, now)
    return {"items": tables["items"].unionByName(new), "captures": collections.touched(tables["captures"], ids, now)}


def remove_selected(tables: dict[str, DataFrame], values, collection_id: int | None, now: str) -> dict[str, DataFrame]:
    """A form's captures taken from a collection; all of those that exist count as touched."""
    if not form_ids(values):
        raise CollectionError("No captures selected.")
    collection_id = _collection(tables, collection_id)
    ids = _some_of(tables["captures"], form_ids(values))
    gone = ids.withColumn("collection_id", F.lit(collection_id).cast(tables["items"].schema["collection_id"].dataType))
    return {"items": tables["items"].join(gone, ["collection_id", "capture_id"], "left_anti").select(*tables["items"].columns), "captures": collections.touched(tables["captures"], ids, now)}


def delete_collection(tables: dict[str, DataFrame], collection_id: int | None) -> dict[str, DataFrame]:
    collection_id = _collection(tables, collection_id)
    return {"collections": tables["collections"].where(F.col("id") != collection_id), "items": tables["items"].where(F.col("collection_id") != collection_id)}
