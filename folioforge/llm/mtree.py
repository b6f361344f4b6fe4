"""Exact top-k search by inner product in M-trees, searched best first.

A vector x at distance d from a pivot p has q·x <= q·p + |q| d for every query q. So a node with a pivot, a covering radius
and its pivot's distance to its parent's pivot bounds all scores below it: from the parent's score alone by the triangle
inequality, q·parent + |q| (distance + radius), and tighter from its own pivot's score. Leaves are pages of vectors with
their distances to the pivot, the largest first, so what a page still has to offer is a beginning of it. A search takes
each query's leaf of the largest bound next, together for the queries of a block that ask for the same leaf, and ends
where no bound reaches the k-th best score. Scores are whole numbers; bounds are loosened by more than rounding, so
results are exact.

Spark deals the vectors to trees: by the nearest of at most PIVOTS pivots, and by hash within a pivot's cell of more than
TREE_ROWS rows, so no group of equal or close vectors makes a large tree. Trees are built once and stored, one row a node.
First each query searches its own tree; then it goes, with the k-th best score it found, to the trees whose root's bound
reaches that score, in blocks of about QUERY_ROWS queries. Where there are more than ROUTED trees, every query goes to
every tree, and the bounds apply there.

Defined results: vectors that are null, empty or hold a null or a number that is not finite take no part, nor do rows
without identifier. Vectors meet only vectors of their own length. Ties go to the smaller identifier. Rows that share a
query's identifier are its own; other repeated rows each count. Query rows equal in identifier and vector are one query;
an identifier with several vectors asks with each, and each has ranks of its own. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import stored, table

#: Vectors in a tree, about, and queries in a block, about.
TREE_ROWS, QUERY_ROWS = 4096, 4096
#: Pivots that vectors are dealt by, at most, and roots that queries are held against before they are sent, at most.
PIVOTS, ROUTED = 1024, 20_000
#: Entries of a leaf, and children of an inner node, at most about.
PAGE, FANOUT = 128, 16
#: What is added to every bound, in parts of the largest possible score.
LOOSE = 1e-9
#: Partitions that trees are dealt to, at most; a partition can hold many.
MOST_PARTITIONS = 20_000

TREE = ["dim", "cell", "part"]
NODES = "dim int, cell int, part int, node int, parent int, pivot binary, radius double, parent_distance double, ids binary, vectors binary, distances binary"


def _reach(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(axis=1))


def build(ids: np.ndarray, vectors: np.ndarray) -> list[dict]:
    """The nodes of a tree over some whole-number vectors (int64), parents first."""
    points, nodes = vectors.astype(np.float64), []
    todo = [(np.arange(len(ids)), 0, -1, 0.0)] if len(ids) else []
    while todo:
        rows, pivot, parent, parent_distance = todo.pop()
        reach = _reach(points[rows], points[pivot])
        number = len(nodes)
        node = {"node": number, "parent": parent, "pivot": vectors[pivot].tobytes(), "radius": float(reach.max()), "parent_distance": parent_distance, "ids": None, "vectors": None, "distances": None}
        nodes.append(node)
        if len(rows) <= PAGE:
            far = np.lexsort((ids[rows], -reach))
            node |= {"ids": ids[rows[far]].tobytes(), "vectors": vectors[rows[far]].tobytes(), "distances": reach[far].tobytes()}
            continue
        # Pivots far from each other, the first the farthest from this node's pivot.
        width = min(FANOUT, -(-len(rows) // PAGE) + 1)
        pivots = [int(reach.argmax())]
        to = [_reach(points[rows], points[rows[pivots[0]]])]
        nearest = to[0].copy()
        while len(pivots) < width and nearest.max() > 0:
            pivots.append(int(nearest.argmax()))
            to.append(_reach(points[rows], points[rows[pivots[-1]]]))
            np.minimum(nearest, to[-1], out=nearest)
        if len(pivots) == 1:  # all the same vector
            parts = [(pivots[0], part) for part in np.array_split(np.arange(len(rows)), FANOUT)]
        else:
            owner = np.argmin(np.stack(to), axis=0)
            parts = [(p, np.flatnonzero(owner == k)) for k, p in enumerate(pivots)]
        todo += [(rows[part], rows[p], number, float(reach[p])) for p, part in parts if len(part)]
    return nodes


class Tree:
    """A stored tree's nodes, for searching. `computed` counts the scores of pivots and entries that were computed."""

    def __init__(self, nodes: pd.DataFrame, dim: int):
        nodes = nodes.sort_values("node")
        self.parent, self.radius, self.parent_distance = (nodes[c].to_numpy() for c in ("parent", "radius", "parent_distance"))
        self.pivots = np.stack([np.frombuffer(p, np.int64) for p in nodes["pivot"]]).astype(np.float64)
        self.ids = [None if x is None else np.frombuffer(x, np.int64) for x in nodes["ids"]]
        self.vectors = [None if x is None else np.frombuffer(x, np.int64).reshape(-1, dim) for x in nodes["vectors"]]
        self.distances = [None if x is None else np.frombuffer(x, np.float64) for x in nodes["distances"]]
        self.children: dict[int, list[int]] = {}
        for i, p in enumerate(self.parent):
            self.children.setdefault(int(p), []).append(i)
        self.computed = 0

    def _bounds(self, q: np.ndarray, norms: np.ndarray, loose: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the pivots and bounds of the nodes, queries by nodes; -inf where an ancestor rules the node out."""
        score, bound = np.full((len(q), len(self.radius)), -np.inf), np.full((len(q), len(self.radius)), -np.inf)
        level = np.array(self.children[-1])
        while len(level):
            up = self.parent[level]
            if up[0] < 0:
                wanted = np.ones((len(q), len(level)), dtype=bool)
            else:  # before any score of these pivots is computed
                wanted = (bound[:, up] > -np.inf) & (score[:, up] + norms[:, None] * (self.parent_distance + self.radius)[level] + loose[:, None] >= cut[:, None])
            level, wanted = level[wanted.any(axis=0)], wanted[:, wanted.any(axis=0)]
            if not len(level):
                break
            asks = wanted.any(axis=1)
            score[np.ix_(asks, level)] = q[asks] @ self.pivots[level].T
            self.computed += int(asks.sum()) * len(level)
            reached = score[:, level] + norms[:, None] * self.radius[level] + loose[:, None]
            bound[:, level] = np.where(wanted & (reached >= cut[:, None]), reached, -np.inf)
            level = np.array([c for n in level for c in self.children.get(int(n), ())], dtype=np.int64)
        return score, bound

    def search(self, query_ids: np.ndarray, queries: np.ndarray, cuts: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, identifiers and scores of its k largest products that reach its cut, ties to the smaller identifier."""
        q = queries.astype(np.float64)
        norms = np.sqrt((q**2).sum(axis=1))
        peak = max(float(np.abs(q).max(initial=0)), max((float(np.abs(v).max(initial=0)) for v in self.vectors if v is not None), default=0.0))
        exact = peak * peak * q.shape[1] < 2**52  # then products of doubles are whole and exact, and much faster
        loose = LOOSE * (norms * peak * np.sqrt(q.shape[1]) + 1)
        cut = cuts.astype(np.float64).copy()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(len(q))]
        score, bound = self._bounds(q, norms, loose, cut)
        leaves = np.array([i for i, v in enumerate(self.vectors) if v is not None])
        order = np.argsort(-bound[:, leaves], axis=1, kind="stable")
        for turn in range(len(leaves)):
            leaf = leaves[order[:, turn]]
            most = bound[np.arange(len(q)), leaf]
            asking = np.flatnonzero((most >= cut) & (most > -np.inf))
            if not len(asking):
                break
            for n in np.unique(leaf[asking]):
                rows = asking[leaf[asking] == n]
                # From this distance on entries may reach the cut; they come first in the page.
                least = (cut[rows] - loose[rows] - score[rows, n]) / np.maximum(norms[rows], 1e-300)
                length = int(np.searchsorted(-self.distances[n], -least.min(), side="right")) if np.isfinite(least.min()) else len(self.distances[n])
                ids, x = self.ids[n][:length], self.vectors[n][:length]
                self.computed += len(rows) * length
                found = (q[rows] @ x.T.astype(np.float64)).astype(np.int64) if exact else queries[rows] @ x.T
                good = (found >= cut[rows][:, None]) & (ids[None, :] != query_ids[rows][:, None])
                for r in np.flatnonzero(good.any(axis=1)):
                    i = rows[r]
                    all_ids, all_scores = np.concatenate([best[i][0], ids[good[r]]]), np.concatenate([best[i][1], found[r][good[r]]])
                    top = np.lexsort((all_ids, -all_scores))[:k]
                    best[i] = all_ids[top], all_scores[top]
                    if len(top) == k:
                        cut[i] = max(cut[i], float(best[i][1][-1]))
        return best


def _matrix(cells, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int64).reshape(-1, dim)


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with vectors as bytes and `cell`, the nearest pivot of their length. rows: id, v, asks, dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cells, data = np.zeros(len(dims), np.int32), np.empty(len(dims), dtype=object)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
                p, x = pivots[int(d)].astype(np.float64), v.astype(np.float64)
                cells[at] = np.argmin((p**2).sum(axis=1)[None, :] - 2 * (x @ p.T), axis=1)
                for i, row in zip(at, v, strict=True):
                    data[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data.tolist(), pa.binary()), batch.column(2), batch.column(3), pa.array(cells)], ["id", "v", "asks", "dim", "cell"])

    return rows.mapInArrow(run, "id long, v binary, asks boolean, dim int, cell int")


def _nodes(frame: pd.DataFrame) -> pd.DataFrame:
    dim, cell, part = (int(frame[c].iloc[0]) for c in TREE)
    out = pd.DataFrame(build(frame["id"].to_numpy(), _matrix(frame["v"], dim)))
    out.insert(0, "part", part)
    out.insert(0, "cell", cell)
    out.insert(0, "dim", dim)
    return out


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for which `queries` holds."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    rows = stored(rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), "asks", F.size("v").alias("dim")), "mtree-vectors")
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a length of vector
    pivots = {}
    for d, n in counts:
        wanted = min(PIVOTS, -(-n // TREE_ROWS))
        some = rows.where(F.col("dim") == d).orderBy(F.xxhash64("id"), "id").select("v").limit(8 * wanted).collect()  # at most 8 * PIVOTS vectors
        pivots[d] = np.array(list(dict.fromkeys(tuple(r["v"]) for r in some))[:wanted], dtype=np.int64)
    dealt = stored(_dealt(rows, pivots), "mtree-dealt")
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), "parts").cast("int")).drop("parts")  # at most PIVOTS rows a length
    trees = int(sizes.agg(F.sum("parts")).first()[0] or 0)
    spread = min(MOST_PARTITIONS, max(4 * trees, 8))  # a number of its own: adaptive execution would put small trees, which take long, into one task
    nodes = stored(dealt.select("id", "v", *TREE).repartition(spread, *TREE).groupBy(*TREE).applyInPandas(_nodes, NODES), "mtree-nodes")

    def own(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("q", "query_id", "v", *TREE, "ids", "scores")})
        dim = int(left["dim"].iloc[0])
        found = Tree(left, dim).search(right["id"].to_numpy(), _matrix(right["v"], dim), np.full(len(right), -np.inf), k)
        return pd.DataFrame({"q": right["q"], "query_id": right["id"], "v": right["v"], **{c: right[c] for c in TREE}, "ids": [i for i, _ in found], "scores": [s for _, s in found]})

    by_tree = lambda df: df.repartition(spread, *TREE).groupBy(*TREE)
    # Rows equal in identifier and vector ask once; `q` numbers the queries, as one identifier may have several vectors.
    asks = dealt.where("asks").select("id", "v", *TREE).distinct()
    asks = stored(asks.withColumn("q", F.monotonically_increasing_id()), "mtree-asks")
    seeded = by_tree(nodes).cogroup(by_tree(asks)).applyInPandas(own, "q long, query_id long, v binary, dim int, cell int, part int, ids array<long>, scores array<long>")
    seeded = stored(seeded, "mtree-seeded")
    asked = seeded.count()
    blocks = max(1, -(-asked // QUERY_ROWS))
    cut = F.when(F.size("ids") >= k, F.element_at("scores", -1).cast("double")).otherwise(F.lit(float("-inf")))
    queries_left = seeded.select("q", "query_id", "v", "dim", F.col("cell").alias("own_cell"), F.col("part").alias("own_part"), cut.alias("cut"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"))
    roots = nodes.where("parent < 0").select(*TREE, "pivot", "radius")
    routed = stored(_routed(queries_left, roots, trees), "mtree-routed")
    needed = stored(routed.select(*TREE, "block").distinct(), "mtree-needed")
    groups = needed.count()
    wide = min(MOST_PARTITIONS, max(4 * groups, 8))
    keys = [*TREE, "block"]

    def others(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            found = Tree(left, dim).search(right["query_id"].to_numpy(), _matrix(right["v"], dim), right["cut"].to_numpy(), k)
            for q, query_id, (ids, scores) in zip(right["q"], right["query_id"], found, strict=True):
                out["q"].append(np.full(len(ids), q))
                out["query_id"].append(np.full(len(ids), query_id))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        return pd.DataFrame({name: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for name, x in out.items()})

    held = nodes.join(needed, TREE).repartition(wide, *keys)
    found = held.groupBy(*keys).cogroup(routed.repartition(wide, *keys).groupBy(*keys)).applyInPandas(others, "q long, query_id long, vec_id long, score long")
    first = seeded.select("q", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("q", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _routed(queries: DataFrame, roots: DataFrame, trees: int) -> DataFrame:
    """q, query_id, v, cut, block, dim, cell, part: each query with the trees, but its own, whose root's bound reaches its cut."""
    if trees > ROUTED:
        pairs = queries.join(roots.select(*TREE), "dim").where("cell != own_cell or part != own_part")
        return pairs.select("q", "query_id", "v", "cut", "block", *TREE)
    known: dict[int, tuple] = {}
    for r in roots.collect():  # at most ROUTED roots
        known.setdefault(r["dim"], ([], [], [], []))
        for into, x in zip(known[r["dim"]], (r["cell"], r["part"], np.frombuffer(r["pivot"], np.int64), r["radius"]), strict=True):
            into.append(x)
    known = {d: (np.array(c), np.array(p), np.stack(v).astype(np.float64), np.array(r)) for d, (c, p, v, r) in known.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f.iloc[i : i + 256] for f in frames for i in range(0, len(f), 256)):  # 256 * ROUTED bounds at once, at most
            for dim, group in frame.groupby("dim"):
                cells, parts, centres, radii = known[int(dim)]
                q = _matrix(group["v"], int(dim)).astype(np.float64)
                norms = np.sqrt((q**2).sum(axis=1))[:, None]
                bound = q @ centres.T + norms * radii
                bound += LOOSE * (norms * (np.sqrt((centres**2).sum(axis=1)) + radii) + 1)
                own = (cells == group["own_cell"].to_numpy()[:, None]) & (parts == group["own_part"].to_numpy()[:, None])
                fits = (bound >= group["cut"].to_numpy()[:, None]) & ~own
                i, to = np.nonzero(fits)
                yield group[["q", "query_id", "v", "cut", "block", "dim"]].iloc[i].assign(cell=cells[to], part=parts[to])

    return queries.mapInPandas(run, "q long, query_id long, v binary, cut double, block int, dim int, cell int, part int")


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 20 = 0)),
s AS (SELECT q.q, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM a q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
