"""Exact top-k search by inner product with a paged M-tree.

Integer vectors are lifted by one coordinate, sqrt(M - |x|^2) with M the largest
squared length, and queries by 0. In the lifted space the Euclidean distance
falls as the inner product rises, so the nearest k are the k of highest score.

Vectors are dealt to shards around routing objects (a bounded, deterministic
sample, which only shapes the tree), and shards of one routing object by a hash,
so that many equal vectors spread. Each shard becomes an M-tree: nodes with a
routing object, a covering radius and the distance to the parent's object;
leaves are pages whose entries are sorted by their distance to it. The tree is
a table, one row per node, and shards are built and searched where they lie.

A cell is one shard and one block of queries. Nodes whose bound by the stored
parent distance is already beyond a query's k-th best are skipped without a
distance; the others' pages are visited best bound first, in step for all queries
of the block. The k-th best starts from the sample, whose vectors are rows of the
table. Every cell returns at most k rows a query, and a window picks the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculo.llm.common import column, int64s, map_batches, materialize


@dataclass(frozen=True)
class TreeRules:
    #: Most entries of a leaf page, of a shard, and most queries of a block.
    page: int = 256
    shard: int = 4096
    block: int = 4096
    #: Most vectors of the sample that gives routing objects and first bounds.
    sample: int = 2048
    #: Rows behind one routing object.
    per_route: int = 2048


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, x, norm) with x = floor(scale * component), one row per id.

    Null ids and vectors, empty vectors, and those with null or non-finite
    components are left out. Of rows with one id the smallest vector stays.
    """
    wide = F.transform(F.col(embedding), lambda v: v.cast("double"))
    sound = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), wide.alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).filter(F.coalesce(sound, F.lit(False)))
    x = F.transform("e", lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))
    one = rows.select("vec_id", x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
    return one.withColumn("norm", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v))


def _matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _lift(x: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - norm, 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


# --- building --------------------------------------------------------------------------------------------------------


def build_tree(lifted: np.ndarray, page: int) -> list[dict]:
    """Nodes of the M-tree over rows of ``lifted``, parents first; leaves have ``rows`` sorted by ``away``.

    A node with more rows than a page promotes two far objects, and its rows go
    to the nearer one; rows that no object parts (copies) are halved.
    """
    nodes: list[dict] = []
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(lifted)), -1, 0)] if len(lifted) else []
    while todo:
        rows, parent, route = todo.pop(0)
        away = _distances(lifted[route : route + 1], lifted[rows])[0]
        above = 0.0 if parent < 0 else float(_distances(lifted[nodes[parent]["route"]][None], lifted[route][None])[0, 0])
        node = {"node": len(nodes), "parent": parent, "route": route, "radius": float(away.max()), "above": above, "rows": None, "away": None}
        nodes.append(node)
        if len(rows) <= page:
            order = np.argsort(away, kind="stable")
            node["rows"], node["away"] = rows[order], away[order]
            continue
        first = rows[int(away.argmax())]
        from_first = _distances(lifted[first : first + 1], lifted[rows])[0]
        second = rows[int(from_first.argmax())]
        near = from_first <= _distances(lifted[second : second + 1], lifted[rows])[0]
        if near.all() or not near.any():
            near = np.arange(len(rows)) < len(rows) // 2
            first, second = rows[0], rows[-1]
        todo += [(rows[near], node["node"], int(first)), (rows[~near], node["node"], int(second))]
    return nodes


_NODES = "shard int, node int, parent int, route binary, radius double, above double, ids binary, away binary, vectors binary"


def _shard_nodes(part: pa.Table, most: float, page: int) -> pa.Table:
    ids = int64s(part.column("vec_id").combine_chunks())
    order = np.argsort(ids)
    x = _matrix(part.column("x").combine_chunks())[order]
    norm = part.column("norm").to_numpy().astype(float)[order]
    ids, lifted = ids[order], _lift(x, norm, most)
    shard, out = part.column("shard")[0].as_py(), []
    for node in build_tree(lifted, page):
        rows = node["rows"]
        leaf = {"ids": None, "away": None, "vectors": None} if rows is None else {"ids": ids[rows].tobytes(), "away": node["away"].tobytes(), "vectors": x[rows].astype(np.int64).tobytes()}
        out.append({"shard": shard, "node": node["node"], "parent": node["parent"], "route": lifted[node["route"]].tobytes(), "radius": node["radius"], "above": node["above"], **leaf})
    kinds = [pa.int32()] * 3 + [pa.binary(), pa.float64(), pa.float64()] + [pa.binary()] * 3
    return pa.Table.from_pylist(out, schema=pa.schema(list(zip([c.split()[0] for c in _NODES.split(", ")], kinds, strict=True))))


@dataclass
class MTree:
    nodes: DataFrame
    shards: int
    most: float
    dim: int
    #: Ids and vectors of the sample.
    sample_ids: np.ndarray
    sample: np.ndarray


def build_index(rows: DataFrame, dim: int, rules: TreeRules = TreeRules()) -> MTree:
    """The tree over stored rows (vec_id, x, norm), all of dimension ``dim``."""
    n, most = rows.agg(F.count(F.lit(1)), F.max("norm").cast("double")).first()
    some = rows.select("vec_id", "x", "norm").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rules.sample).toArrow().combine_chunks()
    ids, x = int64s(some.column("vec_id").combine_chunks()), _matrix(some.column("x").combine_chunks())
    routes = _lift(x, some.column("norm").to_numpy().astype(float), most)[: max(1, min(len(ids), math.ceil(n / rules.per_route)))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lifted = _lift(_matrix(column(batch, "x")), int64s(column(batch, "norm")).astype(float), most)
                nearest = _distances(lifted, routes).argmin(axis=1).astype(np.int32)
                yield batch.append_column("route", pa.array(nearest))

    routed = materialize(map_batches(rows.select("vec_id", "x", "norm"), assign, "vec_id long, x array<long>, norm long, route int"), "vectors")
    # At most as many counts as there are routing objects.
    counts = sorted((r["route"], math.ceil(r["count"] / rules.shard)) for r in routed.groupBy("route").count().collect())
    first = np.concatenate([[0], np.cumsum([c for _, c in counts])]).tolist()
    start, parts = {r: b for (r, _), b in zip(counts, first, strict=False)}, dict(counts)
    as_map = lambda d: F.create_map(*[F.lit(v).cast("int") for kv in d.items() for v in kv])
    shard: Column = as_map(start)[F.col("route")] + F.pmod(F.xxhash64("vec_id"), as_map(parts)[F.col("route")]).cast("int")
    page = rules.page
    nodes = routed.select("vec_id", "x", "norm", shard.alias("shard")).groupBy("shard").applyInArrow(lambda t: _shard_nodes(t, most, page), _NODES)
    return MTree(materialize(nodes, "tree-nodes"), first[-1], most, dim, ids, x)


# --- searching -------------------------------------------------------------------------------------------------------


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each owner: highest score, then smallest id."""
    order = np.lexsort((ids, -score, owner))
    owner, score, ids = owner[order], score[order], ids[order]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    place = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(owner) else np.zeros(0, int)
    keep = place < k
    return owner[keep], score[keep], ids[keep]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles hold them while components stay below 2^20."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1 << 20:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def search_tree(nodes: list[dict], queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, most: float, k: int, visits: list[int] | None = None):
    """(query row, score, id) of each query's k best entries with a score of at least ``least``.

    ``visits``, if given, receives how many query-entry scores were computed.
    """
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    norm = (queries * queries).sum(1)
    slack = 1e-5 * math.sqrt(most + float(norm.max(initial=0)) + 1)
    # With no bound yet, everything is near enough.
    reach = lambda kth: np.sqrt(np.maximum(norm + most - 2 * np.where(np.isfinite(kth), kth, -1e300), 0)) + slack
    kth = least.astype(float)
    limit = reach(kth)
    routes = np.stack([np.frombuffer(x["route"]) for x in nodes])
    distance = np.full((len(nodes), len(queries)), np.inf)
    bound = np.full((len(nodes), len(queries)), np.inf)
    for x in nodes:
        n, p = x["node"], x["parent"]
        if p < 0:
            ask = np.ones(len(queries), bool)
        else:
            ask = (bound[p] <= limit) & (np.abs(distance[p] - x["above"]) - x["radius"] <= limit)
        if ask.any():
            distance[n, ask] = _distances(lifted[ask], routes[n : n + 1])[:, 0]
            bound[n, ask] = np.maximum(distance[n, ask] - x["radius"], 0)
            if p >= 0:
                bound[n, ask] = np.maximum(bound[n, ask], bound[p, ask])
    leaves = [x for x in nodes if x["ids"] is not None]
    at = np.array([x["node"] for x in leaves])
    order = np.argsort(bound[at], axis=0, kind="stable")
    held = (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))
    for turn in range(len(leaves)):
        chosen = order[turn]
        active = bound[at[chosen], np.arange(len(queries))] <= limit
        if not active.any():
            break
        found = [held]
        for leaf in np.unique(chosen[active]):
            x = leaves[leaf]
            rows = np.flatnonzero(active & (chosen == leaf))
            near = distance[x["node"], rows]
            # Entries whose distance to the routing object rules them out for all these queries.
            low, high = np.searchsorted(x["away"], [(near - limit[rows]).min(), (near + limit[rows]).max()])
            high = min(len(x["away"]), int(np.searchsorted(x["away"], (near + limit[rows]).max(), "right")))
            ids = x["ids"][low:high]
            score = _scores(queries[rows], x["vectors"][low:high])
            if visits is not None:
                visits.append(score.size)
            q, e = np.nonzero((score >= kth[rows][:, None]) & (ids[None, :] != query_ids[rows][:, None]))
            found.append((rows[q], score[q, e].astype(float), ids[e]))
        held = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
        full = np.bincount(held[0], minlength=len(queries)) >= k
        last = np.append(np.flatnonzero(np.diff(held[0])), len(held[0]) - 1) if len(held[0]) else np.zeros(0, int)
        worst = np.full(len(queries), -np.inf)
        worst[held[0][last]] = held[1][last]
        kth = np.maximum(kth, np.where(full, worst, -np.inf))
        limit = reach(kth)
    return held


def _search_cell(queries: pa.Table, nodes: pa.Table, dim: int, most: float, k: int) -> pa.Table:
    x = _matrix(queries.column("x").combine_chunks())
    tree = sorted(nodes.to_pylist(), key=lambda r: r["node"])
    for node in tree:
        if node["ids"] is not None:
            node["ids"], node["away"] = np.frombuffer(node["ids"], np.int64), np.frombuffer(node["away"])
            node["vectors"] = np.frombuffer(node["vectors"], np.int64).reshape(-1, dim).astype(float)
    ids = int64s(queries.column("query_id").combine_chunks())
    if len(ids) and tree:
        q, score, found = search_tree(tree, x, ids, queries.column("least").to_numpy(), most, k)
    else:
        q, score, found = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)
    return pa.table({"query_id": pa.array(ids[q] if len(ids) else np.zeros(0, np.int64)), "vec_id": pa.array(found), "score": pa.array(score.astype(np.int64))})


def search_index(tree: MTree, queries: DataFrame, k: int, rules: TreeRules = TreeRules()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query (query_id, x), without the row of its own id."""
    sample_ids, sample, most, dim = tree.sample_ids, tree.sample, tree.most, tree.dim

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = int64s(column(batch, "query_id")), _matrix(column(batch, "x"))
            score = np.where(sample_ids[None, :] == ids[:, None], -np.inf, _scores(x, sample))
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(ids), -np.inf)
            yield batch.append_column("least", pa.array(least.astype(float)))

    bounded = materialize(map_batches(queries.select("query_id", "x"), bound, "query_id long, x array<long>, least double"), "tree-queries")
    blocks = max(1, math.ceil(bounded.count() / rules.block))
    # Each block of queries meets each shard: the stated queries against all rows, in cells of bounded size.
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = bounded.withColumns({"block": block, "shard": F.explode(F.sequence(F.lit(0), F.lit(tree.shards - 1)))})
    right = tree.nodes.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumnRenamed("shard", "shard_")
    cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard_", "block_"))
    found = cells.applyInArrow(lambda a, b: _search_cell(a, b, dim, most, k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, rules: TreeRules = TreeRules()) -> DataFrame:
    """The k rows of highest inner product for each row whose id is divisible by ``every``.

    Ties go to the smaller id; with fewer than k other rows all are returned. What
    takes no part is said at ``quantised``. Vectors meet those of their own
    dimension only: each dimension has its own tree. An empty table gives no rows.
    """
    rows = materialize(quantised(vectors), "quantised")
    out = None
    # One tree per dimension, few in any table of embeddings.
    for (dim,) in sorted(rows.select(F.size("x")).distinct().collect()):
        own = rows.filter(F.size("x") == dim)
        queries = own.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x")
        found = search_index(build_index(own, dim, rules), queries, k, rules)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
