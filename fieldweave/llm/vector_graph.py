"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Nearness is the largest inner product. Vectors are lifted to one common norm, so that distance and inner product agree. Points
enter in batches: a greedy search from the entry point proposes neighbours, relaxed distance pruning keeps diverse ones, and
edges back are pruned in the same way. A query runs a beam search in every shard. All steps work on many points at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Edges of a point after pruning, and room for edges back before it is pruned again.
DEGREE, ROOM = 32, 44
#: Beam of the searches that build the graph, and of queries.
BUILD_BEAM, QUERY_BEAM = 64, 112
#: How much longer than an edge's own length a detour may be.
ALPHA = 1.2
#: Shards at least, and vectors of a shard at most (about 100 MB with its edges).
SHARDS, SHARD_ROWS = 8, 200_000
#: Queries that meet one shard in one group, and that search it at once.
QUERY_BLOCK, AT_ONCE = 20_000, 256


class Graph:
    """Edges (-1: none), lifted vectors, entry point."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entry: int):
        self.points, self.edges, self.entry = points, edges, entry

    def search(self, queries: np.ndarray, beam: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best ``beam`` points met, best first; -1 where there are fewer. All queries step together."""
        n, q = len(self.points), len(queries)
        rows = np.arange(q)
        ids = np.full((q, beam), -1, np.int32)
        near = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        seen = np.zeros((q, n), bool)
        ids[:, 0], near[:, 0], open_[:, 0] = self.entry, queries @ self.points[self.entry], True
        seen[:, self.entry] = True
        active = rows
        while len(active):
            at = np.argmax(open_[active], axis=1)
            node = ids[active, at]
            open_[active, at] = False
            next_ids = self.edges[node]
            new = (next_ids >= 0) & ~seen[active[:, None], next_ids]
            seen[active[:, None], np.where(new, next_ids, self.entry)] = True
            found = np.where(new, np.einsum("qd,qed->qe", queries[active], self.points[next_ids]), -np.inf)
            all_near = np.concatenate([near[active], found], axis=1)
            all_ids = np.concatenate([ids[active], np.where(new, next_ids, -1)], axis=1)
            all_open = np.concatenate([open_[active], new], axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            side = np.arange(len(active))[:, None]
            near[active], ids[active], open_[active] = all_near[side, best], all_ids[side, best], all_open[side, best]
            active = active[open_[active].any(axis=1)]
        return ids, near


def robust_prune(points: np.ndarray, norm2: float, own: np.ndarray, ids: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point of ``own``, at most ``degree`` of its candidates ``ids`` (-1: none), nearest first, each one dropped
    if a kept one is nearer to it than the point is, by the factor ``alpha``. Lists that fit are kept whole."""
    ids = np.where(ids == own[:, None], -1, ids)
    candidates = points[ids]
    far = np.where(ids >= 0, 2 * (norm2 - np.einsum("bd,bcd->bc", points[own], candidates)), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    rows = np.arange(len(own))[:, None]
    ids, far, candidates = ids[rows, order], far[rows, order], candidates[rows, order]
    alive = ids >= 0
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    fits = alive.sum(axis=1) <= degree
    out = np.full((len(own), degree), -1, np.int32)
    flat = np.arange(len(own))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = np.argmax(alive, axis=1)
        out[some, k] = ids[flat, at][some]
        alive[flat, at] = False
        detour = 2 * (norm2 - np.einsum("bd,bcd->bc", candidates[flat, at], candidates))
        alive &= fits[:, None] | (alpha * alpha * detour > far)
    return out


def build_graph(points: np.ndarray, norm2: float, degree: int = DEGREE, room: int = ROOM, beam: int = BUILD_BEAM, batch: int = AT_ONCE) -> Graph:
    """The graph of some distinct lifted vectors. Batches double from one point on, so early points meet a graph, not each other's absence."""
    n = len(points)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    order = np.r_[entry, np.delete(np.random.default_rng(7).permutation(n), np.flatnonzero(np.random.default_rng(7).permutation(n) == entry))]
    graph = Graph(points, np.full((n, room), -1, np.int32), entry)
    edges = graph.edges
    degrees = np.zeros(n, np.int64)
    done = 1
    while done < n:
        own = order[done:done + min(batch, done)]
        ids, _ = graph.search(points[own], beam)
        kept = robust_prune(points, norm2, own, ids, degree)
        edges[own, :degree] = kept
        degrees[own] = (kept >= 0).sum(axis=1)
        back, source = kept.ravel(), np.repeat(own, degree)
        add_edges(graph, degrees, back[back >= 0], source[back >= 0], norm2, degree)
        done += len(own)
    connect(graph, degrees, norm2, degree)
    return graph


def add_edges(graph: Graph, degrees: np.ndarray, targets: np.ndarray, sources: np.ndarray, norm2: float, degree: int) -> None:
    """An edge from each target to its source; targets without room are pruned."""
    order = np.argsort(targets, kind="stable")
    targets, sources = targets[order], sources[order]
    first = np.r_[True, targets[1:] != targets[:-1]]
    starts = np.flatnonzero(first)
    place = np.arange(len(targets)) - np.repeat(starts, np.diff(np.r_[starts, len(targets)]))
    room = graph.edges.shape[1]
    slot = degrees[targets] + place
    fits = slot < room
    graph.edges[targets[fits], slot[fits]] = sources[fits]
    over = np.unique(targets[~fits])
    counts = np.bincount(targets, minlength=len(degrees))
    if len(over):
        late = np.full((len(over), int(counts[over].max())), -1, np.int32)
        row = np.searchsorted(over, targets[~fits])
        late[row, place[~fits]] = sources[~fits]
        kept = robust_prune(graph.points, norm2, over, np.concatenate([graph.edges[over], late], axis=1), degree)
        graph.edges[over] = -1
        graph.edges[over, :degree] = kept
    degrees += counts
    degrees[over] = (graph.edges[over] >= 0).sum(axis=1)


def connect(graph: Graph, degrees: np.ndarray, norm2: float, degree: int) -> None:
    """Edges to points that no path from the entry reaches, from the nearest point that one reaches and that has room."""
    n = len(graph.points)
    for _ in range(8):
        reached = np.zeros(n, bool)
        front = np.array([graph.entry])
        reached[front] = True
        while len(front):
            after = graph.edges[front].ravel()
            after = np.unique(after[after >= 0])
            front = after[~reached[after]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        for low in range(0, len(lost), AT_ONCE):
            some = lost[low:low + AT_ONCE]
            ids, _ = graph.search(graph.points[some], BUILD_BEAM)
            for point, near in zip(some.tolist(), ids, strict=True):
                near = near[(near >= 0)]
                with_room = near[degrees[near] < graph.edges.shape[1]]
                if len(with_room):
                    target = with_room[0]
                    graph.edges[target, degrees[target]] = point
                    degrees[target] += 1
                else:  # widen: give up the longest edge of the nearest point, which stays reachable by others in the next round
                    graph.edges[near[0], -1] = point


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors that are neither null nor zero and hold no null or non-finite component, of the largest length that occurs."""
    plain = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = plain.where(finite & F.exists("v", lambda x: x != 0))
    width = good.agg(F.max(F.size("v"))).first()[0] or 0
    return good.where(F.size("v") == width)


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20) -> DataFrame:
    """(shard, node, ids, v, edges): the graphs over the distinct vectors, written to the shared folder.

    Equal vectors are one node with their ``top`` + 1 smallest ids, which is all that the first ``top`` answers can need. Left
    out: rows with a null id, see ``usable``. Repeated rows count once. Shards are dealt by a hash of the vector.
    """
    rows = usable(vectors, key, vector).distinct()
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("rank", rank).where(F.col("rank") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes, "nodes")
    n, largest = nodes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    norm2 = float(largest or 1.0)

    def build(part: pa.Table) -> pa.Table:
        order = np.argsort(np.array([ids[0].as_py() for ids in part.column("ids")]))
        part = part.take(pa.array(order))
        x = matrix(part.column("v"))
        lifted = np.c_[x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))].astype(np.float32)
        graph = build_graph(lifted, norm2)
        edges = [row[row >= 0] for row in graph.edges]
        at = np.arange(len(x), dtype=np.int32)
        return pa.table({
            "shard": part.column("shard"), "node": at, "entry": pa.array(at == graph.entry), "ids": part.column("ids"), "v": part.column("v"),
            "edges": pa.array(edges, pa.list_(pa.int32()))})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard").applyInArrow(build, "shard int, node int, entry boolean, ids array<long>, v array<double>, edges array<int>")
    return stored(built, "vector-graph")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found for each query but its own id, ties to the smaller id.

    Every query meets every shard, in blocks of QUERY_BLOCK queries; scores are inner products of the original vectors in double
    precision. Queries whose vector takes no part have no rows; repeated query rows count once.
    """
    asked = usable(queries, key, vector).distinct()
    n, shards = asked.count(), index.agg(F.max("shard")).first()[0]
    if shards is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, -(-n // QUERY_BLOCK))
    graph = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    met = graph.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(searcher(top, beam), "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def searcher(top: int, beam: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def find(part: pa.Table, asked: pa.Table) -> pa.Table:
        if not part.num_rows or not asked.num_rows:
            return empty
        part = part.take(pa.array(np.argsort(part.column("node").to_numpy())))
        v, q = matrix(part.column("v")), matrix(asked.column("v"))
        if v.shape[1] != q.shape[1]:
            return empty
        ids = part.column("ids").to_pylist()
        listed = part.column("edges").to_pylist()
        edges = np.full((len(v), max(1, max(map(len, listed)))), -1, np.int32)
        for node, row in enumerate(listed):
            edges[node, :len(row)] = row
        graph = Graph(v.astype(np.float32), edges, int(np.argmax(part.column("entry").to_numpy(zero_copy_only=False))))
        query_ids = asked.column("id").to_numpy()
        out: list[tuple[int, int, float]] = []
        for low in range(0, len(q), AT_ONCE):
            some = q[low:low + AT_ONCE]
            near, _ = graph.search(some.astype(np.float32), min(beam, len(v)))
            near = near[:, :4 * top + 4]
            exact = np.where(near >= 0, np.einsum("qd,qcd->qc", some, v[near]), -np.inf)
            order = np.argsort(-exact, axis=1, kind="stable")
            for k, own in enumerate(query_ids[low:low + AT_ONCE].tolist()):
                found: list[tuple[float, int]] = []
                for at in order[k].tolist():
                    node, score = int(near[k, at]), float(exact[k, at])
                    if node < 0 or (len(found) >= top and -score > found[top - 1][0]):
                        break
                    found += [(-score, i) for i in ids[node] if i != own]
                    found.sort()
                out += [(own, i, -score) for score, i in found[:top]]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return find
