"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors fall into shards of about ``SHARD_ROWS`` by a hash of their id. In each, points enter a directed graph in
batches of growing size: a greedy beam search from the medoid proposes the nodes it expanded as neighbours, and robust
pruning keeps a candidate only if no kept one is closer to it, by the factor ``ALPHA``, than the point itself. Reverse
edges are added and pruned alike, to ``DEGREE`` edges. Every vector is a query and searches every shard with a beam of
``BEAM``; the shards' nearest are merged to ``k``. All searches of a block of queries advance in step, as array
operations; what they hold follows the beam, not the shard. A shard's size is fixed, as recall falls with it: for one
recall, a larger shard takes as much wider a beam.

Distance is Euclidean; ties go to the smaller id. Equal vectors of a shard share a node and all take part in results.
Null vectors, vectors with a null or non-finite element, and those not of the commonest length (ties: the longer) take no
part, nor do null ids; ``left_out`` counts them. Rows with one id are one vector, the first in order. Nothing is its own neighbour; with few
vectors there are fewer than ``k`` neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltscan.llm._common import cut, small

K, DEGREE, BUILD_BEAM, BEAM, ALPHA, SHARD_ROWS, BLOCK_ROWS = 10, 32, 64, 128, 1.2, 20_000, 2_000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row a[i] from the vectors b[i]."""
    gap = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


class Graph:
    """Distinct vectors with at most ``degree`` edges each; -1 fills a row."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, start: int):
        self.vectors, self.edges, self.start = vectors, edges, start

    def search(self, queries: np.ndarray, beam: int, history: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and squared distances of the ``beam`` nearest found, in order; with ``history`` of all expanded."""
        q = len(queries)
        ids, dist = np.full((q, beam), -1, dtype=np.int32), np.full((q, beam), np.inf, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        ids[:, 0], done[:, 0] = self.start, False
        dist[:, 0] = _distances(queries, np.broadcast_to(self.vectors[self.start], (q, 1, queries.shape[1])))[:, 0]
        tried, tried_dist = [], []
        rows = np.arange(q)
        while True:
            open_ = ~done[rows]
            rows = rows[open_.any(axis=1)]
            if not len(rows):
                break
            at = (~done[rows]).argmax(axis=1)
            node = ids[rows, at]
            done[rows, at] = True
            if history:
                column, gap = np.full(q, -1, dtype=np.int32), np.full(q, np.inf, dtype=np.float32)
                column[rows], gap[rows] = node, dist[rows, at]
                tried.append(column)
                tried_dist.append(gap)
            near = self.edges[node]
            d = _distances(queries[rows], self.vectors[near])
            # What a full beam has dropped is no nearer than its last and never comes back, so no list of seen nodes is
            # needed, whose size would follow the shard's: a neighbour is new if it is nearer than the last and not in the beam.
            new = (near >= 0) & (d < dist[rows, -1:])
            r, c = np.nonzero(new)
            held = (ids[rows[r]] == near[r, c][:, None]).any(axis=1)
            new[r[held], c[held]] = False
            some = new.any(axis=1)
            into, new, near, d = rows[some], new[some], near[some], d[some]
            every = np.concatenate([dist[into], np.where(new, d, np.inf)], axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :beam]
            dist[into] = np.take_along_axis(every, order, axis=1)
            ids[into] = np.take_along_axis(np.concatenate([ids[into], np.where(new, near, -1)], axis=1), order, axis=1)
            done[into] = np.take_along_axis(np.concatenate([done[into], ~new], axis=1), order, axis=1)
        if history:
            return np.stack(tried, axis=1), np.stack(tried_dist, axis=1)
        return ids, dist


def prune(points: np.ndarray, cand: np.ndarray, dist: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each point's candidates (-1: none, no node twice) to ``degree`` diverse ones."""
    order = np.argsort(np.where(cand < 0, np.inf, dist), axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    used = int((cand >= 0).sum(axis=1).max(initial=0))
    cand, dist = cand[:, :used], dist[:, :used]
    out = np.full((len(points), degree), -1, dtype=np.int32)
    if not used:
        return out
    c = vectors[cand]
    norm = np.einsum("ijk,ijk->ij", c, c)
    apart = norm[:, :, None] + norm[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
    alive = (cand >= 0) & (cand != points[:, None])
    rows = np.arange(len(points))
    for k in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, k] = cand[some, pick[some]]
        alive &= ~(some[:, None] & (alpha * alpha * apart[rows, pick] <= dist))
        alive[rows[some], pick[some]] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> Graph:
    """The graph of distinct ``vectors``."""
    n = len(vectors)
    middle = vectors.mean(axis=0, dtype=np.float64).astype(np.float32)
    start = int(((vectors - middle) ** 2).sum(axis=1).argmin())
    graph = Graph(vectors, np.full((n, degree), -1, dtype=np.int32), start)
    order = np.random.default_rng(17).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        points = order[at : at + size]
        at, size = at + size, min(2 * size, BLOCK_ROWS, max(1, n // 10))
        cand, dist = graph.search(vectors[points], beam, history=True)
        graph.edges[points] = prune(points, cand, dist, vectors, degree, alpha)
        _reverse(graph, points, degree, alpha)
    return graph


def _reverse(graph: Graph, points: np.ndarray, degree: int, alpha: float) -> None:
    """Give each new edge's target an edge back; targets with too many are pruned."""
    to = graph.edges[points]
    source, target = np.repeat(points, to.shape[1]), to.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for i in range(0, len(nodes), 512):
        own, c = nodes[i : i + 512], count[i : i + 512]
        wide = np.full((len(own), degree + int(c.max())), -1, dtype=np.int32)
        wide[:, :degree] = graph.edges[own]
        row = np.repeat(np.arange(len(own)), c)
        a = first[i]
        column = degree + np.arange(len(row)) - np.repeat(first[i : i + 512] - a, c)
        wide[row, column] = source[a : a + len(row)]
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        full = (wide >= 0).sum(axis=1) > degree
        if full.any():
            # A hub that many points of one batch name is pruned on its own, so that wide rows are few.
            for part in np.array_split(np.flatnonzero(full), max(1, full.sum() * wide.shape[1] ** 2 // 20_000_000)):
                d = _distances(graph.vectors[own[part]], graph.vectors[wide[part]])
                graph.edges[own[part]] = prune(own[part], wide[part], d, graph.vectors, degree, alpha)
        rest = ~full
        packed = -np.sort(-wide[rest], axis=1)[:, :degree]
        graph.edges[own[rest]] = packed


def _finite(v: Column) -> Column:
    # Compiled functions, as a lambda is interpreted element by element. The first is null if an element is.
    inf = F.lit(float("inf")).cast("float")
    return F.coalesce(~F.array_contains(v, F.lit(float("nan")).cast("float")) & (F.array_max(v) < inf) & (F.array_min(v) > -inf), F.lit(False))


def left_out(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(reason, n): how many rows take no part, and why."""
    one = usable(table, id_col, vector_col).select(F.size("vector")).first()
    v = F.col(vector_col).cast("array<float>")
    other = F.size(v) != F.lit(one[0] if one else 0)
    reason = F.when(F.col(id_col).isNull(), "no id").when(~_finite(v), "no finite vector").when(other, "other length")
    return table.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & _finite(F.col("vector")))
    # Only ids are shuffled, and the vectors of ids that are there more than once.
    twice = small(rows.groupBy("id").count().where("count > 1").select("id"))
    if not twice.isEmpty():
        again = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector"))
        rows = cut(rows.join(twice, "id", "left_anti").unionByName(again))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (common["n"] if common else 0))


def _floats(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def neighbours(table: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``neighbor_id``, ``rank`` and ``distance`` of each vector's ``k`` nearest others, as far as the beams find them.

    A shard's graph and a block of queries are one row each; their product is one task per pair, so what a task holds
    is bounded, and only each pair's nearest are shuffled by query to be merged.
    """
    vectors = usable(table, id_col, vector_col)
    kind = vectors.schema["id"].dataType.simpleString()
    n = vectors.count()
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (4 * BLOCK_ROWS)))
    hashed = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint")

    def whole(part: pa.Table) -> pa.RecordBatch:
        x, ids = _floats(part.column("vector").combine_chunks()), part.column("id").combine_chunks()
        order = np.asarray(pa.compute.sort_indices(ids))
        ids, x = ids.take(pa.array(order)), x[order]
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        graph = build(distinct)
        blob = [distinct.tobytes(), graph.edges.tobytes(), np.int64(graph.start).tobytes(), node.ravel().astype(np.int64).tobytes()]
        return pa.table([pa.array([ids.to_pylist()], pa.list_(ids.type)), *(pa.array([b], pa.large_binary()).cast(pa.binary()) for b in blob)], names=["ids", "x", "edges", "start", "node"])

    def block(part: pa.Table) -> pa.Table:
        x, ids = _floats(part.column("vector").combine_chunks()), part.column("id").combine_chunks()
        return pa.table([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([x.tobytes()], pa.binary())], names=["queries", "q"])

    graphs = vectors.withColumn("s", hashed % n_shards).groupBy("s").applyInArrow(whole, f"ids array<{kind}>, x binary, edges binary, start binary, node binary")
    graphs = cut(graphs).repartition(n_shards)
    blocks = cut(vectors.withColumn("s", (hashed / n_shards).cast("bigint") % n_blocks).groupBy("s").applyInArrow(block, f"queries array<{kind}>, q binary")).repartition(n_blocks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids, queries = row["ids"].values, row["queries"].values
                node = np.frombuffer(row["node"].as_py(), dtype=np.int64)
                start = int(np.frombuffer(row["start"].as_py(), dtype=np.int64)[0])
                q = np.frombuffer(row["q"].as_py(), dtype=np.float32).reshape(len(queries), -1)
                x = np.frombuffer(row["x"].as_py(), dtype=np.float32).reshape(-1, q.shape[1])
                graph = Graph(x, np.frombuffer(row["edges"].as_py(), dtype=np.int32).reshape(len(x), -1), start)
                order = np.argsort(node, kind="stable")  # members of each node, in order of id
                first, count = np.searchsorted(node[order], np.arange(len(x))), np.bincount(node, minlength=len(x))
                for a in range(0, len(q), BLOCK_ROWS):
                    found, dist = graph.search(q[a : a + BLOCK_ROWS], max(beam, k + 1))
                    found, dist = found[:, : k + 1], dist[:, : k + 1]
                    r, c = np.nonzero(found >= 0)
                    hit = found[r, c]
                    # At most k + 1 members of a node are needed: the smallest ids, since they tie.
                    take = np.minimum(count[hit], k + 1)
                    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(first[hit], take)
                    who, other = queries.take(pa.array(np.repeat(r, take) + a)), ids.take(pa.array(order[at]))
                    d = pa.array(np.sqrt(np.repeat(dist[r, c], take).astype(np.float64)))
                    out = pa.RecordBatch.from_arrays([who, other, d], ["vec_id", "neighbor_id", "distance"])
                    yield out.filter(pa.compute.not_equal(who, other))

    found = blocks.crossJoin(graphs).mapInArrow(find, f"vec_id {kind}, neighbor_id {kind}, distance double")
    nearest = Window.partitionBy("vec_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "distance")
