"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt by hash of their id into shards of about ``SHARD_ROWS`` rows, so a shard is bounded whatever the data.
A shard's graph is built in one task and stored as one row of flat arrays (ids, vectors, neighbour lists of all levels).
Searching reads that table once for each block of queries, one block after another: a block, bounded in bytes, is sent to
all tasks, each walks its shards' graphs and keeps the nearest of all of them; what the tasks found is written before the
next block is sent, and all of it is merged by query.  The index is dealt to tasks anew for each block, so it moves once a block.
A query walks every shard, since
neighbours of vectors without clusters lie in all of them (on such data routing by centroids needs half the shards for a
recall of 0.9); a walk grows with the logarithm of a shard, so shards are as large as a task can build.

Nearness is the cosine.  The walk uses single precision on scaled vectors; the nearest it meets are scored again in
double precision on the original ones.  Equal vectors are one node of a graph, with all their ids.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null
ids; an id that repeats counts once, with its least vector; vectors of different lengths aren't compared; ties go to
the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.words import mixed
from canopy.plans.materialize import parallelism, stage_table

SHARD_ROWS = 16384
LINKS, BREADTH_BUILD, BREADTH_SEARCH = 16, 80, 160
#: Most bytes of queries that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20


class Graph:
    """Flat arrays: ``base[node, :]`` and ``upper[upper_start[node] + level - 1, :]`` hold neighbours, -1 where none."""

    def __init__(self, vectors, ids, id_start, level, base, upper_start, upper, entry) -> None:
        self.vectors, self.ids, self.id_start, self.level = vectors, ids, id_start, level
        self.base, self.upper_start, self.upper, self.entry = base, upper_start, upper, entry
        self.unit = _unit(vectors)
        self._seen, self._tick = np.zeros(len(vectors), np.int32), 0

    def neighbours(self, node: int, level: int) -> np.ndarray:
        row = self.base[node] if level == 0 else self.upper[self.upper_start[node] + level - 1]
        return row[row >= 0]

    def walk(self, q: np.ndarray, starts: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest nodes that a best-first walk from ``starts`` meets: ``(similarity, node)``, nearest first."""
        self._tick += 1
        tick, seen, unit = self._tick, self._seen, self.unit
        for _, node in starts:
            seen[node] = tick
        ahead = [(-s, node) for s, node in starts]
        best = list(starts)
        heapq.heapify(ahead)
        heapq.heapify(best)
        while ahead:
            s, node = heapq.heappop(ahead)
            if len(best) >= breadth and -s < best[0][0]:
                break
            near = self.neighbours(node, level)
            near = near[seen[near] != tick]
            if not len(near):
                continue
            seen[near] = tick
            found = unit[near] @ q
            if len(best) >= breadth:
                better = found > best[0][0]
                near, found = near[better], found[better]
            for x, other in zip(found.tolist(), near.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (x, other))
                    heapq.heappush(ahead, (-x, other))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, other))
                    heapq.heappush(ahead, (-x, other))
        return sorted(best, reverse=True)

    def descend(self, q: np.ndarray, to_level: int) -> list[tuple[float, int]]:
        """Greedy walk from the entry down to just above ``to_level``."""
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(int(self.level[self.entry]), to_level, -1):
            at = self.walk(q, at, 1, level)
        return at

    def search(self, q: np.ndarray, k: int, breadth: int) -> list[tuple[float, int]]:
        """``(score, id)`` of at least the ``k`` nearest rows found, nearest first; ``q`` is an original vector."""
        scaled = _unit(q[None])[0]
        nodes = np.array([node for _, node in self.walk(scaled, self.descend(scaled, 0), max(breadth, k), 0)[: 4 * k]])
        exact = self.vectors[nodes].astype(np.float64)
        q = q.astype(np.float64)
        scores = exact @ q / (np.sqrt((exact * exact).sum(axis=1)) * np.sqrt(q @ q))
        out = [(-s, i) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for i in self.ids[self.id_start[node] : self.id_start[node + 1]][:k].tolist()]
        return [(-s, i) for s, i in sorted(out)[:k]]


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def _spread(unit: np.ndarray, nodes: np.ndarray, similar: np.ndarray, most: int) -> np.ndarray:
    """Neighbours in different directions: a node is taken if it is nearer than to any taken before; the rest fill up."""
    order = np.argsort(-similar, kind="stable")
    nodes, similar = nodes[order], similar[order]
    if len(nodes) <= most:
        return nodes
    between = unit[nodes] @ unit[nodes].T
    closest = np.full(len(nodes), -2.0, np.float32)
    taken, passed = [], []
    for i in range(len(nodes)):
        if similar[i] > closest[i]:
            taken.append(i)
            if len(taken) == most:
                break
            np.maximum(closest, between[i], out=closest)
        else:
            passed.append(i)
    return nodes[np.array((taken + passed)[:most])]


def build(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, breadth: int = BREADTH_BUILD) -> Graph:
    """A graph over rows sorted by id; equal vectors share a node."""
    keys = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1])))[:, 0]
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first, kind="stable"), kind="stable")  # nodes in the order of their smallest ids
    node_of = rank[back]
    order = np.argsort(node_of, kind="stable")
    n = len(first)
    id_start = np.r_[0, np.cumsum(np.bincount(node_of, minlength=n))]
    vectors = vectors[np.sort(first)]

    draw = (mixed(ids[order][id_start[:-1]].astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    level = np.minimum(-np.log(np.maximum(draw, 1e-12)) / np.log(links), 8).astype(np.int64)
    upper_start = np.r_[0, np.cumsum(level)]
    room = [2 * links + links // 2, links + links // 2]  # lists may grow by half before they are thinned out again
    base = np.full((n, room[0]), -1, np.int32)
    upper = np.full((int(upper_start[-1]), room[1]), -1, np.int32)
    graph = Graph(vectors, ids[order], id_start, level, base, upper_start[:-1], upper, 0)
    size_base, size_upper = np.zeros(n, np.int64), np.zeros(len(upper), np.int64)

    for node in range(1, n):
        q = graph.unit[node]
        top = int(level[graph.entry])
        at = graph.descend(q, min(top, int(level[node])))
        for lvl in range(min(top, int(level[node])), -1, -1):
            at = graph.walk(q, at, breadth, lvl)
            similar, near = np.array([s for s, _ in at], np.float32), np.array([x for _, x in at])
            chosen = _spread(graph.unit, near, similar, links)
            most = 2 * links if lvl == 0 else links
            lists, sizes = (base, size_base) if lvl == 0 else (upper, size_upper)
            rows = lambda x, lvl=lvl: x if lvl == 0 else int(upper_start[x]) + lvl - 1
            own = rows(node)
            lists[own, : len(chosen)] = chosen
            sizes[own] = len(chosen)
            for other in chosen.tolist():
                row = rows(other)
                lists[row, sizes[row]] = node
                sizes[row] += 1
                if sizes[row] == lists.shape[1]:
                    near_other = lists[row].copy()
                    kept = _spread(graph.unit, near_other, graph.unit[near_other] @ graph.unit[other], most)
                    lists[row] = -1
                    lists[row, : len(kept)] = kept
                    sizes[row] = len(kept)
        if level[node] > level[graph.entry]:
            graph.entry = node
    return graph


# --- the table of graphs ----------------------------------------------------------------------------------------------

_INDEX = pa.schema([("dim", pa.int32()), ("nodes", pa.int32()), ("entry", pa.int32()), *((c, pa.binary()) for c in ("vectors", "ids", "id_start", "level", "base", "upper_start", "upper"))])
_INDEX_DDL = "dim int, nodes int, entry int, vectors binary, ids binary, id_start binary, level binary, base binary, upper_start binary, upper binary"


def usable(embedding: str = "embedding", vec_id: str = "vec_id") -> Column:
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _to_row(graph: Graph) -> pa.RecordBatch:
    arrays = (graph.vectors, graph.ids, graph.id_start, graph.level, graph.base, graph.upper_start, graph.upper)
    kinds = (np.float64 if graph.vectors.dtype == np.float64 else np.float32, np.int64, np.int64, np.int8, np.int32, np.int64, np.int32)
    values = [graph.vectors.shape[1], len(graph.vectors), graph.entry, *(np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, kinds, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX, strict=True)], schema=_INDEX)


def _from_row(row: dict) -> Graph:
    n, dim = row["nodes"], row["dim"]
    vectors = np.frombuffer(row["vectors"], np.float32 if len(row["vectors"]) == 4 * n * dim else np.float64).reshape(n, dim)
    base = np.frombuffer(row["base"], np.int32).reshape(n, -1)
    level = np.frombuffer(row["level"], np.int8)
    upper = np.frombuffer(row["upper"], np.int32).reshape(int(level.sum()), -1) if level.sum() else np.empty((0, 1), np.int32)
    return Graph(vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_start"], np.int64), level, base, np.frombuffer(row["upper_start"], np.int64), upper, row["entry"])


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by length, shard, id and vector."""
    held: list[pa.Table] = []

    def built() -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        ids, vectors = table.column("vec_id").to_numpy(), _vectors(table.column("embedding"))
        first = np.r_[True, ids[1:] != ids[:-1]]
        return _to_row(build(ids[first], vectors[first]))

    at = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        key = np.stack([table.column("dim").to_numpy(), table.column("shard").to_numpy()])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            if at is not None and at != tuple(key[:, low]):
                yield built()
                held.clear()
            at = tuple(key[:, low])
            held.append(table.slice(low, high - low))
    if held:
        yield built()


def build_index(embeddings: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The table of graphs, one row for each shard, over every usable row of ``embeddings(vec_id, embedding)``."""
    spark = embeddings.sparkSession
    rows = embeddings.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    placed = dealt.repartition(max(parallelism(spark), min(shards, 10_000)), "dim", "shard").sortWithinPartitions("dim", "shard", "vec_id", "embedding")
    return stage_table(placed.mapInArrow(_build_shards, _INDEX_DDL))


def _search_shards(block, k: int, breadth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple[np.ndarray, list[np.ndarray]]] = block.value
        found: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                graph = _from_row(row)
                for query, q in zip(*by_dim.get(row["dim"], ((), ())), strict=True):
                    query = int(query)
                    near = [x for x in graph.search(q, k + 1, breadth) if x[1] != query][:k]
                    found[query] = sorted(found.get(query, []) + near, key=lambda x: (-x[0], x[1]))[:k]
        flat = [(query, i, s) for query, near in found.items() for s, i in near]
        if flat:
            a, b, c = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH_SEARCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``index`` for each usable row of
    ``queries(vec_id, embedding)``, without the query's own id."""
    spark = queries.sparkSession
    asked = queries.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stage_table(asked)
    bytes_ = asked.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-bytes_ // block_bytes))
    found = None
    for number in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        by_dim: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for query, q in zip(table.column("vec_id").to_pylist(), table.column("embedding"), strict=True):
            ids, vectors = by_dim.setdefault(len(q), ([], []))
            ids.append(query)
            vectors.append(q.values.to_numpy())
        sent = spark.sparkContext.broadcast(by_dim)
        part = stage_table(index.repartition(parallelism(spark)).mapInArrow(_search_shards(sent, k, breadth), "query_id long, vec_id long, score double"))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Rows whose id is divisible by ``every`` against all others."""
    return search(build_index(embeddings), embeddings.where(F.col("vec_id") % every == 0), k)
