"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard, shard results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.vectors import dimension, matrix, takes_part, unit
from corpusloom.session import Table, ship

#: Rows of a shard: an eighth of all, between these bounds and of no more bytes of vectors than a worker holds with ease.
LEAST_ROWS, MOST_ROWS, SHARD_BYTES = 8_192, 65_536, 64 << 20
#: Bytes of the queries that are sent to every executor at once.
QUERY_BYTES = 32 << 20


class Graph:
    """HNSW over unit rows. Each level holds one flat (nodes, degree) array of neighbours, -1 where there is none.

    Nodes are inserted in blocks: a block searches the graph of those before it in lock step, then its members are
    linked, with one another as well.
    """

    def __init__(self, x: np.ndarray, degree: int = 12, width: int = 64, block: int = 128, seed: int = 3) -> None:
        self.x, self.width = np.ascontiguousarray(x, np.float32), width
        n = len(x)
        self.top = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(degree)).astype(np.int64), 8)
        order = np.argsort(-self.top[: min(n, block)], kind="stable")  # the first block holds its own highest node first
        self.order = np.concatenate((order, np.arange(len(order), n)))
        levels = int(self.top.max()) + 1 if n else 1
        self.near = [np.full((n, 2 * degree if level == 0 else degree), -1, np.int32) for level in range(levels)]
        self.entry = int(self.order[0]) if n else -1
        begun = 1 if n else 0
        while begun < n:
            # Small blocks at first, so that early nodes see one another.
            end = min(n, begun + min(block, max(1, begun)))
            self._insert(self.order[begun:end])
            begun = end

    def _insert(self, nodes: np.ndarray) -> None:
        entry_level = int(self.top[self.entry])
        at = np.full((len(nodes), 1), self.entry, np.int64)
        for level in range(entry_level, -1, -1):
            joins = self.top[nodes] >= level
            found, score = self._search(self.x[nodes], at, level, self.width if joins.any() else 1)
            for_these = np.flatnonzero(joins)
            if len(for_these):
                self._link(nodes[for_these], found[for_these], score[for_these], level)
            at = found[:, : 1 if not joins.any() else 8]
        best = nodes[self.top[nodes].argmax()]
        if self.top[best] > entry_level:
            self.entry = int(best)

    def _link(self, nodes: np.ndarray, found: np.ndarray, score: np.ndarray, level: int) -> None:
        near = self.near[level]
        inner = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(inner, -np.inf)
        ids = np.concatenate((found, np.broadcast_to(nodes, (len(nodes), len(nodes)))), axis=1)
        value = np.concatenate((np.where(found >= 0, score, -np.inf), inner), axis=1)
        keep = min(self.width, value.shape[1])
        pick = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
        ids, value = np.take_along_axis(ids, pick, 1), np.take_along_axis(value, pick, 1)
        near[nodes] = self._spread(nodes, ids, value, near.shape[1])
        back: dict[int, list[int]] = {}
        for node, row in zip(nodes.tolist(), near[nodes].tolist()):
            for other in row:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        others = np.array(list(back), np.int64)
        if not len(others):
            return
        most = max(map(len, back.values()))
        added = np.full((len(others), most), -1, np.int64)
        for r, own in enumerate(back.values()):
            added[r, : len(own)] = own
        ids = np.concatenate((near[others].astype(np.int64), added), axis=1)
        value = np.einsum("ijk,ik->ij", self.x[ids], self.x[others])
        again = (added[:, :, None] == near[others][:, None, :]).any(axis=2)
        value[:, near.shape[1] :][again] = -np.inf
        value[ids < 0] = -np.inf
        near[others] = self._spread(others, ids, value, near.shape[1])

    def _spread(self, nodes: np.ndarray, ids: np.ndarray, value: np.ndarray, degree: int) -> np.ndarray:
        """Neighbour choice: nearest first, skipping one that is nearer to a chosen one than to the node; gaps are then
        filled with the nearest that were skipped."""
        order = np.argsort(-value, axis=1, kind="stable")[:, : 3 * degree]
        ids, value = np.take_along_axis(ids, order, 1), np.take_along_axis(value, order, 1)
        ok = np.isfinite(value)
        v = self.x[np.where(ok, ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            nearer = (between[:, k, :k] > value[:, k, None]) & chosen[:, :k]
            chosen[:, k] = ok[:, k] & ~nearer.any(axis=1)
        rank = np.where(chosen, 0, np.where(ok, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :degree]
        out = np.where(np.take_along_axis(ok, pick, 1), np.take_along_axis(ids, pick, 1), -1).astype(np.int32)
        if out.shape[1] < degree:
            out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
        return out

    def _search(self, q: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows of q in lock step: (ids, inner products), best first, -1 where fewer were met."""
        b, rows = len(q), np.arange(len(q))
        near = self.near[level]
        met = np.zeros((b, len(self.x)), bool)
        ids = np.full((b, width), -1, np.int64)
        value = np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)
        k = min(start.shape[1], width)
        first = start[:, :k]
        ids[:, :k] = first
        value[:, :k] = np.where(first >= 0, np.einsum("ijk,ik->ij", self.x[first], q), -np.inf)
        done[:, :k] = first < 0
        met[rows[:, None], np.maximum(first, 0)] = True
        live = rows
        while len(live):
            todo = np.where(done[live], -np.inf, value[live])
            at = todo.argmax(axis=1)
            more = np.isfinite(todo[np.arange(len(live)), at])
            live, at = live[more], at[more]
            if not len(live):
                break
            done[live, at] = True
            n = near[ids[live, at]].astype(np.int64)
            new = (n >= 0) & ~met[live[:, None], np.maximum(n, 0)]
            met[live[:, None], np.maximum(n, 0)] |= new
            s = np.where(new, np.einsum("ijk,ik->ij", self.x[n], q[live]), -np.inf)
            all_ids = np.concatenate((ids[live], n), axis=1)
            all_value = np.concatenate((value[live], s), axis=1)
            all_done = np.concatenate((done[live], ~new), axis=1)
            best = np.argsort(-all_value, axis=1, kind="stable")[:, :width]
            value[live] = np.take_along_axis(all_value, best, 1)
            ids[live] = np.where(np.isfinite(value[live]), np.take_along_axis(all_ids, best, 1), -1)
            done[live] = np.take_along_axis(all_done, best, 1) | (ids[live] < 0)
        return ids, value

    @classmethod
    def of_arrays(cls, x: np.ndarray, near: list[np.ndarray], entry: int) -> Graph:
        """A graph to search, of the arrays that were stored of one."""
        graph = cls.__new__(cls)
        graph.x, graph.near, graph.entry = np.ascontiguousarray(x, np.float32), near, entry
        return graph

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Ids of up to `width` near rows for each row of q, best first."""
        at = np.full((len(q), 1), self.entry, np.int64)
        for level in range(len(self.near) - 1, 0, -1):  # the entry is of the highest level
            at = self._search(np.asarray(q, np.float32), at, level, 4)[0]
        return self._search(np.asarray(q, np.float32), at, 0, width)[0]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int | None = None,
    width: int = 96,
    block: int = 128,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows by cosine, none with the query's own id.

    Nearest first, ties to the smaller vec_id; the score is the cosine of the original vectors in double precision.
    Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do null ids; shorter
    ones count as padded with zeros. A repeated query row gives its result once; repeated candidate rows are one.
    Other columns are ignored; empty tables give an empty table.

    Every row is indexed: shards by a hash of the id, each stored as one row of flat arrays. Equal vectors of a shard
    are one node that stands for its k + 1 smallest ids, so many copies neither crowd the graph nor a task. Queries are
    broadcast in blocks of QUERY_BYTES; a block passes over the stored graphs once, each read by one task, and only k
    rows a query and shard are shuffled to be merged. Neither graphs nor queries are.
    """
    spark = ship(vectors.sparkSession)

    def ready(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.filter(takes_part(F.col("v")) & F.col("vec_id").isNotNull())

    rows, asked = ready(vectors), ready(queries).dropDuplicates(["vec_id"])
    schema = "query_id long, vec_id long, score double"
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(dim, dimension(asked, "v"))
    most = max(1, min(MOST_ROWS, SHARD_BYTES // (8 * dim)))
    shards = max(1, math.ceil(n / (shard_rows or min(most, max(LEAST_ROWS, n // 8)))))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(shard: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        ids, first = np.unique(ids, return_index=True)
        x = unit(x[first])
        _, first, of = np.unique(x.astype(np.float32), axis=0, return_index=True, return_inverse=True)
        by = np.lexsort((ids, of.ravel()))
        start = np.searchsorted(of.ravel()[by], np.arange(len(first) + 1))
        ids, x = ids[by], x[by]
        graph = Graph(x[start[:-1]], width=64, block=block)
        blobs = [pa.array([a.tobytes()], pa.large_binary()) for a in (ids, x, start.astype(np.int64))]
        near = pa.array([[level.tobytes() for level in graph.near]], pa.list_(pa.binary()))
        columns = [pa.array([shard], pa.int32()), *(a.cast(pa.binary()) for a in blobs), near, pa.array([graph.entry], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "x", "start", "near", "entry"])

    def build_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is one shard; should it hold several, they come one after the other.
        now, ids, xs = None, [], []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                if shard[begin] != now:
                    if ids:
                        yield build(now, np.concatenate(ids), np.concatenate(xs))
                    now, ids, xs = int(shard[begin]), [], []
                ids.append(batch.column(1).slice(begin, end - begin).to_numpy())
                xs.append(matrix(batch.column(2).slice(begin, end - begin), dim))
        if ids:
            yield build(now, np.concatenate(ids), np.concatenate(xs))

    dealt = sharded.repartitionById(shards, "shard").sortWithinPartitions("shard", "vec_id").select("shard", "vec_id", "v")
    index = Table(dealt.mapInArrow(build_all, "shard int, ids binary, x binary, start binary, near array<binary>, entry long"))

    def searcher(block_of_queries):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_ids, asked_x = block_of_queries.value
            for batch in batches:
                for stored in batch.to_pylist():
                    ids, start = np.frombuffer(stored["ids"], np.int64), np.frombuffer(stored["start"], np.int64)
                    x = np.frombuffer(stored["x"]).reshape(-1, dim)
                    near_by_level = [np.frombuffer(level, np.int32).reshape(len(start) - 1, -1) for level in stored["near"]]
                    graph = Graph.of_arrays(x[start[:-1]], near_by_level, stored["entry"])
                    for at in range(0, len(asked_ids), 256):
                        yield best_of(graph, ids, start, x, asked_ids[at : at + 256], asked_x[at : at + 256])

        return search

    def best_of(graph: Graph, ids, start, x, queries: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        parts = []
        for row, (query, nodes) in enumerate(zip(queries, graph.search(q, width))):
            nodes = nodes[nodes >= 0]
            near = np.concatenate([np.arange(start[m], min(start[m + 1], start[m] + k + 1)) for m in nodes[: 4 * k]])
            near = near[ids[near] != query]
            score = np.einsum("ij,j->i", x[near], q[row])
            best = np.lexsort((ids[near], -score))[:k]
            parts.append((np.full(len(best), query), ids[near][best], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[c] for p in parts])) for c in range(3)], ["query_id", "vec_id", "score"])

    # Queries come to the driver a block at a time; a block's size is bounded whatever their number.
    blocks = math.ceil(asked.count() * 8 * (dim + 1) / QUERY_BYTES)
    asked = Table(asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, blocks))))).df
    found = spark.createDataFrame([], schema)
    for part in range(blocks):
        held = asked.filter(F.col("part") == part).select("vec_id", "v").toArrow().combine_chunks()
        if held.num_rows:
            q = unit(matrix(held.column("v").chunk(0), dim))
            sent = spark.sparkContext.broadcast((held.column("vec_id").to_numpy(), q))
            found = found.union(Table(index.df.mapInArrow(searcher(sent), schema)).df)
            sent.unpersist()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
