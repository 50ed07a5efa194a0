"""Exact top-k inner products by KD-trees per shard.

Vectors become integer vectors. They are dealt out evenly into shards of bounded size; each shard becomes a KD-tree (median splits of
the widest dimension, tight bounding boxes, the smallest id below each node), stored as one row of an index table. Shards form groups.
Queries are packed into blocks of bounded size; every block is sent to every group, where the group's trees come first and the blocks
then stream by, all in one job that holds one group's trees and one block at a time. The driver sees no vector. A query walks a tree
best-first by the largest product that a box admits and stops where no box can beat its k-th best so far; that bound is carried from
tree to tree within the group. The best of all groups meet at the end: k + 1 rows for each query and group, as the query's own row is
among them and is then left out.

Defined results: null vectors, and those with null or non-finite components, take no part; nor do rows without an id. A query meets
vectors of its own length only. Every row with a fitting id asks, and meets all rows but itself: of rows that share an id each asks, and
meets the others. Ties go to the smaller id. Queries without candidates give no rows, nor does an empty table. Scores are exact; one
beyond 64 bits is shown as the nearest 64-bit integer, but ranks as what it is. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactica.llm.common import short_batches, stored

K = 5
EVERY = 50
SHARD_ROWS = 4096
LEAF = 64
#: Queries in one block, and trees in one group.
BLOCK = 2048
GROUP = 32
_EXACT, _LONG = 2**53, 2**63


class Tree:
    """A KD-tree over integer vectors; rows lie in leaf order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, children or -1
        low, high, least = [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = rows[order[a:b]]
            k = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            if parent >= 0:
                s, e, left, right = self.nodes[parent]
                self.nodes[parent] = (s, e, k, right) if side == 0 else (s, e, left, k)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            least.append(int(ids[order[a:b]].min()))
            spread = high[-1] - low[-1]
            if b - a > leaf and spread.size and spread.max() > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], mid)]
                todo += [(a, a + mid, k, 0), (a + mid, b, k, 1)]
        self.ids, self.rows, self.low, self.high, self.least = ids[order], rows[order], np.array(low), np.array(high), least

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query with any point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, q: np.ndarray, bounds: list, best: list[tuple[int, int]], k: int) -> None:
        """best: a heap of (score, -id), the worst first; it is improved in place."""
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k and (-bound, -self.least[node]) < best[0]:
                if -bound < best[0][0]:
                    return
                continue
            a, b, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            scores = self.rows[a:b] @ q
            near = np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(b - a)
            for i in near:
                pair = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    heapq.heapreplace(best, pair)

    def cast(self, kind: type) -> None:
        self.rows, self.low, self.high = self.rows.astype(kind), self.low.astype(kind), self.high.astype(kind)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v): v holds floor(256 * x) of the components."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


def _by_length(ids: np.ndarray, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array(lists.value_lengths())
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        part = lists.take(pa.array(own))
        yield ids[own], part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), int(n))


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """Rows (shard, dim, data): the trees of all shards."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            shard, table = TaskContext.get().partitionId(), pa.Table.from_batches(held).combine_chunks()
            for i, m in _by_length(table.column(0).to_numpy(), table.column(1).chunk(0)):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([pickle.dumps(Tree(i, m, leaf))], pa.binary())], ["shard", "dim", "data"])

    shards = max(1, -(-rows.count() // shard_rows))
    return stored(rows.repartition(shards).mapInArrow(each, "shard int, dim int, data binary"), "trees")


def packed(queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (dim, data): blocks of queries (vec_id, v), which are numbered."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, m in _by_length(batch.column(0).to_numpy(), batch.column(1)):
                for a in range(0, len(ids), block):
                    own = ids[a : a + block]
                    yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([pickle.dumps((n, own, m[a : a + block]))], pa.binary())], ["dim", "data"])
                    n += len(own)

    return queries.select("vec_id", "v").mapInArrow(each, "dim int, data binary")


def _answers(trees: list[Tree], n: int, ids: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each query over all trees; products in floating point where they are exact, which is faster, else in integers."""
    most = max([int(abs(int(x))) for m in (q, *(t.rows for t in trees)) if m.size for x in (m.min(), m.max())], default=0) ** 2 * max(q.shape[1], 1)
    kind = float if most < _EXACT else np.int64 if most < _LONG else object
    own = q.astype(kind)
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(ids))]
    for tree in trees:
        tree.cast(kind)
        bounds = tree.bounds(own)
        for j in range(len(ids)):
            tree.search(own[j], bounds[j].tolist(), best[j], k)
    exact = q.astype(object if kind is object else np.int64)
    rows = [(n + j, int(ids[j]), -at, int(score), at == -ids[j] and score == int(exact[j] @ exact[j])) for j, found in enumerate(best) for score, at in found]
    #: what is clipped is told apart by its digits, which sort as the numbers do
    clip = [max(-_LONG, min(_LONG - 1, r[3])) for r in rows]
    return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array(clip, pa.int64()), pa.array([f"{r[3] + (1 << 200):051x}" if c != r[3] else "" for r, c in zip(rows, clip, strict=True)]), pa.array([r[4] for r in rows], pa.bool_())], ["q", "query_id", "vec_id", "score", "beyond", "own"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """Rows (query_id, rank, vec_id, score); rows are (vec_id, v), and queries are some of them."""
    trees = index(rows, shard_rows, leaf)
    shards = (trees.agg(F.max("shard")).first()[0] or 0) + 1
    groups = max(min(shards, rows.sparkSession.sparkContext.defaultParallelism), -(-shards // group))
    left = trees.select((F.col("shard") % groups).alias("g"), F.lit(0).alias("kind"), "dim", "data")
    right = packed(queries, block).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "dim", "data")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for g, kind, dim, data in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if g != now:
                    now, held = g, {}
                if kind == 0:
                    held.setdefault(dim, []).append(pickle.loads(data.as_py()))
                elif dim in held and (out := _answers(held[dim], *pickle.loads(data.as_py()), k + 1)).num_rows:
                    yield out

    sorted_ = left.unionByName(right).repartition(groups, "g").sortWithinPartitions("g", "kind")
    found = sorted_.mapInArrow(each, "q long, query_id long, vec_id long, score long, beyond string, own boolean")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    best = best.withColumn("o", F.min(F.when(F.col("own"), F.col("r"))).over(Window.partitionBy("q")))
    rank = F.col("r") - F.when(F.col("o") < F.col("r"), 1).otherwise(0)
    kept = best.filter(F.col("o").isNull() | (F.col("o") != F.col("r"))).withColumn("rank", rank.cast("int"))
    return kept.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    short_batches(spark)
    rows = stored(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "integers")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
