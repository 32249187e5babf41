"""Exact top-k by integer inner product with KD-trees per shard.

Rows are dealt to shards by their length and the hash of their id. A shard's distinct vectors are split at medians into a tree
whose nodes keep tight bounding boxes. A query walks the tree best-first: the bound of a box is the largest inner
product that any point inside could have, and a box whose bound is below the k-th score so far is
never opened. The k-th score travels: a query first visits one shard, and what it finds there is the
starting k-th score in all the others.

Equal vectors have equal scores for every query and ties go to the smaller id, so of equal vectors in a shard only the
k + 1 smallest ids can ever be returned (one of them may be the query itself). This is a property of the order, not a cap.
Shards are streamed: a task holds the tree of one shard and a batch of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import map_batches
from barloom.session import cut

SHARD_ROWS = 16_384
LEAF = 256
K = 20
EXACT = 1 << 53  # doubles hold whole numbers up to here


class Tree:
    """Median splits with tight boxes over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        if len(points):
            self.points, group = np.unique(points, axis=0, return_inverse=True)
            by_group = np.argsort(group.ravel(), kind="stable")
            counts = np.bincount(group.ravel(), minlength=len(self.points))
            starts = np.concatenate([[0], np.cumsum(counts)])
            self.ids = [np.unique(ids[by_group[a:b]])[:k + 1] for a, b in zip(starts[:-1], starts[1:])]
        else:
            self.points, self.ids = points, []
        self.k = k
        self.wide = bool(len(points)) and float(np.abs(points).max()) ** 2 * points.shape[1] >= EXACT
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray | None] = []
        if len(self.points):
            self._grow()
            kind = np.int64 if self.wide else np.float64
            self.low_box, self.high_box = np.array(self.low, kind), np.array(self.high, kind)
            self.values = self.points.astype(kind)

    def _node(self, members: np.ndarray) -> int:
        own = self.points[members]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.children.append(None)
        self.members.append(members)
        return len(self.members) - 1

    def _grow(self) -> None:
        waiting = [self._node(np.arange(len(self.points)))]
        while waiting:
            node = waiting.pop()
            members = self.members[node]
            if len(members) <= LEAF:
                continue
            axis = int(np.argmax(self.high[node] - self.low[node]))
            middle = len(members) // 2
            order = np.argpartition(self.points[members, axis], middle)
            left, right = self._node(members[order[:middle]]), self._node(members[order[middle:]])
            self.members[node], self.children[node] = None, (left, right)
            waiting += [left, right]

    def search(self, queries: np.ndarray, own_ids: np.ndarray, floor: np.ndarray) -> list[list[tuple[int, int]]]:
        """Best (score, id) lists. ``floor``: k-th scores known from elsewhere; lower scores are not wanted."""
        if not len(self.points):
            return [[] for _ in own_ids]
        queries = queries.astype(self.low_box.dtype)
        if not self.wide and len(queries) and \
                float(np.abs(queries).max()) * float(np.abs(self.points).max()) * queries.shape[1] >= EXACT:
            self.wide = True
            self.low_box, self.high_box, self.values = (
                x.astype(np.int64) for x in (self.low_box, self.high_box, self.points))
            queries = queries.astype(np.int64)
        bounds = np.maximum(queries, 0) @ self.high_box.T + np.minimum(queries, 0) @ self.low_box.T
        return [self._best(q, int(own), int(least), b)
                for q, own, least, b in zip(queries, own_ids, floor, bounds)]

    def _best(self, query: np.ndarray, own: int, least: int, bound: np.ndarray) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []  # heap of (score, -id); the worst is first
        k = self.k
        open_boxes = [(-bound[0], 0)]
        while open_boxes:
            top, node = heapq.heappop(open_boxes)
            if -top < least:
                break
            pair = self.children[node]
            if pair is not None:
                for child in pair:
                    if bound[child] >= least:
                        heapq.heappush(open_boxes, (-bound[child], child))
                continue
            members = self.members[node]
            scores = self.values[members] @ query
            for at in np.flatnonzero(scores >= least):
                score = int(scores[at])
                for ident in self.ids[members[at]]:
                    ident = int(ident)
                    if ident == own:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, (score, -ident))
                    elif (score, -ident) > found[0]:
                        heapq.heapreplace(found, (score, -ident))
                    else:
                        break
            if len(found) == k:
                least = max(least, found[0][0])
        return [(score, -ident) for score, ident in found]


LOWEST = -(1 << 62)
_SCHEMA = "query_id long, vec_id long, score long, floor long"


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """Search of a stream of rows ``shard, query, id, vector, floor``, sorted so that a shard's points come first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        shard, tree, ids, points = None, None, [], []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            idents = batch.column(2).to_numpy()
            lists = batch.column(3)
            floors = batch.column(4).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(shards) | np.diff(asks.astype(np.int8)).astype(bool)) + 1
            for a, b in zip([0, *edges], [*edges, len(shards)]):
                if a == b:
                    continue
                own = lists.slice(a, b - a)
                matrix = own.flatten().to_numpy().reshape(b - a, -1)
                if shards[a] != shard:
                    shard, tree, ids, points = shards[a], None, [], []
                if not asks[a]:
                    ids.append(idents[a:b])
                    points.append(matrix)
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids), np.concatenate(points), k) if ids else None
                    ids, points = [], []
                if tree is None:
                    continue
                found = tree.search(matrix, idents[a:b], floors[a:b])
                sizes = [len(x) for x in found]
                flat = [pair for x in found for pair in x]
                yield {"query_id": np.repeat(idents[a:b], sizes), "vec_id": [x[1] for x in flat],
                       "score": [x[0] for x in flat], "floor": np.repeat(floors[a:b], sizes)}

    return map_batches(rows, work, _SCHEMA)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` other than the query, for every query.

    Components become ``floor(scale * x)``. Defined cases: rows with a null id, a null vector, or null or non-finite
    components take no part; a query meets vectors of its own length; rows that repeat an id and a vector are one row; fewer rows give fewer ranks; no queries give an empty result; other columns are ignored.
    """
    def whole(frame: DataFrame) -> DataFrame:
        usable = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (
            frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(usable)
            .select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("vector"))
        )

    points = whole(vectors)
    count = points.count()
    if not count:
        return points.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                             F.col("id").alias("score")).limit(0)
    shards = max(1, -(-count // shard_rows))
    asked = whole(queries).distinct()
    # Vectors of each length have shards of their own.
    first = F.size("vector").cast("long") * shards
    shard = first + F.pmod(F.xxhash64("id"), F.lit(shards))
    stored = points.select(shard.alias("shard"), F.lit(False).alias("query"), "id", "vector",
                           F.lit(LOWEST).alias("floor"))

    def visit(asks: DataFrame) -> DataFrame:
        return _searched(stored.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "query"), k)

    home = cut(visit(asked.select(shard.alias("shard"), F.lit(True).alias("query"), "id", "vector",
                                  F.lit(LOWEST).alias("floor"))))
    kth = home.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LOWEST)).alias("floor"))
    if shards > 1:
        others = (
            asked.join(kth, F.col("id") == F.col("query_id"), "left")
            .select(shard.alias("home"), "id", "vector", F.coalesce("floor", F.lit(LOWEST)).alias("floor"))
            .select("home", "id", "vector", "floor", F.explode(F.sequence(first, first + shards - 1)).alias("shard"))
            .where("shard <> home").select("shard", F.lit(True).alias("query"), "id", "vector", "floor")
        )
        home = home.unionByName(visit(others))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        home.select("query_id", "vec_id", "score").distinct()
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
