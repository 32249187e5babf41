"""Approximate nearest neighbours by cosine: low-dimensional stable projections, kd-trees and a chi-square stopping test.

Vectors are scaled to length one, so that the largest cosine is the smallest distance, and projected by `DIMS` normal
(2-stable) directions: the squared distance of two projections is the squared distance of the vectors times a chi-square
variable of `DIMS` degrees. A query takes the points of a kd-tree over projections in order of projected distance, a leaf at
a time, and verifies them on the original vectors. It stops at projected distance r as soon as a point nearer than its
k-th best would lie inside r with chance `SURE`: then ``chi2(r^2 / d_k^2) >= SURE``.

Shards are cells of one kd-tree over the projections of a bounded sample (`SAMPLE` vectors, those with the smallest hashes);
every vector is in the index. A query searches its own cell first. The k-th distance found there and the tight box of every
other cell give the test for the whole cell, and only cells that fail it are visited. Large cells are dealt to several
shards by hash. Of equal vectors only the k + 1 smallest ids can be returned, as ties go to the smaller id; more are
left out before the shuffle. This follows from the order, it is no cap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import map_batches
from barloom.session import cut

K = 5
DIMS = 16
SURE = 0.9
LEAF = 256
OPENED = 8  # leaves opened at a time
FIRST, STEP = 32, 256  # points verified before the first test and between two others
SPARE = 3  # candidates beyond k that are held in single precision until the scores are computed in double
SHARD_ROWS = 16_384
SAMPLE, MAX_CELLS = 20_000, 1_024
FAR = 4.0 + 1e-9  # squared distance of opposite unit vectors, and no more


def chi_square(x: np.ndarray | float) -> np.ndarray:
    """Distribution function of the chi-square variable of DIMS (even) degrees."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, DIMS // 2):
        term = term * half / i
        total = total + term
    return np.where(np.isinf(half), 1.0, 1 - np.exp(-np.minimum(half, 700)) * total)


def _reach() -> float:
    """The x with ``chi_square(x) = SURE``, by halving."""
    low, high = 0.0, 50.0 * DIMS
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < SURE else (low, middle)
    return high


REACH = _reach()


@cache
def directions(size: int) -> np.ndarray:
    """Normal directions of a vector length, the same everywhere."""
    return np.random.default_rng(size).standard_normal((size, DIMS))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def projected(vectors: np.ndarray) -> np.ndarray:
    return _unit(vectors) @ directions(vectors.shape[1])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of rows with a query in double precision, the same for equal vectors in any company."""
    scale, own = np.abs(vectors).max(1, keepdims=True), np.abs(query).max()
    vectors, query = vectors / scale, query / own
    return (vectors * query).sum(1) / np.sqrt((vectors * vectors).sum(1) * (query * query).sum())


class Cells:
    """Median splits of a sample of projections; a point goes to the cell on its side of every split."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.axis, self.value, self.children = [], [], []
        self.count = 0
        self._grow(sample, max(1, min(cells, len(sample))))

    def _grow(self, points: np.ndarray, cells: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.value.append(0.0)
        self.children.append((0, 0))
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
        left = cells // 2
        value = float(np.quantile(points[:, axis], left / cells)) if len(points) else 0.0
        below = points[:, axis] < value if len(points) else np.zeros(0, bool)
        if cells == 1 or not below.any() or below.all():
            self.children[node] = (self.count, self.count)
            self.count += 1
            return node
        self.axis[node], self.value[node] = axis, value
        self.children[node] = (self._grow(points[below], left), self._grow(points[~below], cells - left))
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, own = waiting.pop()
            if self.axis[node] < 0:
                out[own] = self.children[node][0]
                continue
            below = points[own, self.axis[node]] < self.value[node]
            waiting += [(self.children[node][0], own[below]), (self.children[node][1], own[~below])]
        return out


class Tree:
    """A kd-tree over the projections of a shard: leaves with tight boxes."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], k: int) -> None:
        self.vectors, self.ids, self.k = vectors, ids, k
        self.points = projected(vectors)
        self.units = _unit(vectors).astype(np.float32)
        low, high, self.leaves = [], [], []
        waiting = [np.arange(len(vectors))]
        while waiting:
            members = waiting.pop()
            own = self.points[members]
            axis = int(np.argmax(np.ptp(own, axis=0)))
            if len(members) <= LEAF or not np.ptp(own[:, axis]):
                low.append(own.min(0))
                high.append(own.max(0))
                self.leaves.append(members)
                continue
            order = np.argpartition(own[:, axis], len(members) // 2)
            waiting += [members[order[:len(members) // 2]], members[order[len(members) // 2:]]]
        self.low, self.high = np.array(low), np.array(high)
        self.verified = 0

    def search(self, query: np.ndarray, own_id: int, reach: float) -> list[tuple[float, int]]:
        """Nearest (cosine, id) pairs; ``reach``: squared distance of the k-th best known from elsewhere."""
        unit, place = _unit(query[None])[0].astype(np.float32), projected(query[None])[0]
        held = self.k + SPARE
        gaps = np.maximum(0, np.maximum(self.low - place, place - self.high))
        bounds = (gaps * gaps).sum(1)
        found: list[tuple[float, int, int]] = []  # heap of (nearness, -id, row); the worst is first
        waiting_at, waiting_row = np.zeros(0), np.zeros(0, np.int64)
        order = np.argsort(bounds)
        for step in range(0, len(order), OPENED):
            if bounds[order[step]] > REACH * reach:
                break
            members = np.concatenate([self.leaves[leaf] for leaf in order[step:step + OPENED]])
            off = self.points[members] - place
            waiting_at = np.concatenate([waiting_at, (off * off).sum(1)])
            waiting_row = np.concatenate([waiting_row, members])
            # Points up to the bound of the next leaf are next in order of projected distance, of those the test lets in.
            bound = bounds[order[step + OPENED]] if step + OPENED < len(order) else np.inf
            ready = np.flatnonzero(waiting_at <= min(bound, REACH * reach))
            if not len(ready):
                continue
            ready = ready[np.argsort(waiting_at[ready])]
            a = 0
            while a < len(ready) and waiting_at[ready[a]] <= REACH * reach:
                size = STEP if len(found) >= self.k else FIRST
                rows = waiting_row[ready[a:a + size]]
                a += size
                self.verified += len(rows)
                near = self.units.take(rows, axis=0) @ unit
                least = found[0][0] if len(found) == held else -2.0
                for at in np.flatnonzero(near >= least):
                    row = int(rows[at])
                    for ident in self.ids[row]:
                        if ident == own_id:
                            continue
                        entry = (float(near[at]), -ident, row)
                        if len(found) < held:
                            heapq.heappush(found, entry)
                        elif entry > found[0]:
                            heapq.heapreplace(found, entry)
                        else:
                            break
                if len(found) >= self.k:
                    kth = heapq.nlargest(self.k, found)[-1][0]
                    reach = min(reach, max(0.0, 2 - 2 * kth) + 1e-6)
            keep = waiting_at > bound
            waiting_at, waiting_row = waiting_at[keep], waiting_row[keep]
        if not found:
            return []
        scores = cosines(self.vectors[[row for *_, row in found]], query)
        return [(score, -ident) for score, ident in heapq.nlargest(
            self.k, [(float(score), ident) for score, (_, ident, _) in zip(scores, found)])]


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """Search of a stream of rows ``shard, asks, ids, vector, reach``, sorted so that a shard's points come before its queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        shard, tree, ids, points = None, None, [], []
        for batch in batches:
            names, asks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own, vectors, reach = batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()
            query_ids, vec_ids, scores = [], [], []
            for i, name in enumerate(names):
                if name != shard:
                    shard, tree, ids, points = name, None, [], []
                vector = vectors[i].values.to_numpy()
                if not asks[i]:
                    ids.append(sorted(own[i]))
                    points.append(vector)
                    continue
                if tree is None and points:
                    tree, points = Tree(np.array(points), ids, k), []
                for score, ident in tree.search(vector, own[i][0], reach[i]) if tree else ():
                    query_ids.append(own[i][0])
                    vec_ids.append(ident)
                    scores.append(score)
            yield {"query_id": query_ids, "vec_id": vec_ids, "score": scores}

    return map_batches(rows, work, "query_id long, vec_id long, score double")


def _usable(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` (doubles) of rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite)
        .where(F.exists("vector", lambda x: x != 0))
    )


def _cells(frame: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """``length, cell, place`` (the projection) of every row, beside its columns."""
    names = frame.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.array([len(x) for x in vectors], np.int64)
            cell, place = np.zeros(len(lengths), np.int64), [b""] * len(lengths)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                points = projected(np.array([vectors[int(i)].values.to_numpy() for i in own]))
                cell[own] = cells[int(length)].of(points) if int(length) in cells else 0
                for i, point in zip(own, points):
                    place[i] = point.tolist()
            yield {**{name: batch.column(name) for name in names}, "length": lengths, "cell": cell, "place": place}

    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in frame.schema)
    return map_batches(frame, work, schema + ", length long, cell long, place array<double>")


def _sampled_cells(distinct: DataFrame, counts: dict[int, int]) -> dict[int, Cells]:
    """Cells of every vector length with more than a shard of vectors, from at most SAMPLE vectors in all."""
    large = {length: count for length, count in counts.items() if count > SHARD_ROWS}
    if not large:
        return {}
    rows = (
        distinct.where(F.size("vector").isin(list(large))).select("vector")
        .orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()
    )
    points: dict[int, list] = {length: [] for length in large}
    for row in rows:
        points[len(row.vector)].append(row.vector)
    return {
        length: Cells(projected(np.array(own)), min(MAX_CELLS, -(-large[length] // SHARD_ROWS)))
        for length, own in points.items() if own
    }


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every query, by cosine.

    Defined cases: rows with a null id, a null or all-zero vector, or null or non-finite components take no part; a query
    meets vectors of its own length only; rows that repeat an id and a vector are one row; an id never meets itself; ties go
    to the smaller id; fewer rows give fewer ranks; empty tables give an empty result; other columns are ignored.
    """
    by_vector = Window.partitionBy("vector").orderBy("id")
    distinct = cut(
        _usable(vectors, id_col, vector_col).distinct().withColumn("copy", F.row_number().over(by_vector))
        .where(F.col("copy") <= k + 1).groupBy("vector").agg(F.collect_list("id").alias("ids"))
    )
    counts = dict(distinct.groupBy(F.size("vector")).count().collect()[:]) if distinct.take(1) else {}
    cells = _sampled_cells(distinct, counts)
    asked = cut(_cells(_usable(queries, id_col, vector_col).distinct(), cells))
    index = cut(_cells(distinct, cells))
    names = ["length", "cell"]
    sides = [F.min(F.element_at("place", i + 1)).alias(f"low{i}") for i in range(DIMS)] + [
        F.max(F.element_at("place", i + 1)).alias(f"high{i}") for i in range(DIMS)]
    # At most MAX_CELLS rows for every length of vector.
    boxes = index.groupBy(*names).agg(F.count("*").alias("n"), *sides).collect()
    parts = {(box.length, box.cell): max(1, -(-box.n // shard_rows)) for box in boxes}
    tight = {}
    for box in boxes:
        tight.setdefault(box.length, []).append(
            (box.cell, [box[f"low{i}"] for i in range(DIMS)], [box[f"high{i}"] for i in range(DIMS)]))
    tight = {length: tuple(np.array(side) for side in zip(*own)) for length, own in tight.items()}

    def parts_of() -> Column:
        many = {name: n for name, n in parts.items() if n > 1}
        if not many:
            return F.lit(1)
        known = F.create_map(*[F.lit(x) for (length, cell), n in many.items() for x in (f"{length}/{cell}", n)])
        return F.coalesce(known[F.concat_ws("/", "length", "cell")], F.lit(1))

    shard = lambda part: F.concat_ws("/", "length", "cell", part).alias("shard")
    stored = index.select(shard(F.pmod(F.xxhash64("vector"), parts_of())), F.lit(False).alias("asks"), "ids", "vector",
                          F.lit(FAR).alias("reach"))

    def visit(rows: DataFrame) -> DataFrame:
        """Search of ``length, cell, id, vector, reach`` in all shards of the cell."""
        asks = (
            rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of() - 1)))
            .select(shard(F.col("part")), F.lit(True).alias("asks"), F.array("id").alias("ids"), "vector", "reach")
        )
        return _searched(stored.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "asks"), k)

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            out: list[tuple] = []
            for i, (length, own, reach) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("length", "cell", "reach")))):
                cell, low, high = tight.get(length, (np.zeros(0, np.int64), np.zeros((0, DIMS)), np.zeros((0, DIMS))))
                place = batch.column("place")[i].values.to_numpy()
                gaps = np.maximum(0, np.maximum(low - place, place - high))
                near = (gaps * gaps).sum(1) <= REACH * reach
                out += [(i, int(name)) for name in cell[near & (cell != own)]]
            rows = pa.array([i for i, _ in out], pa.int64())
            yield {"length": batch.column("length").take(rows), "cell": [name for _, name in out], "id": batch.column("id").take(rows),
                   "vector": batch.column("vector").take(rows), "reach": batch.column("reach").take(rows)}

    found = cut(visit(asked.withColumn("reach", F.lit(FAR))))
    if any(len(own[0]) > 1 for own in tight.values()):
        nearness = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = (
            found.withColumn("rank", F.row_number().over(nearness)).where(F.col("rank") == k)
            .select(F.col("query_id").alias("id"), F.greatest(F.lit(1e-12), 2 - 2 * F.col("score") + 1e-12).alias("reach"))
        )
        again = asked.join(kth, "id", "left").fillna({"reach": FAR})
        more = map_batches(again, elsewhere, "length long, cell long, id long, vector array<double>, reach double")
        found = found.unionByName(visit(more))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
