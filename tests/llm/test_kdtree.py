import random

import numpy as np
import pytest

from barloom.llm import kdtree

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    usable = {(i, tuple(v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, np.floor(64.0 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in usable]
    out = set()
    for i, q in whole:
        if asked(i):
            found = sorted((-int(q @ v), j) for j, v in whole if j != i)[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 40])
def test_equals_brute_force_with_ties_copies_and_bad_vectors(spark, shard_rows):
    own = random.Random(shard_rows)
    rows = [(i, [round(own.gauss(0, 0.2), 1) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.1, 0.1, 0.1, 0.1]) for i in range(300, 380)]  # one very common vector
    rows += [(400, None), (401, [0.1, None, 0.2, 0.3]), (402, [float("nan")] * 4), (403, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows.append(rows[20])
    frame = spark.createDataFrame(rows, SCHEMA)
    got = kdtree.top_k(frame, frame.where("vec_id % 20 = 0"), k=5, shard_rows=shard_rows)
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 20 == 0, 5)
    assert got.count() == len(brute(rows, lambda i: i % 20 == 0, 5))


def test_fewer_rows_than_k_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], SCHEMA)
    assert kdtree.top_k(few, few.where("vec_id = 0")).count() == 2
    none = spark.createDataFrame([], SCHEMA)
    assert kdtree.top_k(none, none).count() == 0 and kdtree.top_k(few, none).count() == 0
    clash = few.selectExpr("*", "1L AS id", "2L AS vector", "'x' AS shard", "0 AS score")
    assert kdtree.top_k(clash, clash).columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("shard_rows", [10_000, 20])
def test_a_query_meets_vectors_of_its_length(spark, shard_rows):
    own = random.Random(4)
    rows = [(i, [own.gauss(0, 1) for _ in range(4)]) for i in range(100)]
    longer = [(200, [1.0] * 5), (220, [0.5] * 5), (221, [0.25] * 5)]
    frame = spark.createDataFrame(rows + longer, SCHEMA)
    got = {tuple(r) for r in kdtree.top_k(frame, frame.where("vec_id % 20 = 0"), k=5, shard_rows=shard_rows).collect()}
    assert got == brute(rows, lambda i: i % 20 == 0, 5) | brute(longer, lambda i: i % 20 == 0, 5)


def test_boxes_are_tight_and_subtrees_are_skipped():
    points = np.random.default_rng(1).integers(-20, 20, (5000, 3))
    tree = kdtree.Tree(np.arange(5000), points, 20)
    for node, members in enumerate(tree.members):
        if members is not None:
            assert (tree.low[node] == tree.points[members].min(0)).all()
    visited = []
    tree.values = _Counted(tree.values, visited)
    tree.search(np.array([[5, -3, 9]]), np.array([-1]), np.array([kdtree.LOWEST]))
    assert sum(visited) < 2500


class _Counted:
    def __init__(self, values, visited):
        self.values, self.visited = values, visited

    def __getitem__(self, members):
        self.visited.append(len(members))
        return self.values[members]


def test_values_beyond_exact_doubles():
    points = np.array([[1 << 30, 1], [1 << 30, 2], [-5, 3]], np.int64)
    found = kdtree.Tree(np.arange(3), points, 2).search(np.array([[1 << 30, 1]]), np.array([9]), np.array([kdtree.LOWEST]))
    assert sorted(found[0]) == [((1 << 60) + 1, 0), ((1 << 60) + 2, 1)]
