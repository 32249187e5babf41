import numpy as np
import pytest

from barloom.llm import stableprojection as ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None
              and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in usable:
        if asked(i):
            own = []
            for j, v in usable:
                if j != i and len(v) == len(q):
                    a, b = np.array(q, np.float32).astype(float), np.array(v, np.float32).astype(float)
                    own.append((-float(a @ b / np.sqrt((a @ a) * (b @ b))), j))
            out[i] = sorted(own)[:k]
    return out


def clustered(n=1500, size=24, seed=3):
    own = np.random.default_rng(seed)
    centres = own.normal(size=(30, size))
    return [(i, (centres[i % 30] + own.normal(scale=0.3, size=size)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard_rows", [100_000, 200])
def test_recall_against_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)  # also makes cells
    rows = clustered()
    rows += [(5000 + i, rows[1][1]) for i in range(60)]  # one very common vector
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 50 = 0"), shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want) and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    truth = {i: dict((j, -s) for s, j in own) for i, own in want.items()}
    hits = [len({x[1] for x in v} & set(truth[i])) for i, v in got.items()]
    assert sum(hits) >= 0.95 * 5 * len(want)
    for i, own in got.items():
        own.sort()
        assert [x[2] for x in own] == sorted((x[2] for x in own), reverse=True)
        assert all(abs(score - truth[i][j]) < 1e-12 for _, j, score in own if j in truth[i])


def test_copies_bad_vectors_and_lengths(spark):
    rows = clustered(300) + [(50 * 7 + 1000, clustered(3)[2][1])] + [(3000 + i, clustered(3)[2][1]) for i in range(40)]
    rows += [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [float("inf")] + [0.0] * 23), (None, [1.0] * 24)]
    rows += [(9050, [1.0, 2.0]), (9006, [2.0, 4.1]), (9100, [1.0] * 5), (9007, []), rows[4]]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {i: [j for _, j in own] for i, own in brute(rows, lambda i: i % 50 == 0, 5).items() if own}
    assert got[1350] == want[1350] == [2, 3000, 3001, 3002, 3003]  # ties go to the smaller id
    assert got[9050] == [9006] and 9100 not in got and set(got) == set(want)


def test_fewer_rows_empty_tables_and_names(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e-30, 1e-30]), (2, [-3e30, 0.0])], SCHEMA)
    got = [(r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(few, few.where("vec_id = 0")).collect()]
    assert sorted(got) == [(1, 1, round(0.5 ** 0.5, 9)), (2, 2, -1.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, none).count() == 0 and ann.nearest(few, none).count() == 0 and ann.nearest(none, few).count() == 0
    clash = few.selectExpr("*", "1L AS id", "2L AS vector", "'x' AS shard", "0 AS score")
    assert ann.nearest(clash, clash).columns == ["query_id", "rank", "vec_id", "score"]


def test_the_stopping_test_saves_work_and_its_law_holds():
    own = np.random.default_rng(0)
    x = own.chisquare(ann.DIMS, 40_000)
    for at in (4.0, 12.0, 20.0):
        assert abs(float(ann.chi_square(at)) - (x < at).mean()) < 0.01
    a, b = own.normal(size=(2, 4000, 64))
    ratio = ((ann.projected(a) - ann.projected(b)) ** 2).sum(1) / ((ann._unit(a) - ann._unit(b)) ** 2).sum(1)
    assert abs(ratio.mean() - ann.DIMS) < 1.0
    vectors = np.array([v for _, v in clustered(6000)])
    tree = ann.Tree(vectors, [[i] for i in range(6000)], 5)
    tree.search(vectors[7], 7, ann.FAR)
    assert tree.verified < 1500
