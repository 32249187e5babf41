import os
import random
import time

import numpy as np
import pytest

from barloom import session
from barloom.llm import similar
from barloom.llm.components import roots
from tests.llm.fixtures import docs, empty, prose


def copy(text, share, own):
    """The text with a share of its words replaced."""
    words = text.split()
    for at in own.sample(range(len(words)), int(share * len(words))):
        words[at] = f"w{own.randrange(10**6)}"
    return " ".join(words)


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(rows):
    """Smallest id reachable over all pairs at 0.8, by brute force."""
    own = {i: sets(t) for i, t, *_ in rows}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in own:
        for b in own:
            if a < b and jaccard(own[a], own[b]) >= similar.SIMILAR:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in own}


def test_groups_equal_brute_force(spark):
    own, rows = random.Random(4), []
    for k in range(12):
        text = prose(500 + k, 300)
        rows += [(20 * k + j, copy(text, share, own), "en", "s", 1)
                 for j, share in enumerate([0, 0.004, 0.01, 0.015, 0.02, 0.03, 0.06, 0.1, 0.3])]
    rows += [(900, None, "en", "s", 0), (901, " \n", "en", "s", 0), (902, "one two", "en", "s", 0), (903, "One  two", "en", "s", 0)]
    got = {r["_id"]: r["component_id"] for r in similar.groups(docs(spark, rows)).collect()}
    assert got == components(rows)


def test_crowded_band_of_near_copies_and_of_unlike_texts(spark):
    own = random.Random(5)
    base, frame = prose(1, 400), prose(2, 200)
    rows = [(i, copy(base, 0.005, own), "en", "s", 1) for i in range(150)]
    rows += [(1000 + i, frame + " " + prose(3000 + i, 150), "en", "s", 1) for i in range(100)]  # one passage, else different
    kept = {r["doc_id"] for r in similar.deduplicated(docs(spark, rows)).collect()}
    assert kept == {0, *range(1000, 1100)}


@pytest.mark.parametrize("tile", [similar.TILE, 2000])
def test_links_of_a_crowded_band_whose_ends_are_never_hubs(spark, monkeypatch, tile):
    """One band holds unlike texts, pairs of copies and a large group; with the small tile that has tiles of its own."""
    monkeypatch.setattr(similar, "TILE", tile)
    own, group = random.Random(6), prose(77, 300)
    rows = [(i, prose(4000 + i, 150), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, copy(prose(4000 + i, 150), 0.01, own), "en", "s", 1) for i in range(12)]
    rows += [(200 + i, copy(group, 0.005, own), "en", "s", 1) for i in range(20)]
    rows += [(300, copy(group, 0.02, own), "en", "s", 1), (301, "one two", "en", "s", 1), (302, None, "en", "s", 0)]
    frame = docs(spark, rows)
    nodes = similar.nodes(frame).withColumn("keys", similar.F.array(similar.F.lit(1)))
    first = {r["node"]: r["_id"] for r in nodes.orderBy(similar.F.desc("_id")).collect()}
    root = {r["node"]: r["root"] for r in similar.components(similar.cut(nodes), frame).collect()}
    got = {}
    for node, i in first.items():
        got.setdefault(root.get(node, node), set()).add(i)
    want = {}
    for i, low in components(rows).items():
        want.setdefault(low, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_awkward_rows_and_columns(spark):
    frame = docs(spark, clashing=True).withColumn("a.b", similar.F.lit(1)).withColumn("my col", similar.F.lit(2))
    got = similar.deduplicated(frame)
    assert got.columns == frame.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert ids == sorted([1, 3, 6, 7, 8, 8, 9, 10, None], key=str) or ids == sorted([1, 3, 6, 7, 8, 8, 9, None], key=str)
    assert similar.deduplicated(empty(spark)).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rows = [(1, prose(7, 80), "en", "s", 1), (5, prose(7, 80), "en", "s", 1), (5, prose(8, 80), "en", "s", 1),
            (None, prose(7, 80), "en", "s", 1), (None, prose(9, 80), "en", "s", 1)]
    got = {(r["doc_id"], r["text"]) for r in similar.deduplicated(docs(spark, rows)).collect()}
    assert got == {(1, prose(7, 80)), (5, prose(8, 80)), (None, prose(9, 80))}


def test_bands_meet_as_often_as_their_formula_says():
    own, met, trials = np.random.default_rng(1), 0, 400
    for _ in range(trials):
        pool = own.integers(0, 1 << 63, 450, np.uint64)
        a, b = np.unique(pool[:425]), np.unique(np.concatenate([pool[:378], pool[425:]]))
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert 0.8 <= share < 0.87
        met += bool(np.isin(similar.bands(a), similar.bands(b)).any())
    assert met >= 0.98 * trials


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {file for file in files.split("\n") if "/shuffle_" in file}


def test_shuffles_and_tables_of_finished_rounds_leave_the_disk(spark):
    own = random.Random(8)
    frame = docs(spark, [(i, copy(prose(600 + i % 9, 200), 0.01, own), "en", "s", 1) for i in range(40)])
    was, made = shuffle_files(spark), len(session._MADE)
    rows = similar.cut(similar.nodes(frame))
    root = similar.components(rows, frame)
    deadline = time.time() + 20  # files are deleted in the background
    while shuffle_files(spark) - was and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - was
    left = [path for path in session._MADE[made:] if os.path.exists(path)]
    assert len(session._MADE) - made > 2 * len(left)
    assert root.count() == 40 - 9 and rows.count() == 40  # what is still read is there


def test_roots_of_chains_loops_and_stars(spark):
    edges = [(5, 6), (6, 7), (8, 7), (9, 8), (1, 1), (30, 20), (20, 30), (30, 31), (40, 50), (41, 50), (42, 41), (50, 42), (-3, 60)]
    got = roots(spark.createDataFrame(edges, "a long, b long"))
    want = {**dict.fromkeys((6, 7, 8, 9), 5), 30: 20, 31: 20, **dict.fromkeys((41, 42, 50), 40), 60: -3}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0
    long = [(k, k + 1) for k in range(200)]
    assert {tuple(r) for r in roots(spark.createDataFrame(long, "a long, b long")).collect()} == {(k + 1, 0) for k in range(200)}
