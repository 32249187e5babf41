import hashlib
import random
import zlib

import pytest

from barloom.llm import merkle
from tests.llm.fixtures import DOCS, awkward_rows, docs, empty, prose


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(i, text, lang, source, n, more=0):
    n = n if n is None else n + more
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes, at):
    """Root of a list of nodes, with the siblings of one place as (left, right) texts."""
    way = []
    while len(nodes) > 1:
        run = nodes[at - at % 2:at - at % 2 + 2]
        way.append(("".join(run[:at % 2]), "".join(run[at % 2 + 1:])))
        nodes, at = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], way


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda row: (row[0] is None, row[0] or 0, leaf(*row)))
    roots = [climb([leaf(*row) for row in trees[lang]], 0)[0] for lang in order]
    out = []
    for place, lang in enumerate(order):
        leaves = [leaf(*row) for row in trees[lang]]
        for at, row in enumerate(trees[lang]):
            subroot, way = climb(leaves, at)
            root, above = climb(roots, place)
            struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(*row, more=1) if struck else leaf(*row)
            for left, right in way + above:
                folded = digest(left, folded, right)
            proof = digest(*(left + right for left, right in way + above))
            out.append((row[0], leaves[at], subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def result(frame, **more):
    return sorted((tuple(r) for r in merkle.manifest(frame, **more).collect()), key=str)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_equals_brute_force_with_nulls_copies_and_negative_ids(spark, bits):
    own = random.Random(bits)
    rows = awkward_rows() + [(i, prose(abs(i), 3), own.choice(["en", "de", "日本", "", None]), own.choice(["a", None]), own.choice([5, None, -3]))
                             for i in own.sample(range(-700, 70_000), 90)]
    rows += [(1 << 62, "far", "en", "a", 1), (-(1 << 62), "far", "en", "a", 1), ((1 << 63) - 1, "end", "en", "a", (1 << 63) - 1)]
    got = result(docs(spark, rows, clashing=True), bits=bits)
    assert got == brute(rows)
    assert {row[-1] for row in got} == {True, False}


def test_one_id_on_many_rows_and_many_equal_rows(spark):
    rows = [(7, f"text {i}", "en", "a", i) for i in range(150)] + [(9, "same", "en", "a", 4)] * 120 + [(None, f"none {i % 40}", "en", "a", 1) for i in range(90)]
    rows += [(i, "x", "en", "b", 1) for i in range(20)]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    assert result(frame, bits=3) == brute(rows)


def test_lone_leaf_lone_tree_and_empty_table(spark):
    rows = [(3, "only", None, None, None)]
    (one,) = result(docs(spark, rows))
    assert one[1] == one[2] == one[3] == one[5] and one[4] == digest() and one[6]
    assert result(empty(spark)) == [] and merkle.manifest(empty(spark)).columns == merkle.manifest(docs(spark, rows)).columns


def test_a_changed_document_is_found(spark):
    rows = [(i, prose(i, 5), "en", "a", 9) for i in range(40)]
    got = {r["doc_id"]: r for r in merkle.manifest(docs(spark, rows)).collect()}
    struck = {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert {i for i, r in got.items() if not r["verified"]} == struck and struck
