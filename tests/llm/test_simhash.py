import random
import re

import numpy as np
import xxhash

from barloom.llm import components, simhash
from tests.llm.fixtures import awkward_rows, docs, empty, prose


def slow_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    group = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_components_of_random_balls(spark):
    own, prints = random.Random(3), [0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63]
    for _ in range(30):
        value = own.getrandbits(64)
        for _ in range(own.randrange(1, 9)):
            for bit in own.sample(range(64), own.randrange(5)):
                value ^= 1 << bit
            prints.append(value)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    got = simhash.groups(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()
    want = slow_groups(prints)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got) and len(got) == len(prints)


def test_fingerprints_of_awkward_texts(monkeypatch):
    for row in awkward_rows():
        assert simhash.fingerprint((row[1] or "").encode()) == slow_print(row[1])
    text = prose(4, 700)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 13)
    assert simhash.fingerprint(text.encode()) == whole == slow_print(text)


def test_rows_and_deduplication(spark):
    rows = awkward_rows()
    got = simhash.near_duplicates(docs(spark, clashing=True)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got}
    assert by_id[3] == by_id[4] == by_id[5] == ("0" * 16, 3) and by_id[1][1] == by_id[2][1] == 1
    kept = simhash.deduplicated(docs(spark, clashing=True))
    assert kept.columns == docs(spark, clashing=True).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({c for _, c in by_id.values()}, key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0
