import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import sourceaudit
from tests.llm.fixtures import awkward_rows, docs, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs, top=50):
    out = []
    for lang in {r[2] or "" for r in rows}:
        mine = [r for r in rows if (r[2] or "") == lang]
        seen = Counter(t for r in mine for t in set(terms(r[1])))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        def share(group):
            n = Counter(t for r in group for t in terms(r[1]) if t in seen and seen[t] >= min_docs)
            total = sum(n.values()) + 5 * len(kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // total for t in kept}
        q = share(mine)[1]
        own = {s: share([r for r in mine if (r[3] or "") == s]) for s in {r[3] or "" for r in mine}}
        for source, (n, p) in own.items():
            pairs = [(-sum(abs(p[t] - o[t]) for t in kept), s.encode(), s) for s, (_, o) in own.items() if s != source]
            words = [(q[t] - p[t], t.encode(), t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def result(frame, **more):
    return sorted(tuple(r) for r in sourceaudit.audit(frame, **more).collect())


def corpus(n=160):
    own = random.Random(4)
    words = ["a", "It", "the", "word", "naïve", "ÀÉ", "日本語", "eightlet", "ninelette", "sixteen-letters", "abcdefghijklmnop",
             "abcdefghijklmnopq", "é" * 30, "x" * 200, "x" * 201, "don't", "x1y", "🎉"]
    return [(i, own.choice([" ", ", ", "\x00", "\t"]).join(own.choices(words, k=own.randrange(0, 40))),
             own.choice(["en", "de", None]), own.choice(["a", "b", "c é", "", None]), 1) for i in range(n)]


@pytest.mark.parametrize("min_docs", [1, 30])
def test_equals_brute_force(spark, min_docs):
    rows = corpus() + awkward_rows()
    assert result(docs(spark, rows, clashing=True).repartition(3), min_docs=min_docs) == brute(rows, min_docs)


def test_blocks_of_sources_and_buckets_of_terms(spark, monkeypatch):
    rows = [(i, t, lang, f"s{i % 7}", n) for i, t, lang, _, n in corpus()]
    monkeypatch.setattr(sourceaudit, "BUCKET_TERMS", 5)
    monkeypatch.setattr(sourceaudit, "TOP", 3)
    # BLOCK is read by the workers too, so it stays; blocks are tested on the function itself below.
    assert result(docs(spark, rows), min_docs=2, top=3) == brute(rows, 2, 3)


def test_many_sources_meet_in_blocks(spark):
    rows = [(i, f"common w{i % 50} {'rare ' * (i % 3)}", "en", f"s{i % 140:03d}", 1) for i in range(280)]
    assert result(docs(spark, rows), min_docs=2) == brute(rows, 2)


def test_no_kept_term_and_empty_table(spark):
    rows = [(1, "one", "en", "a", 1), (2, "two", "en", "b", 1), (3, None, "de", None, 1)]
    assert result(docs(spark, rows)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert result(empty(spark)) == []


def test_very_long_texts_are_counted_in_parts(spark, monkeypatch):
    text = ("alpha beta " * 60 + "z" * 300 + " Gamma ").encode() * 5
    monkeypatch.setattr(sourceaudit, "PIECE", 100)
    found, n = sourceaudit._long_counts(text)
    assert dict(zip((t.decode() for t in found.to_pylist()), n)) == Counter(terms(text.decode()))
    assert b"".join(sourceaudit._long_text(text)) == text


def test_radix_order_is_stable_and_sorted():
    own = np.random.default_rng(1)
    words = own.integers(0, 1 << 63, 5000, dtype=np.uint64) % np.uint64(300) * np.uint64(1 << 40)
    order = sourceaudit._radix_order([words], 4)
    assert (order == np.argsort(words, kind="stable")).all()
