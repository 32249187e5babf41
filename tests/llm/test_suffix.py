import hashlib
import random

import numpy as np
import pytest

from barloom.llm import suffixdedup, suffixsort
from tests.llm.fixtures import awkward_rows, docs, empty, prose


def naive(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])[::-1]
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < cap and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared.append(n)
    return order, shared


@pytest.mark.parametrize("memory,names", [(64, 1), (1 << 20, 1 << 20), (64, 1 << 20)])
def test_induced_order_and_shared_prefixes(memory, names):
    """Small bounds force the spill file and the recursion."""
    own = random.Random(memory + names)
    for _ in range(250):
        symbols = own.choice([1, 2, 3, 30])
        text = [own.randrange(1, symbols + 1) for _ in range(own.randrange(50))] * own.choice([1, 1, 2, 3]) + [0]
        cap = own.choice([3, 100])
        parts = list(suffixsort.induced(np.array(text), cap, memory, names))
        got = np.concatenate(parts)
        order, shared = naive(text, cap)
        assert got["at"].tolist() == order and got["lcp"].tolist() == shared, text


def test_queue_spills_and_keeps_order():
    queue = suffixsort.DiskQueue(100)
    for k in range(50):
        queue.push(k % 3, suffixsort.entries_of(np.array([k]), np.array([0])))
    assert queue.spilled > 0
    for symbol in range(3):
        assert queue.next() == symbol
        assert queue.pop(symbol)["at"].tolist() == list(range(symbol, 50, 3))
    assert queue.next() is None
    queue.close()


def brute(rows, length=100):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    done = {}
    for k in order:
        ident, text = rows[k][0], (rows[k][1] or "").encode()
        if (ident, text) in done:
            out.append((k, done[ident, text]))
            continue
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            window = text[at:at + length]
            if window in seen:
                gone[at:at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        runs = sum(g and not b for g, b in zip(gone, b"\0" + gone))
        done[ident, text] = (ident, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        out.append((k, done[ident, text]))
    return sorted((row for _, row in out), key=str)


def test_equals_brute_force(spark):
    own = random.Random(6)
    parts = ["".join(own.choice("ab cdé") for _ in range(own.randrange(60, 260))) for _ in range(10)]
    rows = []
    for k in range(90):
        pieces = [own.choice(parts)[own.randrange(40):] if own.random() < 0.6 else
                  "".join(own.choice("ab cdé") for _ in range(own.randrange(80))) for _ in range(own.randrange(8))]
        rows.append((k * 7 % 97, "".join(pieces), "en", "a", 1))
    rows += [(200, "a" * 700, "en", "a", 1), (201, "ab" * 400, "en", "a", 1), (202, "x" * 99, "en", "a", 1),
             (203, "y" * 100, "en", "a", 1), (204, "y" * 100, "en", "a", 1), *awkward_rows()]
    got = suffixdedup.digests(docs(spark, rows, clashing=True)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_rows_are_kept_and_characters_stay_whole(spark):
    line = "é" * 80
    rows = [(1, line, "en", "a", 80), (2, "x" + line, "en", "a", 81), (3, line, "en", "a", 80), *awkward_rows()[2:5]]
    frame = docs(spark, rows, clashing=True)
    kept = suffixdedup.without_repeats(frame)
    assert kept.columns == frame.columns
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
    assert (2, "x", 1) in got and (1, "é" * 30, 30) not in got and not [r for r in got if r[0] == 3 and r[1] == line]
    assert (3, None, None) in got and (4, "", 0) in got


def test_empty_table(spark):
    assert suffixdedup.digests(empty(spark)).count() == 0
    assert suffixdedup.without_repeats(empty(spark)).count() == 0


def test_equal_windows_have_equal_anchors(monkeypatch):
    data = np.frombuffer(bytes(random.Random(2).choice(b"abcd ") for _ in range(3000)) * 2, np.uint8)
    starts, counts, hashes = suffixdedup.anchor_runs(data, np.arange(len(data)) + 100 <= len(data))
    assert counts.sum() == len(data) - 99
    anchor = np.repeat(hashes, counts)
    assert (anchor[:2901] == anchor[3000:]).all()
    texts = [bytes(data[:777]), b"", bytes(data[5:1500])]
    whole = [np.concatenate(x) for x in zip(*suffixdedup._document_runs(texts))]
    monkeypatch.setattr(suffixdedup, "PIECE", 128)
    parts = [np.concatenate(x) for x in zip(*suffixdedup._document_runs(texts))]
    assert whole[2].sum() == parts[2].sum()
    assert (np.repeat(whole[3], whole[2]) == np.repeat(parts[3], parts[2])).all()


def test_hot_anchors_are_split_by_window(spark, monkeypatch):
    """A passage in every document, with other surroundings each time, and stretches in which every window has one anchor."""
    monkeypatch.setattr(suffixdedup, "HOT_RUNS", 30)
    monkeypatch.setattr(suffixdedup, "COUNTED", 1)
    own = random.Random(12)
    passage = "".join(own.choice("abcdefgh ") for _ in range(160))
    noise = ["".join(own.choice("abcdefgh ") for _ in range(200)) for _ in range(120)]
    rows = [(k * 7 % 127, noise[k][:90] + passage + noise[k // 2][90:], "en", "a", 1) for k in range(120)]
    rows += [(300, "a" * 700, "en", "a", 1), (301, "ba" * 300, "en", "a", 1), (302, "x" + "a" * 300, "en", "a", 1),
             *awkward_rows()]
    frame = docs(spark, rows)
    assert sorted(map(tuple, suffixdedup.digests(frame).collect()), key=str) == brute(rows)
    keyed = suffixdedup._keyed(frame, "doc_id", "text", False)
    assert len(suffixdedup._hot_anchors(keyed)) >= 2
    shards = {}
    for row in suffixdedup._dealt(keyed, 4).collect():
        sizes = np.frombuffer(row["sizes"], np.uint8)
        shards[row["shard"]] = shards.get(row["shard"], 0) + int((sizes >= 100).sum())
    assert max(shards.values()) < 30  # all runs of the passage's edges met in one shard before


def test_no_group_holds_all_runs_of_an_anchor(spark, monkeypatch):
    """Every window of a stretch of one byte is a run of its own with the same anchor."""
    monkeypatch.setattr(suffixdedup, "HOT_RUNS", 50)
    rows = [(k, "a" * 2000, "en", "a", 1) for k in range(6)] + [(9, prose(4, 300), "en", "a", 1)]
    frame = docs(spark, rows)
    keyed = suffixdedup._keyed(frame, "doc_id", "text", False)
    hot = suffixdedup._hot_anchors(keyed)
    runs = [np.frombuffer(row["runs"], suffixdedup.RUN)["anchor"] for row in suffixdedup._packed_runs(keyed, 4, hot).collect()
            if row["runs"]]
    assert np.unique(np.concatenate(runs), return_counts=True)[1].max() < 50  # 11,406 without the split
    assert sorted(map(tuple, suffixdedup.digests(frame).collect()), key=str) == brute(rows)
