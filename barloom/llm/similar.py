"""Verified links between texts that share most of their five-word shingles, beside the fingerprints of ``simhash``.

Copies with a Jaccard similarity of 0.8 lie up to about eleven bits apart, beyond what a ball of variants can reach. Here a
text becomes the set of hashes of its shingles (lower-cased words, five at a time; fewer words: the whole sequence), and 16
bands of five minimum hashes: two texts at 0.8 share a band with a chance of 0.998. Texts with equal sets are one node.

Pairs within a band are not listed at first. In each round one node of a band is its hub: the others that are not yet in its
component, and whose size allows 0.8, are compared with it on the whole sets. Then the hub leaves the band, as all its links there
are known, and a band whose members are one component is done. The first hub is the smallest node, so that a large group of
copies meets one hub over all its bands; later hubs differ from band to band. Hubs come from an aggregate with partial sums,
and nodes meet them by joins that Spark can split, so a band that a third of all texts share needs no task of its own.

After ``ROUNDS`` rounds every band that still holds two components is finished exactly, by one more pass: its nodes are
dealt to tiles of about ``TILE`` shingles, and each two tiles meet in a group that compares all their nodes, unless both lie in one
component or their sizes cannot reach 0.8. So every link between texts that share a band is found, however crowded it is; the
price is quadratic in the nodes of a band that no hub has joined, at one copy of a tile's texts for every tile it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import bytes_of, map_batches, quoted, returning, utf8
from barloom.llm.components import roots
from barloom.session import cut, discard

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 5
ROUNDS = 3
TILE = 1 << 18  # shingles of the nodes that are compared with each other at once; a longer text is a tile of its own
CHUNK = 1 << 13  # shingles whose minimum hashes are taken at once
_own = np.random.default_rng(20240607)
FACTORS = _own.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _own.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; no words give none."""
    words = data.lower().split()  # on bytes: only A-Z change, and only space and 9-13 split
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(text)], np.uint64)
    ends = list(accumulate(map(len, words), lambda end, size: end + size + 1))
    starts = [0, *(end + 1 for end in ends[:-WORDS])]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(text[a:b]) for a, b in zip(starts, ends[WORDS - 1:])], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set of shingles; the number of the band is part of the key."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), CHUNK):
        mixed = own[at:at + CHUNK, None] * FACTORS + SHIFTS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), number)
                     for number, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _tie(text_col: str) -> Column:
    return F.xxhash64(utf8(text_col))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _tie, node, n, keys``: hash of the text, 64 bits of the set, its size and its bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            sets = [shingles(data) for data in bytes_of(batch, "_text")]
            yield {
                "_id": batch.column(0), "_tie": batch.column(1),
                "node": pa.array(np.array([xxhash.xxh3_64_intdigest(own.tobytes()) for own in sets], np.uint64).view(np.int64)),
                "n": [len(own) for own in sets], "keys": [bands(own) for own in sets],
            }

    rows = docs.select(F.col(id_col).alias("_id"), _tie(text_col).alias("_tie"), utf8(text_col).alias("_text"))
    return map_batches(rows, work, f"_id {kind}, _tie long, node long, n long, keys array<long>")


def _texts(wanted: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, _text`` for the distinct nodes of ``wanted``, one text a node."""
    refs = cut(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_id", "_tie")).alias("ref")))
    own = docs.select(F.col(id_col).alias("_id"), _tie(text_col).alias("_tie"), utf8(text_col).alias("_text"))
    texts = cut(
        own.join(refs.select("node", F.col("ref._id").alias("_own"), F.col("ref._tie").alias("_same")),
                 F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_tie") == F.col("_same")))
        .select("node", "_text").dropDuplicates(["node"])
    )
    discard(refs)
    return texts


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar enough, compared whole. Only the texts of pairs are fetched, one a node."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), rows, docs, id_col, text_col)
    one = texts.select(F.col("node").alias("a"), F.col("_text").alias("_a"))
    two = texts.select(F.col("node").alias("b"), F.col("_text").alias("_b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            good = []
            sides = [list(zip(batch.column(key).to_pylist(), bytes_of(batch, "_" + key))) for key in "ab"]
            sets = {node: shingles(text) for node, text in {node: text for side in sides for node, text in side}.items()}
            for (first, _), (second, _) in zip(*sides):
                left, right = sets[first], sets[second]
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(both >= SIMILAR * (len(left) + len(right) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield {"a": kept.column("a"), "b": kept.column("b")}

    good = cut(map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b"), work, "a long, b long"))
    discard(texts)
    return good


def _links(group: pa.Table) -> pa.Table:
    """Links ``a, b`` that join the components of a group's nodes: all pairs within its tile, or between its two tiles."""
    nodes_, roots_, sides = (group.column(name).to_pylist() for name in ("node", "root", "side"))
    sets = [shingles(text) for text in group.column("_text").to_pylist()]
    sizes = np.array([len(own) for own in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros(int(ends[-1]) + 1, bool)
    parent = {root: root for root in roots_}

    def find(root: int) -> int:
        while parent[root] != root:
            parent[root] = root = parent[parent[root]]
        return root

    two, where, found = len(set(sides)) > 1, np.array(sides), []
    for at, size in enumerate(sizes.tolist()):
        if two and sides[at]:
            continue
        own = terms[ends[at]:ends[at + 1]]
        held[own] = True
        both = np.diff(np.concatenate([[0], np.cumsum(held[terms])])[ends])
        held[own] = False
        good = both >= SIMILAR * (sizes + size - both)
        good &= where != sides[at] if two else np.arange(len(sizes)) > at
        for other in np.flatnonzero(good).tolist():
            left, right = find(roots_[at]), find(roots_[other])
            if left != right:
                parent[right] = left
                found.append((nodes_[at], nodes_[other]))
    return pa.table({"a": pa.array([min(pair) for pair in found], pa.int64()), "b": pa.array([max(pair) for pair in found], pa.int64())})


def _rest(active: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links ``a, b`` between the components within each band of ``key, node, n, root``: all its nodes are compared, by tiles.

    A component that is larger than a tile has tiles of its own, which need not meet each other.
    """
    size = F.sum(F.col("n") + 1)
    clans = active.groupBy("key", "root").agg(size.alias("clan"))
    loose = F.coalesce(F.sum(F.when(F.col("clan") <= TILE, F.col("clan"))), F.lit(0))
    open_ = clans.groupBy("key").agg(loose.alias("loose"), F.count("*").alias("roots")).where("roots > 1")
    alone = F.col("clan") > TILE
    part = F.when(alone, F.pmod(F.xxhash64("node"), F.ceil(F.col("clan") / TILE))).otherwise(
        F.pmod(F.xxhash64("node", "key"), F.greatest(F.ceil(F.col("loose") / TILE), F.lit(1))))
    members = cut(
        active.join(clans, ["key", "root"]).join(open_, "key").withColumn("single", F.when(alone, F.col("root")))
        .select("key", "node", "n", "root", "single", F.xxhash64("key", "single", part).alias("tile"))
    )
    tiles = members.groupBy("key", "tile").agg(F.first("single").alias("single"), F.min("n").alias("low"), F.max("n").alias("high"))
    others = tiles.select("key", *[F.col(name).alias("_" + name) for name in ("tile", "single", "low", "high")])
    meet = tiles.join(others, "key").where(
        (F.col("tile") <= F.col("_tile")) & ~F.coalesce(F.col("single") == F.col("_single"), F.lit(False))
        & (F.col("high") >= SIMILAR * F.col("_low")) & (F.col("_high") >= SIMILAR * F.col("low")))
    meet = cut(meet.select(F.col("tile").alias("one"), F.col("_tile").alias("two")))
    sides = meet.select("one", "two", F.col("one").alias("tile"), F.lit(0).alias("side")).union(
        meet.where("one <> two").select("one", "two", F.col("two").alias("tile"), F.lit(1).alias("side")))
    texts = _texts(members.select("node").distinct(), rows, docs, id_col, text_col)
    dealt = members.select("tile", "node", "root").join(sides, "tile").join(texts, "node")
    links = cut(dealt.select("one", "two", "side", "node", "root", "_text").groupBy("one", "two").applyInArrow(
        returning(_links), "a long, b long").distinct())
    discard(members, meet, texts)
    return links


def components(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, root`` over the links between the nodes of ``rows``; roots do not appear as nodes."""
    active = rows.select("node", "n", F.explode("keys").alias("key")).withColumn("root", F.col("node"))
    found = labels = met = None
    for turn in range(ROUNDS):
        order = F.xxhash64("node", "key", F.lit(turn)) if turn else F.col("node")
        hubs = active.groupBy("key").agg(
            F.min(F.struct(order.alias("order"), "node", "n", "root")).alias("hub"),
            F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "hub")
        before, met = met, cut(active.join(hubs, "key").where("node <> hub.node").select(
            "key", "node", "n", F.when(F.col("root") != F.col("hub.root"), F.col("hub.node")).alias("to"),
            F.col("hub.n").alias("size")))
        if before is not None:
            discard(before)
        fits = F.col("to").isNotNull() & (F.least("n", "size") >= SIMILAR * F.greatest("n", "size"))
        pairs = cut(met.where(fits).select(F.least("to", "node").alias("a"), F.greatest("to", "node").alias("b")).distinct())
        good = _verified(pairs, rows, docs, id_col, text_col)
        discard(pairs)
        if found is None or not good.isEmpty():
            found = good if found is None else found.union(good)
            labels = roots(found)
        if met.isEmpty():
            return labels
        active = met.select("node", "n", "key").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    last = cut(active.distinct())
    rest = _rest(last, rows, docs, id_col, text_col)
    discard(last, met)
    return labels if rest.isEmpty() else roots(found.union(rest))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _tie, node, component_id`` for every row: the smallest id that is reachable over links and equal sets.

    Defined cases: null, empty and blank texts are one node; null ids do not count for ``component_id``, which is null where
    a class has no other; an empty table gives an empty result; repeated rows stay; other columns are ignored.
    """
    rows = cut(nodes(docs, id_col, text_col))
    firsts = rows.groupBy("node").agg(F.min("_id").alias("first"))
    known = firsts.join(components(rows, docs, id_col, text_col), "node", "left").select(
        "node", "first", F.coalesce("root", "node").alias("root"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = known.join(smallest, "root").select("node", "component_id")
    return rows.select("_id", "_tie", "node").join(classes, "node")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose class has no smaller id; a class whose ids are all null stays.

    Rows that share their id and text stay or go together, and of rows with one id but different texts each is judged by its
    own text. A table of unlike documents comes back whole.
    """
    gone = groups(docs, id_col, text_col).where("component_id IS NOT NULL AND NOT (_id <=> component_id)")
    gone = gone.select("_id", "_tie").distinct()
    return docs.join(gone, docs[quoted(id_col)].eqNullSafe(gone["_id"]) & (_tie(text_col) == gone["_tie"]), "left_anti")
