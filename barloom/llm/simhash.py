"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits have a value between them: one within one
bit of the first and within two of the second. Every fingerprint emits the variants around it, variants are
shuffled, and fingerprints that share one are linked after a check of their distance.

Which side takes the two bits is settled by parity. Fingerprints at an odd distance differ in parity, so the
even ones emit their 64 one-bit variants and the odd ones themselves and their two-bit variants. Of three differing
bits two lie in the same 32-bit half, so two-bit variants need only pairs inside a half (992 of 2016). Odd fingerprints
also emit one-bit variants, to find each other at distance two; even ones share one-bit variants anyway.

Variants travel packed: a row holds all variants that a batch of fingerprints sends to one bucket, four bytes each. The
number of buckets follows the number of distinct fingerprints, so a bucket fits in memory at every size. At one
variant, members within one bit of it are all linked to the smallest of them; this keeps every component and
never lists all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.common import bytes_of, map_batches, returning, utf8, whole_row
from barloom.llm.components import roots
from barloom.session import cut

SHINGLE = 3
RADIUS = 3
SEED = 42
CHUNK = 1 << 16  # shingles counted at once
BUCKET_VARIANTS = 1 << 21
HALF = 32
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(data: bytes) -> int:
    """Majority bits of the hashes of all shingles; no words give 0."""
    words = data.lower().split()  # on bytes: only A-Z change, and only space and 9-13 split
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + size + 1))
    starts = [0, *(end + 1 for end in ends[:-SHINGLE])]
    ends = ends[SHINGLE - 1:]
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, count, CHUNK):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])],
                          np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``<id_col>, fp`` (the fingerprint as a signed long); with ``keep`` the whole row as ``row`` too."""
    columns = {"_id": docs.schema[id_col].dataType}
    rows = [F.col(id_col).alias("_id"), utf8(text_col).alias("_text")]
    if keep:
        rows.append(whole_row(docs))
        columns["row"] = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            prints = np.array([fingerprint(data) for data in bytes_of(batch, "_text")], np.uint64)
            yield {**{name: batch.column(name) for name in columns}, "fp": pa.array(prints.view(np.int64))}

    schema = StructType([StructField(name, kind) for name, kind in columns.items()]).add("fp", LongType())
    out = map_batches(docs.select(*rows), work, schema)
    return out.withColumnRenamed("_id", id_col)


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """One-bit and in-half two-bit variants as 12-bit codes of two bit numbers (equal for one bit)."""
    one = np.arange(64, dtype=np.uint16)
    a, b = np.triu_indices(HALF, 1)
    two = np.concatenate([(a + half) << 6 | (b + half) for half in (0, HALF)]).astype(np.uint16)
    return one << 6 | one, two


def _masks(codes: np.ndarray) -> np.ndarray:
    first = np.uint64(1) << (codes >> 6).astype(np.uint64)
    second = np.uint64(1) << (codes & 63).astype(np.uint64)
    return np.where(codes == NONE, np.uint64(0), first | second)


NONE = np.uint16(0xFFFF)
ONE, TWO = _flips()
EVEN_CODES, ODD_CODES = ONE, np.concatenate([[NONE], ONE, TWO]).astype(np.uint16)


def _variants(distinct: DataFrame, buckets: int) -> DataFrame:
    """``bucket, prints, members``: fingerprints of a batch, and (place of the fingerprint, code) of its variants."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            odd = (np.bitwise_count(prints) & 1).astype(bool)
            places, codes = [], []
            for own, kinds in ((np.flatnonzero(~odd), EVEN_CODES), (np.flatnonzero(odd), ODD_CODES)):
                places.append(np.repeat(own, len(kinds)).astype(np.uint16))
                codes.append(np.tile(kinds, len(own)))
            place, code = np.concatenate(places), np.concatenate(codes)
            value = prints[place] ^ _masks(code)
            bucket = ((value * MIX) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            packed = np.stack([place[order], code[order]], axis=1)
            names, starts = np.unique(bucket[order], return_index=True)
            for name, a, b in zip(names, starts, [*starts[1:], len(order)]):
                used, again = np.unique(packed[a:b, 0], return_inverse=True)
                own = np.stack([again.astype(np.uint16), packed[a:b, 1]], axis=1)
                yield {"bucket": [int(name)], "prints": [prints[used].tobytes()], "members": [own.tobytes()]}

    return map_batches(distinct.select("fp"), work, "bucket int, prints binary, members binary")


def _linked(table: pa.Table) -> pa.Table:
    """Links of one bucket: members of a variant to the smallest one within one bit of it."""
    all_prints, all_codes = [], []
    for prints, members in zip(table.column("prints").to_pylist(), table.column("members").to_pylist()):
        pairs = np.frombuffer(members, np.uint16).reshape(-1, 2)
        all_prints.append(np.frombuffer(prints, np.uint64)[pairs[:, 0]])
        all_codes.append(pairs[:, 1])
    prints, codes = np.concatenate(all_prints), np.concatenate(all_codes)
    value = prints ^ _masks(codes)
    order = np.argsort(value)
    value, prints, codes = value[order], prints[order], codes[order]
    same = value[1:] == value[:-1]
    met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    value, prints, codes = value[met], prints[met], codes[met]
    if not len(value):
        return EMPTY
    begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    near = (codes == NONE) | (codes >> 6 == (codes & 63))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    lengths = np.diff([*begins, len(value)])
    hub = np.repeat(np.minimum.reduceat(np.where(near, prints, top), begins), lengths)
    has = np.repeat(np.logical_or.reduceat(near, begins), lengths)
    good = has & (hub != prints) & (np.bitwise_count(hub ^ prints) <= RADIUS)
    links = np.unique(np.stack([hub[good], prints[good]], axis=1), axis=0)
    return pa.table({"a": pa.array(links[:, 0].copy().view(np.int64)), "b": pa.array(links[:, 1].copy().view(np.int64))})


EMPTY = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def links(distinct: DataFrame, count: int) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints at most ``RADIUS`` bits apart, enough for all components."""
    least = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_print = (len(EVEN_CODES) + len(ODD_CODES)) / 2
    buckets = max(least, int(count * per_print / BUCKET_VARIANTS) + 1)
    return (
        _variants(distinct, buckets).repartition(buckets, "bucket").groupBy("bucket")
        .applyInArrow(returning(_linked), "a long, b long").distinct()
    )


def groups(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, fp, component_id`` for every row of ``<id_col>, fp``."""
    own = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    distinct = cut(own)
    found = roots(links(distinct, distinct.count()))
    members = distinct.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first")
    root_rows = distinct.join(found.select(F.col("root").alias("fp")).distinct(), "fp").select(
        "fp", F.col("fp").alias("root"), "first")
    linked = cut(members.union(root_rows))
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    known = linked.join(smallest, "root").select("fp", "smallest")
    classes = distinct.join(known, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fingerprint, component_id`` for every row.

    Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other; equal texts are
    one class; null ids do not count for ``component_id``, which is null where a class has no other; an empty table gives
    an empty result; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    return groups(prints, id_col).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each class: that of the smallest id.

    A class whose ids are all null keeps its row without an id and with the smallest fingerprint.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    kept = (
        groups(prints, id_col).where(F.col(id_col).eqNullSafe(F.col("component_id")))
        .groupBy(F.col("component_id").alias("_kept_id"), F.col(id_col).isNull().alias("_none"),
                 F.when(F.col(id_col).isNull(), F.col("fp")).alias("_none_fp")).agg(F.min("fp").alias("_kept_fp"))
        .select("_kept_id", "_kept_fp")
    )
    rows = fingerprints(docs, id_col, text_col, keep=True)
    return (
        rows.join(kept, rows[id_col].eqNullSafe(kept["_kept_id"]) & (rows["fp"] == kept["_kept_fp"]), "left_semi")
        .dropDuplicates([id_col, "fp"]).select("row.*")
    )
