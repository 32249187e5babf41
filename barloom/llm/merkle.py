"""Merkle manifest of a dataset: digests, proofs and their check for every document.

Where a leaf stands among the documents of its language is found without sorting them. Ids of a language are kept as a
bitmap in blocks of 512 bits, eight words each; only blocks that hold an id exist. Spark merges the words of all tasks by
``bit_or``, counts their ones, and prefix sums over blocks (`FAN` blocks at a time, then sums of those) give the directory. A
document's place is the directory's count before its block plus the ones before its bit.

Nodes then travel with their place as key: `SLOTS` consecutive nodes meet in one group, fill an array by place and become
one node, so a round leaves one node in `SLOTS`. The rounds are walked back with the way from a block up to the
root, and a group adds the siblings inside it. A group never holds more than `SLOTS` nodes and one such way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import returning
from barloom.session import cut

BITS = 12  # SLOTS = 1 << BITS nodes in a group
FAN = 18  # a directory window holds at most 1 << FAN blocks
TAMPER = 7
WORDS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(value) for value in values]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, none, id, seq, leaf, altered`` of every row; ``altered`` is the tampered leaf, null where it is the same.

    ``tree`` names the language so that a null comes first; ``seq`` tells equal rows apart once it is stored.
    """
    values = {name: F.col(name) for name in FIELDS}
    more = values | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    struck = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    return docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
        F.monotonically_increasing_id().alias("seq"), _digest(list(values.values())).alias("leaf"),
        F.when(struck & F.col("n_chars").isNotNull(), _digest(list(more.values()))).alias("altered"))


BLOCK = "shiftright(id, 9)"
_BLOCK_KEY = ["tree", "none", "block"]


def directory(nodes: DataFrame) -> DataFrame:
    """``tree, none, block, w0..w7, n, ones, before, size``: the bitmap of every block, its rows and ones, the rows of the
    tree before it and in all."""
    bit = "shiftleft(1L, CAST(id & 63 AS INT))"
    blocks = (
        nodes.withColumn("block", F.expr(BLOCK)).groupBy(*_BLOCK_KEY)
        .agg(F.count("*").alias("n"), *[
            F.coalesce(F.expr(f"bit_or(CASE WHEN (id & 511) >> 6 = {k} THEN {bit} END)"), F.lit(0).cast("long")).alias(f"w{k}")
            for k in range(WORDS)])
        .withColumn("ones", sum((F.bit_count(f"w{k}") for k in range(WORDS)), F.lit(0)))
        .withColumn("range", F.expr(f"shiftright(block, {FAN})")).withColumn("top", F.expr(f"shiftright(block, {2 * FAN})"))
    )

    def before(keys: list[str], order: list[str], value: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(window), F.lit(0).cast("long"))

    inner, middle = ["tree", "none", "range"], ["tree", "none", "top"]
    blocks = cut(blocks)
    ranges = blocks.groupBy(*middle, "range").agg(F.sum("n").alias("range_n"))
    tops = (
        ranges.groupBy(*middle).agg(F.sum("range_n").alias("top_n"))
        .withColumn("top_before", before(["tree"], ["none", "top"], "top_n"))
        .withColumn("size", F.sum("top_n").over(Window.partitionBy("tree")))
    )
    ranges = ranges.withColumn("range_before", before(middle, ["range"], "range_n")).join(tops, middle)
    return (
        blocks.withColumn("own", before(inner, ["block"], "n"))
        .join(ranges.select(*inner, (F.col("top_before") + F.col("range_before")).alias("start"), "size"), inner)
        .select(*_BLOCK_KEY, *[f"w{k}" for k in range(WORDS)], "n", "ones", (F.col("start") + F.col("own")).alias("before"), "size")
    )


def _rank() -> Column:
    """Ones of the block before the bit of ``id``."""
    word, below = "CAST((id & 511) >> 6 AS INT)", "~shiftleft(-1L, CAST(id & 63 AS INT))"
    return F.expr(" + ".join(f"(CASE WHEN {word} > {k} THEN bit_count(w{k}) WHEN {word} = {k} THEN bit_count(w{k} & ({below})) "
                             f"ELSE 0 END)" for k in range(WORDS)))


def _crowded(rows: DataFrame) -> DataFrame:
    """Places in blocks in which ids repeat: rows of one id go by digest, equal digests in any fixed order.

    Copies of one id may be a large share of all rows, so their order is put together from counts: by the leading digits of
    the digest, then by digest and writing task, then inside one task's equal rows.
    """
    def before(frame: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(name, F.coalesce(F.sum("m").over(window), F.lit(0).cast("long"))).drop("m")

    own = ["tree", "none", "id"]
    rows = cut(rows.withColumn("lead", F.substring(F.hex("leaf"), 1, 3)).withColumn("task", F.expr("shiftright(seq, 33)")))
    counted = cut(rows.groupBy(*_BLOCK_KEY, "before", "id", "lead", "leaf", "task").agg(F.count("*").alias("m")))
    ids = before(counted.groupBy(*_BLOCK_KEY, "before", "id").agg(F.sum("m").alias("m")), _BLOCK_KEY, ["id"], "ids_before")
    leads = before(counted.groupBy(*own, "lead").agg(F.sum("m").alias("m")), own, ["lead"], "leads_before")
    equal = before(counted, [*own, "lead"], ["leaf", "task"], "equal_before")
    inside = Window.partitionBy(*own, "leaf", "task").orderBy("seq")
    starts = (
        equal.join(ids.select(*own, "ids_before"), own).join(leads, [*own, "lead"])
        .select(*own, "leaf", "task", (F.col("before") + F.col("ids_before") + F.col("leads_before") + F.col("equal_before")).alias("start"))
    )
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1).join(starts, [*own, "leaf", "task"])
        .withColumn("pos", F.col("start") + F.col("inside"))
    )


_PLACED = ["doc_id", "tree", "size", "pos", "leaf", "altered"]


def placed(nodes: DataFrame) -> DataFrame:
    """``doc_id, tree, size, pos, leaf, altered``: every leaf with its place among the ``size`` leaves of its tree."""
    index = cut(directory(nodes))
    rows = nodes.withColumn("block", F.expr(BLOCK))
    out = (
        rows.join(index.where("n = ones"), _BLOCK_KEY)
        .withColumn("pos", F.col("before") + _rank()).select(*_PLACED)
    )
    if index.where("n > ones").limit(1).count():
        crowded = index.where("n > ones").select(*_BLOCK_KEY, "before", "size")
        out = out.unionByName(_crowded(rows.join(crowded, _BLOCK_KEY)).select(*_PLACED))
    return out


def _depth(size: int, above: int, bits: int) -> int:
    """Levels that a round does, of those of a tree with ``size`` leaves."""
    return max(0, min(bits, (size - 1).bit_length() - above * bits))


def _slots(table: pa.Table, bits: int) -> list[str]:
    """Digests as text in an array by place."""
    at = [place & ((1 << bits) - 1) for place in table.column("pos").to_pylist()]
    slots = [""] * len(at)
    for place, digest in zip(at, table.column("digest").to_pylist()):
        slots[place] = digest.hex()
    return slots


def _levels(slots: list[str], depth: int) -> list[list[str]]:
    """The array and what its levels become, the last one being a single node."""
    levels = [slots]
    for _ in range(depth):
        below = levels[-1]
        levels.append([_hash("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def _siblings(levels: list[list[str]], place: int) -> str:
    """The way up from a place: for every level the side of the sibling (``<``, ``>``, ``-`` for none) and its digest."""
    way = []
    for level in levels[:-1]:
        other = place ^ 1
        way.append(("<" if place & 1 else ">") + level[other] if other < len(level) else "-" * 65)
        place >>= 1
    return "".join(way)


def _steps(way: str) -> list[tuple[str, str]]:
    return [(way[i], way[i + 1:i + 65] if way[i] != "-" else "") for i in range(0, len(way), 65)]


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for side, other in steps:
        digest = _hash(other + digest if side == "<" else digest + other)
    return digest


def _rounds(size: int, bits: int) -> int:
    return max(1, -(-(size - 1).bit_length() // bits))


def _up(nodes: DataFrame, size: int, bits: int) -> list[DataFrame]:
    """The nodes of all rounds, the last with one node for every tree."""
    tables = [nodes]
    for above in range(_rounds(size, bits)):
        def reduce(table: pa.Table, above: int = above) -> pa.Table:
            own, size_ = table.column("tree")[0].as_py(), table.column("size")[0].as_py()
            top = _levels(_slots(table, bits), _depth(size_, above, bits))[-1][0]
            return pa.table({"tree": [own], "size": pa.array([size_], pa.int64()),
                             "pos": pa.array([table.column("pos")[0].as_py() >> bits], pa.int64()), "digest": [bytes.fromhex(top)]})

        tables.append(cut(
            tables[-1].select("tree", "size", "pos", "digest").groupBy("tree", F.expr(f"shiftright(pos, {bits})"))
            .applyInArrow(returning(reduce), "tree string, size long, pos long, digest binary")))
    return tables


_ABOVE = "tree string, pos long, way string, subroot string, root string"


def _grouped(frame: DataFrame, bits: int):
    return frame.withColumn("group", F.expr(f"shiftright(pos, {bits})")).groupBy("tree", "group")


def _down(tables: list[DataFrame], above: DataFrame, bits: int, to: int = 0) -> DataFrame:
    """``tree, pos, way, subroot, root`` of the nodes of ``tables[to]``, from that of the last table's nodes."""
    def extend(round_: int):
        def run(table: pa.Table, up: pa.Table) -> pa.Table:
            size = table.column("size")[0].as_py()
            levels = _levels(_slots(table, bits), _depth(size, round_, bits))
            rest, subroot, root = (up.column(name)[0].as_py() for name in ("way", "subroot", "root"))
            pos = table.column("pos").to_pylist()
            ways = [_siblings(levels, place & ((1 << bits) - 1)) + rest for place in pos]
            return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "way": ways,
                             "subroot": pa.array([subroot] * len(pos), pa.string()), "root": [root] * len(pos)})

        return run

    for round_ in range(len(tables) - 2, to - 1, -1):
        above = _grouped(tables[round_].select("tree", "size", "pos", "digest"), bits).cogroup(
            above.withColumn("group", F.col("pos")).groupBy("tree", "group")).applyInArrow(extend(round_), _ABOVE)
    return above


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    Ids are whole numbers. Defined cases: nulls are marked as such in the leaf; rows without an id come last in their
    language; rows that repeat an id go by their leaves, wholly equal rows in a fixed order of their own; a null language is
    the first tree; a lone leaf is its tree's root and a lone tree's root the root; an empty table gives an empty result;
    other columns are ignored.
    """
    nodes = cut(leaves(docs))
    rows = cut(placed(nodes).withColumnRenamed("leaf", "digest"))
    size = rows.agg(F.max("size")).first()[0]
    schema = [field for field in docs.select("doc_id").schema]
    if not size:
        return rows.select("doc_id", *[F.lit("").alias(name) for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
                           F.lit(True).alias("verified"))
    tables = _up(rows, size, bits)
    trees = tables[-1]
    # One row for every language: the only windows over a whole table.
    names = cut(trees.select(
        F.col("tree").alias("name"), F.lit("").alias("tree"), F.count("*").over(Window.partitionBy()).alias("size"),
        (F.row_number().over(Window.orderBy("tree")) - 1).cast("long").alias("pos"), "digest"))
    subroots = _up(names, names.count(), bits)
    top = subroots[-1].select("tree", "pos", F.lit("").alias("way"), F.lit(None).cast("string").alias("subroot"),
                              F.lower(F.hex("digest")).alias("root"))
    above = (
        _down(subroots, top, bits).drop("tree", "subroot").join(names.drop("tree", "size"), "pos")
        .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "way", F.lower(F.hex("digest")).alias("subroot"), "root")
    )
    above = cut(_down(tables, above, bits, to=1))

    def finish(table: pa.Table, up: pa.Table) -> pa.Table:
        levels = _levels(_slots(table, bits), _depth(table.column("size")[0].as_py(), 0, bits))
        rest, subroot, root = (up.column(name)[0].as_py() for name in ("way", "subroot", "root"))
        rest = _steps(rest)
        proofs, folded = [], []
        for place, digest, altered in zip(*(table.column(name).to_pylist() for name in ("pos", "digest", "altered"))):
            steps = _steps(_siblings(levels, place & ((1 << bits) - 1))) + rest
            proofs.append(_hash("".join(other for _, other in steps)))
            folded.append(fold((altered or digest).hex(), steps))
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": [digest.hex() for digest in table.column("digest").to_pylist()],
            "subroot": [subroot] * len(proofs), "root": [root] * len(proofs), "proof_sha256": proofs, "folded_root": folded,
            "verified": [own == root for own in folded]})

    kind = schema[0].dataType.simpleString()
    return _grouped(rows, bits).cogroup(above.withColumn("group", F.col("pos")).groupBy("tree", "group")).applyInArrow(
        finish, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


ORACLE = """
WITH RECURSIVE
field AS (
  SELECT doc_id, lang, n_chars,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
         list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, lang,
         sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS h,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
              THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS altered
  FROM field),
place AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaf),
t AS (
  SELECT lang, 0 AS lev, pos, h, n FROM place
  UNION ALL
  SELECT lang, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1
  GROUP BY lang, lev, pos // 2, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lev, pos, h, n FROM s
  UNION ALL
  SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, pos // 2, n),
p AS (
  SELECT doc_id, lang, pos AS at, pos, 0 AS lev, n, '' AS way, coalesce(altered, h) AS f FROM place
  UNION ALL
  SELECT p.doc_id, p.lang, p.at, p.pos // 2, p.lev + 1, (p.n + 1) // 2, p.way || coalesce(o.h, ''),
         sha256(CASE WHEN p.pos % 2 = 1 THEN o.h || p.f ELSE p.f || coalesce(o.h, '') END)
  FROM p LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lev = p.lev AND o.pos = xor(p.pos, 1)
  WHERE p.n > 1),
r AS (
  SELECT p.doc_id, p.lang, p.at, s.pos, 0 AS lev, s.n, p.way, p.f
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT r.doc_id, r.lang, r.at, r.pos // 2, r.lev + 1, (r.n + 1) // 2, r.way || coalesce(o.h, ''),
         sha256(CASE WHEN r.pos % 2 = 1 THEN o.h || r.f ELSE r.f || coalesce(o.h, '') END)
  FROM r LEFT JOIN u o ON o.lev = r.lev AND o.pos = xor(r.pos, 1)
  WHERE r.n > 1)
SELECT place.doc_id, place.h AS leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(r.way) AS proof_sha256,
       r.f AS folded_root, r.f = (SELECT h FROM u WHERE n = 1) AS verified
FROM place
JOIN s ON s.lang IS NOT DISTINCT FROM place.lang
JOIN r ON r.lang IS NOT DISTINCT FROM place.lang AND r.at = place.pos AND r.n = 1
"""
