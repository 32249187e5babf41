"""Source divergence audit: how much the sources of a language differ in their words, and by which words.

A task gathers whole documents up to `PIECE` bytes, joins them sorted by (language, source) and finds the terms, runs of
letters and non-ASCII bytes, by one pass over byte classes. Terms go to buckets by length. A term of up to 8 bytes is one
unsigned word, one of up to 16 bytes two words; a bucket is sorted by a least-significant-digit radix sort over 16-bit
digits, as many as its length needs. The sort is stable and the terms come in order of group and document, so one pass over
the sorted words counts occurrences by (language, source, term) and the documents of each. Longer terms go to buckets of their
own, sorted as bytes. Spark adds the counts of the pieces; every later step works on counts.

Frequencies are whole numbers in parts of 10^9 (with `PRIOR` added to every count), so all sums are exact. Differences of
pairs of sources are summed in blocks: `BLOCK` by `BLOCK` sources and a bucket of terms at a time, of which only terms that
occur are sent; what the others add is one product. No pairs of rows are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import bytes_of, map_batches, returning, utf8
from barloom.session import cut

MIN_DOCS = 30
PRIOR = 5
UNIT = 1_000_000_000
TOP = 50
PIECE = 12 << 20  # bytes of text that a task holds at once
BLOCK = 64  # sources
BUCKET_TERMS = 256

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes


def _radix_order(words: list[np.ndarray], digits: int) -> np.ndarray:
    """Stable order by the first ``digits`` 16-bit digits of one or two words, the least one first."""
    order = None
    for digit in range(digits):
        word, shift = words[digit // 4], np.uint64(16 * (digit % 4))
        key = ((word if order is None else word[order]) >> shift).astype(np.uint16)
        step = np.argsort(key, kind="stable")
        order = step if order is None else order[step]
    return order


def _runs(same: np.ndarray, groups: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs of one term and group, their sizes and their numbers of documents. ``same``: term as the one before."""
    fresh = ~same | (groups != np.concatenate([[-1], groups[:-1]]))
    begins = np.flatnonzero(fresh)
    new_document = fresh | (documents != np.concatenate([[-1], documents[:-1]]))
    sizes = np.diff([*begins, len(same)])
    return begins, sizes, np.add.reduceat(new_document.astype(np.int64), begins)


def _packed(words: list[np.ndarray], lengths: np.ndarray) -> pa.Array:
    """Terms from their words as an Arrow array of bytes."""
    data = np.stack(words, axis=1).view(np.uint8).reshape(len(lengths), -1)
    data = data[np.arange(data.shape[1]) < lengths[:, None]]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def term_counts(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """``group, term, occurrences, documents`` of texts given in order of their groups."""
    joined = np.frombuffer(b" ".join([*texts, bytes(16)]), np.uint8)
    marks = LETTERS[joined]
    edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1
    if marks[0]:
        edges = np.concatenate([[0], edges])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    begins = np.concatenate([[0], np.cumsum([len(text) + 1 for text in texts])[:-1]])
    documents = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, [*begins, len(joined)])))
    joined = LOWER[joined]
    at = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))  # the eight bytes from every place on
    digits = (lengths + 1) >> 1
    for count in range(1, 9):
        own = np.flatnonzero(digits == count)
        if not len(own):
            continue
        first, size = starts[own], lengths[own]
        words = [at[first] & KEEP[np.minimum(size, 8)]]
        if count > 4:
            words.append(at[first + 8] & KEEP[size - 8])
        order = _radix_order(words, count)
        words, size, of = [word[order] for word in words], size[order], documents[own][order]
        same = np.logical_and.reduce([np.concatenate([[False], word[1:] == word[:-1]]) for word in words])
        begin, sizes, holding = _runs(same, groups[of], of)
        yield groups[of[begin]], _packed([word[begin] for word in words], size[begin]), sizes, holding
    long = np.flatnonzero(digits > 8)
    for length in np.unique(lengths[long]):  # terms of one length are one bucket, sorted as bytes
        own = long[lengths[long] == length]
        terms = [joined[a:a + length].tobytes() for a in starts[own]]
        order = sorted(range(len(own)), key=terms.__getitem__)
        terms, of = [terms[i] for i in order], documents[own][order]
        same = np.array([False, *(a == b for a, b in zip(terms, terms[1:]))])
        begin, sizes, holding = _runs(same, groups[of], of)
        yield groups[of[begin]], pa.array([terms[i] for i in begin], pa.binary()), sizes, holding


def _long_text(text: bytes) -> list[bytes]:
    """A long text in parts of about PIECE bytes that end where no term goes on."""
    parts, at = [], 0
    while len(text) - at > PIECE:
        marks = LETTERS[np.frombuffer(text, np.uint8, PIECE, at)]
        ends = np.flatnonzero(~marks)
        stop = at + int(ends[-1]) + 1 if len(ends) else at + PIECE
        while not len(ends) and stop < len(text):  # one term longer than PIECE
            marks = LETTERS[np.frombuffer(text, np.uint8, min(PIECE, len(text) - stop), stop)]
            ends = np.flatnonzero(~marks)
            stop += int(ends[0]) + 1 if len(ends) else len(marks)
        parts.append(text[at:stop])
        at = stop
    return [*parts, text[at:]]


def _long_counts(text: bytes) -> tuple[pa.Array, list[int]]:
    total: dict[bytes, int] = {}
    for part in _long_text(text):
        for _, terms, sizes, _ in term_counts([part], np.zeros(1, np.int64)):
            for term, size in zip(terms.to_pylist(), sizes.tolist()):
                total[term] = total.get(term, 0) + size
    return pa.array(list(total), pa.binary()), list(total.values())


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs`` by (language, source, term); every group also has a row of the empty term."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        held: list[tuple[tuple[str, str], bytes]] = []
        size = 0

        def rows(names: list[tuple[str, str]], own: np.ndarray, terms: pa.Array, n: object, docs: object) -> dict[str, object]:
            own = pa.array(own)
            return {"lang": pa.array([a for a, _ in names]).take(own), "source": pa.array([b for _, b in names]).take(own),
                    "term": terms, "n": n, "docs": docs}

        def flush() -> Iterator[dict[str, object]]:
            held.sort(key=lambda row: row[0])
            names = sorted({name for name, _ in held})
            place = {name: i for i, name in enumerate(names)}
            groups = np.array([place[name] for name, _ in held], np.int64)
            yield rows(names, np.arange(len(names)), pa.array([b""] * len(names), pa.binary()), [0] * len(names), [0] * len(names))
            texts = [text for _, text in held]
            for own, terms, n, of in term_counts(texts, groups):
                yield rows(names, own, terms, n, of)

        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for name, text in zip(names, bytes_of(batch, "text")):
                if len(text) > PIECE:
                    terms, n = _long_counts(text)
                    yield rows([name], np.zeros(len(n), np.int64), terms, n, [1] * len(n))
                    text = b""
                held.append((name, text))
                size += len(text) + 64
                if size > PIECE:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    plain = docs.select(*[F.coalesce(F.col(own).cast("string"), F.lit("")).alias(name)
                          for name, own in (("lang", lang_col), ("source", source_col))], utf8(text_col).alias("text"))
    found = map_batches(plain, work, "lang string, source string, term binary, n long, docs long")
    return (
        found.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _parts(count: Column | str, total: str, terms: str, prior: int) -> Column:
    """Parts of UNIT, 1 at least, without rounding; 0 where no term is kept."""
    shown = count if isinstance(count, str) else "0"
    exact = (f"CAST(CAST({UNIT} AS DECIMAL(10,0)) * CAST({shown} + {prior} AS DECIMAL(20,0)) "
             f"DIV CAST({total} + {prior} * {terms} AS DECIMAL(20,0)) AS BIGINT)")
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {exact} ELSE 0L END")


def _block_sums(table: pa.Table) -> pa.Table:
    """Sums of differences over one bucket of terms between two blocks of sources, beyond what absent terms would give.

    Rows: ``place`` (of a source in its language), ``term``, ``p``, ``base`` (p of an absent term). A row without a term only
    names its source.
    """
    places, rows = np.unique(table.column("place").to_numpy(), return_inverse=True)
    base = np.zeros(len(places), np.int64)
    base[rows] = table.column("base").to_numpy()
    has = table.column("term").is_valid().to_numpy()
    names = table.column("term").filter(pa.array(has)).combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    terms = names.indices.to_numpy() if len(names) else np.zeros(0, np.int64)
    width = len(names.dictionary) if len(names) else 0
    p = np.repeat(base[:, None], width, axis=1)
    p[rows[has], terms] = table.column("p").to_numpy()[has]
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    block = places // BLOCK
    a, b, sums = [], [], []
    for i in np.flatnonzero(block == lo):
        others = np.flatnonzero((block == hi) & (places > places[i]))
        more = np.abs(p[others] - p[i]).sum(1) - width * np.abs(base[others] - base[i])
        a.append(np.full(len(others), places[i]))
        b.append(places[others])
        sums.append(more)
    both = [np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64) for own in (a, b, sums)]
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(both[0]), pa.string()),
                     "a": both[0], "b": both[1], "more": both[2]})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, prior: int = PRIOR, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: the summed difference of a source to every other source of its language. Part ``term``: the ``top`` terms
    that a source has more often than its language.

    Defined cases: null text, language and source are empty strings; a language of which no term is in ``min_docs``
    documents has pairs of value 0 and no terms; a source alone in its language has no pairs; repeated rows are documents
    of their own; equal values go by the bytes of the item; an empty table gives an empty result; other columns are ignored.
    """
    found = cut(counts(docs, text_col, lang_col, source_col))
    kept_terms = (
        found.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs).drop("docs")
    )
    kept = cut(found.where("term <> ''").drop("docs").join(kept_terms, ["lang", "term"]))
    by_lang = (
        kept.select("lang", "term", "lang_n").distinct().groupBy("lang")
        .agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    )
    # One row for every source of a language: small, as the pairs of the result are.
    place = Window.partitionBy("lang").orderBy("source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(
        found.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left")
        .fillna(0, ["total", "terms", "lang_total"])
        .withColumn("place", F.row_number().over(place).cast("long") - 1)
        .withColumn("blocks", F.floor((F.max("place").over(Window.partitionBy("lang"))) / BLOCK) + 1)
        .withColumn("base", _parts(F.lit(0), "total", "terms", prior))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("terms") / BUCKET_TERMS)))
    )
    rated = kept.join(groups, ["lang", "source"]).withColumn("p", _parts("n", "total", "terms", prior))

    more = rated.withColumn("q", _parts("lang_n", "lang_total", "terms", prior)).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = (
        more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    )

    own_block = F.floor(F.col("place") / BLOCK)
    shared = ["lang", "place", "base", "blocks"]
    entries = rated.select(*shared, F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "term", "p").unionByName(
        groups.select(*shared, F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"),
                      F.lit(None).cast("string").alias("term"), F.col("base").alias("p")))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sums = (
        entries.withColumn("block", own_block).withColumn("met", met)
        .select("lang", "bucket", F.least("block", "met").alias("lo"), F.greatest("block", "met").alias("hi"),
                "place", "term", "p", "base")
        .groupBy("lang", "bucket", "lo", "hi").applyInArrow(returning(_block_sums), "lang string, a long, b long, more long")
        .groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    )
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    left, right = (groups.select("lang", F.col("place").alias(side), F.col("source").alias(name), F.col("base").alias(f"{name}_base"),
                                 *([] if side == "b" else ["terms"])) for side, name in (("a", "source"), ("b", "item")))
    pairs = (
        both.join(left, ["lang", "a"]).join(right, ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                (F.col("more") + F.col("terms") * F.abs(F.col("source_base") - F.col("item_base"))).alias("value"))
        .withColumn("rank", F.row_number().over(order))
    )
    return pairs.unionByName(best)


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found
  FROM documents),
o AS (SELECT lang, source, doc, unnest(found) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // CAST(g.total + 5 * v.terms AS HUGEINT) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.lang_n + 5) // CAST(v.lang_total + 5 * v.terms AS HUGEINT) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
