"""Mixing of sources to target weights, by hash-random order and distributed prefix sums.

Every document gets a random key from the hash of its id. The key space is cut into equal ranges
(`BUCKETS`); within a source the ranges are summed, the sums become offsets, and a window inside one
(source, range) adds the running sum of the range. So a source is range-sorted and prefix-summed
without any task holding a whole source. The budget of a source is spent in that order: whole epochs
first, then the documents up to the cut. The cut keeps the document that it meets if at least half
of it fits, so a source misses its target by half a document at most.

Only DataFrame functions are used. One-row-per-source tables are the only unpartitioned windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import whole_row
from barloom.session import cut

BUCKETS = 4096  # ranges of the random key within a source: three hexadecimal digits
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)  # by code point of the source, repeating; null comes last
WORD = r"[^\x20\x09-\x0D]+"

_SOURCE = ["_no_source", "_source"]


def _nullable(name: str) -> list[Column]:
    return [F.col(name).isNull().cast("int").alias("_no_source"),
            F.coalesce(F.col(name).cast("string"), F.lit("")).alias("_source")]


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Words each source should give: ``sizes`` has one row per source with its ``source_size``.

    Shares follow the weights. A share stops at ``max_epochs`` times its source; the rest is shared
    again by weight among the others until none is above. In order of limit per weight the stopped
    sources come first, so one pass over running sums finds the common level of the others.
    """
    rank = F.row_number().over(Window.orderBy(*_SOURCE)) - 1
    weight = F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), *_SOURCE)
    whole = Window.partitionBy()
    return (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("limit", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
        .withColumn("level", (
            F.sum("source_size").over(whole).cast("double")
            - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ) / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", F.min_by(
            "level", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("place"))
        ).over(whole))
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select(*_SOURCE, "source_size", "target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix-1", keep_rows: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row; ``row`` too with ``keep_rows``.

    Defined cases: a null or empty text has size 0 and is never taken; null sources are one source;
    a null id is hashed as the text ``null``; rows with equal ids are ordered by their text, and rows
    equal in both are interchangeable; an empty table gives an empty result; other columns of any
    name are carried in ``row`` only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keyed = cut(docs.select(
        F.col(id_col).alias("_id"), *_nullable(source_col),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        F.md5(F.concat(F.lit(seed + ":"), ident).cast("binary")).alias("_key"),
        F.md5(text.cast("binary")).alias("_tie"),
        *([whole_row(docs, "_row")] if keep_rows else []),
    ).withColumn("_range", F.substring("_key", 1, 3)))

    ranges = keyed.groupBy(*_SOURCE, "_range").agg(F.sum("_size").alias("range_size"))
    sizes = ranges.groupBy(*_SOURCE).agg(F.sum("range_size").alias("source_size"))
    before = Window.partitionBy(*_SOURCE).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(source_targets(sizes), _SOURCE)
    )
    inside = (Window.partitionBy(*_SOURCE, "_range").orderBy("_key", "_tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.col("offset") + F.sum("_size").over(inside)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    last = (F.col("_size") > 0) & (2 * F.col("end") - F.col("_size") <= 2 * rest)
    return (
        keyed.join(offsets, [*_SOURCE, "_range"])
        .withColumn("end", end).withColumn("epochs", epochs)
        .select(
            F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
            ((F.col("epochs") + last.cast("long")) * F.col("_size")).cast("long").alias("taken"),
            *([F.col("_row").alias("row")] if keep_rows else []),
        )
    )


def mixed_rows(docs: DataFrame, **columns: str) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as the mix takes it."""
    taken = mix(docs, keep_rows=True, **columns)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return (
        taken.withColumn("times", times).where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
        .select("row.*")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS lim FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(lim, coalesce((SELECT arg_min(level, place) FROM l WHERE level * weight <= lim) * weight, lim)) AS target
  FROM l),
p AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY k, md5(t) ROWS UNBOUNDED PRECEDING) AS stop
  FROM d),
e AS (
  SELECT p.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN size > 0 AND 2 * stop - size <= 2 * (target - epochs * source_size)
                           THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM e
"""
