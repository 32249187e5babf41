"""The training-data pipeline: five stages over ``documents``, each written to the shared folder before the next.

Stages take ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``; the last returns every
remaining row's tokens. A stage keeps the rows and texts of its predecessor except for what it decides:

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of near-duplicates stays, the one with the smallest id. First the groups of op6
   (3-word shingles, 3 bits); among what they leave, groups of verified links at five words and a similarity of 0.8 or more.
3. repeated_passages: bytes of repeated 100-byte passages are cut out; ``n_chars`` follows the text. Bytes of a character
   of which only a part was cut are dropped with it. Documents of which nothing is left go.
4. mixture: documents that the mix takes stay, once for every time that they are taken.
5. tokens: byte-level BPE ids of every row, with the text that they decode to.

Nulls, empty texts, repeated rows, empty tables and extra columns are treated as the operators say; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import bpe, mixing, quality, similar, simhash, suffixdedup
from barloom.llm.common import table
from barloom.session import configure, cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.deduplicated(cut(simhash.deduplicated(docs)))


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixdedup.without_repeats(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.col("data").cast("string").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("mixture", mixture_stage),
    ("tokens", token_stage),
]

# The classifier, fingerprints and hashes of the stages have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every result but the last is a table in the shared folder."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
