"""Queries of the operators in this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    bpe, htmltext, kdtree, merkle, mixing, ogg, quality, simhash, sourceaudit, stableprojection, suffixdedup,
    tokencount, urlfilter,
)
from barloom.llm.common import table

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


@query("op7_mix_sources", mixing.ORACLE)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_ogg_media")
def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(table(spark, sf_dir, "documents"))


@query("op3_unigram_counts")
def op3_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


@query("op10_bpe_rank_queue")
def op10_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query("op1_kdtree_topk")
def op1_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kdtree.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.labelled_table(spark))


@query("op9_html_main_text")
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query("op6_simhash_ball")
def op6_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_quality_pu")
def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", merkle.ORACLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_source_audit", sourceaudit.ORACLE)
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourceaudit.audit(table(spark, sf_dir, "documents"))


@query("op12_stable_projection")
def op12_stable_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return stableprojection.nearest(vectors, vectors.where("vec_id % 50 = 0"))
