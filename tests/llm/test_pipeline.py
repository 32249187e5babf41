import os

import pytest

import corpus_pipeline
from barloom.llm import bpe, mixing, simhash, suffixdedup
from barloom.session import cut
from tests.llm.fixtures import docs, prose
from tests.llm.test_similar import components

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test data not present")


def test_stages_decide_one_after_another(spark):
    frame = spark.read.parquet(f"{ROOT}/documents.parquet")
    before = frame
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, before, ROOT))
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()} and ids
        if name != "tokens":
            assert after.columns == frame.columns
        if name == "near_duplicates":
            first = {r[0] for r in simhash.near_duplicates(before).select("component_id").distinct().collect()}
            rows = [(r["doc_id"], r["text"]) for r in before.collect() if r["doc_id"] in first]
            assert ids == set(components(rows).values()) and after.count() == len(ids)
        if name == "repeated_passages":
            figures = {r["doc_id"]: r for r in suffixdedup.digests(before).collect()}
            texts = {r["doc_id"]: len(r["text"].encode()) for r in after.collect()}
            assert all(0 <= figures[i]["n_bytes"] - figures[i]["n_removed"] - n <= 6 * figures[i]["n_spans"]
                       for i, n in texts.items())
        if name == "mixture":
            taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix(before).collect()}
            times = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert times == {i: n for i, n in taken.items() if n}
        if name == "tokens":
            want = {(r["doc_id"], r["text"]) for r in before.collect()}
            assert {(r["doc_id"], r["text"]) for r in after.collect()} == want
            assert after.count() == before.count()
        before = after
    assert corpus_pipeline.run(spark, ROOT).count() == before.count()


def test_clean_documents_pass_all_filters(spark):
    rows = [(i, prose(1000 + i, 60 + i), "en", "s", 1) for i in range(40)]
    kept = suffixdedup.without_repeats(cut(simhash.deduplicated(docs(spark, rows))))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(r[0], r[1]) for r in rows}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert bpe and "op7_mix_sources" in entry.oracle_sql()
