import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing, quality, simhash, suffixdedup
from tests.llm.fixtures import awkward_rows, docs, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    own = random.Random(3)
    junk = (lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: t.replace(" ", "### "),
            lambda t: (t.split()[0] + " ") * 40)
    rows, labels, sound = [], [], {}
    for i in range(n):
        text, bad = " ".join(prose(i * 10 + k, 12) for k in range(own.randrange(2, 8))), own.random() < 0.2
        rows.append((i, own.choice(junk)(text) if bad else text, "en", "a", 1))
        sound[i] = not bad
        if i % 2:
            labels.append((i, int(not bad), 0))
    return rows, labels, sound


def test_held_out_accuracy(spark):
    rows, labels, _ = corpus()
    truth = {i: q for i, q, _ in labels}
    got = quality.score(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = [r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]
    assert len(right) > 20 and np.mean(right) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_labels_of_the_test_fold_and_negatives_change_nothing(spark):
    rows, labels, _ = corpus(200)
    frame = docs(spark, rows)
    changed = [(i, 1 - q, t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in labels]
    positives = [x for x in labels if x[1] == 1]
    scores = [
        {r["doc_id"]: r["score"] for r in quality.score(frame, spark.createDataFrame(own, LABELS)).collect()}
        for own in (labels, changed, positives)]
    assert scores[0] == scores[1] == scores[2]


def test_prior_and_non_negative_risk():
    own = np.random.default_rng(1)
    good, bad = own.normal(1, 0.5, (3000, 5)), own.normal(-1, 0.5, (3000, 5))
    unlabelled = np.concatenate([good[:1400], bad[:600]])
    weights, prior = quality.fit(good[1500:2500].astype(np.float32), unlabelled.astype(np.float32))
    assert abs(prior - 0.7) < 0.06
    score = lambda x: x @ weights[:-1] + weights[-1]
    assert (score(good[2500:]) > 0).mean() > 0.97 and (score(bad[2500:]) < 0).mean() > 0.97


def test_awkward_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, 1), (999, 1, 0), (None, 1, 0), (5, None, None)], LABELS)
    got = quality.score(docs(spark, clashing=True), labels).collect()
    assert len(got) == len(awkward_rows()) and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[3] == scores[4] and scores[1] == scores[2]
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score(docs(spark), none).collect()} == {0.5}
    assert quality.score(empty(spark), labels).count() == 0
    with pytest.warns(UserWarning, match="0 trusted positives"):
        kept = quality.accepted(docs(spark, clashing=True), none)
    assert kept.count() == len(awkward_rows()) and kept.columns == docs(spark, clashing=True).columns


def test_chunks_change_nothing(monkeypatch):
    text = prose(5, 900).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "CHUNK", 100)
    assert np.allclose(quality.features(text)[:quality.TRIGRAMS], whole[:quality.TRIGRAMS])
    assert abs(quality.features(text)[-1] - whole[-1]) < 0.05


def test_a_wrong_prior_does_not_reject_good_text(spark, monkeypatch):
    rows, labels, good = corpus()
    monkeypatch.setattr(quality, "class_prior", lambda *sides: 0.3)
    kept = {r["doc_id"] for r in quality.accepted(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    sound, bad = ({i for i, own in good.items() if own is kind} for kind in (True, False))
    assert len(kept & sound) >= 0.95 * len(sound) and len(kept & bad) <= 0.1 * len(bad)


def test_an_id_on_very_many_rows_takes_one_place_of_the_sample(spark):
    rows, labels, good = corpus()
    many = spark.range(40_000).selectExpr("1L doc_id", "concat('again ', id) text", "'en' lang", "'a' source", "1L n_chars")
    frame = docs(spark, rows).where("doc_id <> 1").union(many)
    kept = {r["doc_id"] for r in quality.accepted(frame, spark.createDataFrame(labels, LABELS)).collect()} - {1}
    sound = {i for i, own in good.items() if own} - {1}
    assert len(kept & sound) >= 0.95 * len(sound) and len(kept - sound) <= 5


def test_names_with_dots_and_spaces_are_carried(spark):
    rows, labels, _ = corpus(120)
    frame = docs(spark, rows).withColumn("a.b", F.lit(1)).withColumn("my col", F.lit("x")).withColumn("x:y`z", F.lit(2.0))
    own = spark.createDataFrame(labels, LABELS)
    for stage in (lambda f: quality.accepted(f, own), simhash.deduplicated, suffixdedup.without_repeats, mixing.mixed_rows):
        after = stage(frame)
        assert after.columns == frame.columns and after.first()["my col"] == "x" and after.first()["x:y`z"] == 2.0
