"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the rest of the training set is unlabelled web text, whose
labels are not looked at. A linear model minimises the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` under logistic loss, so that its output is a
probability; where the second part is negative the step goes against it.

The class prior is estimated from scores of first models that tell positives from unlabelled text, each judged on ids it
has not seen: above any threshold the share of unlabelled text is at least the prior times the share of positives, and where
no negatives score high it is equal. The threshold is the one with the smallest upper confidence bound of that ratio (best
bin estimation), so that no single noisy point decides. Whatever the prior says, the intercept is then raised as far as
needed for `RECALL` of the trusted positives, judged by models that have not seen them, to reach `ACCEPT`: an
underestimated prior cannot reject the bulk of good text.

Features describe form, not words: shares of trigrams of character classes, which serve all languages. Labels,
language, source and id are no inputs. The model is fitted on bounded samples, `POSITIVES` and `UNLABELLED` ids with
the smallest hashes under two seeds, one text of each id; every document is scored over its whole text.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.llm.common import bytes_of, map_batches, utf8, whole_row

POSITIVES, UNLABELLED = 4_000, 4_000
STEPS, RATE, MOMENTUM, RIDGE = 200, 0.4, 0.9, 1e-4
SCALE = 4.0  # of the features, so that the intercept does not dominate
PARTS = 4
LEAST_SHARE, TAIL, RISK = 0.5, 0.98, 0.05  # the prior: thresholds between these shares of positives, chance that a bound fails
ACCEPT, RECALL = 0.7, 0.98
FOLDS, HELD_OUT = 4, 2
CHUNK = 1 << 20

# Classes of bytes: lower, upper, digit, space, line break, sentence marks, bar, other marks, other bytes.
_CLASSES = 9


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 8, np.int64)
    kinds[33:127] = 7
    kinds[ord("a"):ord("z") + 1], kinds[ord("A"):ord("Z") + 1], kinds[ord("0"):ord("9") + 1] = 0, 1, 2
    kinds[[9, 32]], kinds[[10, 11, 12, 13]] = 3, 4
    kinds[[ord(c) for c in ".,;:?'\"()-"]], kinds[ord("|")] = 5, 6
    return kinds


KINDS = _byte_classes()
TRIGRAMS = _CLASSES ** 3
LAGS = (1, 2, 3)
SIZE = TRIGRAMS + len(LAGS) + 1


def features(data: bytes) -> np.ndarray:
    """Roots of the shares of class trigrams, then shares of words that repeat one shortly before and how far the
    text compresses; all zero for an empty text."""
    counts = np.zeros(TRIGRAMS, np.int64)
    padded = b"\n" + data + b"\n" if data else b""
    for at in range(0, max(len(padded) - 2, 0), CHUNK):
        kinds = KINDS[np.frombuffer(padded[at:at + CHUNK + 2], np.uint8)]
        counts += np.bincount(kinds[:-2] * (_CLASSES ** 2) + kinds[1:-1] * _CLASSES + kinds[2:], minlength=TRIGRAMS)
    words = data.split()
    repeats = [sum(map(eq, words, words[lag:])) / max(1, len(words)) for lag in LAGS]
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[at:at + CHUNK])) for at in range(0, len(data), CHUNK)) + len(packer.flush())
    saved = max(0.0, 1 - (packed + 100) / (len(data) + 100))
    return np.concatenate([np.sqrt(counts / max(1, counts.sum())), repeats, [saved]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _fit(gradient, size: int) -> np.ndarray:
    weights, speed = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for _ in range(STEPS):
        ahead = weights + MOMENTUM * speed
        speed = MOMENTUM * speed - RATE * (gradient(ahead) + RIDGE * ahead)
        weights = weights + speed
    return weights


def _folds(parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in range(PARTS):
        yield parts != part, parts == part


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, ours_part: np.ndarray, theirs_part: np.ndarray) -> float:
    """Share of positives in ``unlabelled`` from models of positive against unlabelled, each judged on the parts it has
    not seen. An id is in the same part on both sides."""
    ours, theirs = [], []
    for (p_in, p_out), (u_in, u_out) in zip(_folds(ours_part), _folds(theirs_part), strict=True):
        p, u = positive[p_in], unlabelled[u_in]

        def gradient(w: np.ndarray) -> np.ndarray:
            return (p.T @ (_sigmoid(p @ w) - 1) / max(1, len(p)) + u.T @ _sigmoid(u @ w) / max(1, len(u))) / 2

        weights = _fit(gradient, positive.shape[1])
        ours.append(positive[p_out] @ weights)
        theirs.append(unlabelled[u_out] @ weights)
    ours, theirs = np.concatenate(ours), np.sort(np.concatenate(theirs))
    shares = np.linspace(LEAST_SHARE, TAIL, 40)
    above = 1 - np.searchsorted(theirs, np.quantile(ours, 1 - shares), side="left") / len(theirs)
    slack = sum(np.sqrt(np.log(4 / RISK) / (2 * len(side))) for side in (ours, theirs))
    best = np.argmin((above + slack) / shares)
    return float(np.clip(above[best] / shares[best], 0.05, 0.98))


def _non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk."""
    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = positive @ w, unlabelled @ w
        push = prior * positive.T @ (_sigmoid(p) - 1) / len(p)
        negative = unlabelled.T @ _sigmoid(u) / len(u) - prior * positive.T @ _sigmoid(p) / len(p)
        risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        return push + negative if risk >= 0 else -negative

    return _fit(gradient, positive.shape[1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, ours_part: np.ndarray | None = None,
        theirs_part: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights (intercept last) and the prior. ``ours_part`` and ``theirs_part`` deal the rows to parts for judging (by
    place if none are given). Without positives or unlabelled text every score is one half, with a warning."""
    size = (positive if len(positive) else unlabelled).shape[1] + 1 if len(positive) or len(unlabelled) else SIZE + 1
    if not len(positive) or not len(unlabelled):
        warnings.warn(f"no fit: {len(positive)} trusted positives, {len(unlabelled)} unlabelled documents", stacklevel=2)
        return np.zeros(size), 0.5
    ours_part, theirs_part = (np.arange(len(side)) % PARTS if part is None else part
                              for side, part in ((positive, ours_part), (unlabelled, theirs_part)))
    used = np.append(positive.any(0) | unlabelled.any(0), True)  # trigrams that occur, and the intercept
    positive, unlabelled = (np.hstack([own * SCALE, np.ones((len(own), 1))])[:, used].astype(np.float32)
                            for own in (positive, unlabelled))
    prior = class_prior(positive, unlabelled, ours_part, theirs_part)
    margins = []
    for (p_in, p_out), (u_in, _) in zip(_folds(ours_part), _folds(theirs_part), strict=True):
        if p_in.any() and p_out.any() and u_in.any():
            margins.append(positive[p_out] @ _non_negative(positive[p_in], unlabelled[u_in], prior))
    weights = np.zeros(size)
    weights[used] = _non_negative(positive, unlabelled, prior)
    unseen = np.concatenate(margins) if margins else positive @ weights[used]
    weights[-1] += max(0.0, np.log(ACCEPT / (1 - ACCEPT)) - float(np.quantile(unseen, 1 - RECALL)))
    weights[:-1] *= SCALE
    return weights, prior


def held_out(id_col: str) -> Column:
    """Rows of the test fold: CRC-32 of the id as text, modulo the number of folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _sampled(ids: DataFrame, rows: int, seed: str) -> DataFrame:
    """At most ``rows`` distinct ids, those with the smallest hashes."""
    return ids.where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> np.ndarray:
    """Weights from labelled positives outside the test fold and from unlabelled documents.

    What reaches the driver is one vector for each sampled id; of an id that repeats, the text with the smallest hash
    stands for it.
    """
    trusted = labels.where(~held_out(id_col) & (F.col("quality") == 1)).select(F.col(id_col).alias("_id"))
    wanted = (
        _sampled(trusted, positives, "positive").withColumn("kind", F.lit(1))
        .union(_sampled(docs.select(F.col(id_col).alias("_id")), unlabelled, "unlabelled").withColumn("kind", F.lit(0)))
    )
    texts = (
        docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text"))
        .join(F.broadcast(wanted), "_id")  # at most positives + unlabelled rows of two numbers
        .groupBy("_id", "kind").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.length("_text"))).alias("_text"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            yield {"kind": batch.column("kind"), "id": batch.column("_id").cast(pa.string()),
                   "vector": [features(data).astype(np.float32).tobytes() for data in bytes_of(batch, "_text")]}

    rows = map_batches(texts, work, "kind int, id string, vector binary").collect()
    rows.sort(key=lambda row: (row.kind, zlib.crc32(row.id.encode()), row.id))
    sides = [np.array([np.frombuffer(row.vector, np.float32) for row in rows if row.kind == kind], np.float32)
             .reshape(-1, SIZE) for kind in (1, 0)]
    parts = [np.array([zlib.adler32(row.id.encode()) % PARTS for row in rows if row.kind == kind], int) for kind in (1, 0)]
    return fit(*sides, *parts)[0]


def _scored(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, keep: bool) -> DataFrame:
    columns = {"_id": docs.schema[id_col].dataType}
    rows = [F.col(id_col).alias("_id"), utf8(text_col).alias("_text")]
    if keep:
        rows.append(whole_row(docs))
        columns["row"] = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            margins = np.array([features(data) @ weights[:-1] + weights[-1] for data in bytes_of(batch, "_text")])
            yield {**{name: batch.column(name) for name in columns}, "score": _sigmoid(margins)}

    schema = StructType([StructField(name, kind) for name, kind in columns.items()]).add("score", DoubleType())
    return map_batches(docs.select(*rows), work, schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, held_out, score, predicted`` for every row.

    Defined cases: null and empty texts get the score of the intercept; equal texts get equal scores; without trusted
    positives every score is one half; a null id is not held out; an empty table gives an empty result; other columns are
    ignored; labels of unknown ids, null qualities and repeated labels do no harm.
    """
    scored = _scored(docs, train(docs, labels, id_col, text_col), id_col, text_col, keep=False)
    return scored.select(
        F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; all of them, with a warning, where there is nothing to learn from."""
    weights = train(docs, labels, id_col, text_col)
    if not weights.any():
        return docs
    return _scored(docs, weights, id_col, text_col, keep=True).where(F.col("score") >= ACCEPT).select("row.*")
