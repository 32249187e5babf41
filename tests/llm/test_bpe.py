import random

import numpy as np
import public_tokenizers
import tiktoken

from barloom.llm import bpe
from tests.llm.fixtures import awkward_rows, docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH),
                              special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], np.int32).tolist()


def test_equals_the_reference_library():
    encoder, own = bpe.Encoder(PATH, public_tokenizers.PATTERN), random.Random(4)
    texts = ["", " ", "  ", "a ", " a", "a  b", "a \n b", " \x1c a \x1db\x1f c", "<|endoftext|>", "aaaa" * 50, "日本語" * 30]
    texts += ["".join(own.choice("abAB01 é$\n\t日\x1c   ") for _ in range(60)) for _ in range(1500)]
    for text in texts:
        assert ids(encoder, text) == REFERENCE.encode_ordinary(text), repr(text)


def test_many_texts_share_a_queue(monkeypatch):
    own = random.Random(9)
    texts = ["".join(own.choice("thearon ") for _ in range(own.randrange(80))) for _ in range(500)]
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    want = [REFERENCE.encode_ordinary(text) for text in texts]
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(bpe, "CHUNKS", 3)
    monkeypatch.setattr(bpe, "TOKENS", 3)
    assert [ids(encoder, text) for text in texts] == want
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_very_long_pre_token(monkeypatch):
    monkeypatch.setattr(bpe, "LISTED", 1000)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    text = "".join(random.Random(5).choice("abcdefg") for _ in range(60_000))
    assert ids(encoder, text) == REFERENCE.encode_ordinary(text)


def test_round_trip_of_awkward_rows(spark):
    rows = awkward_rows()
    got = bpe.decode(bpe.encode(docs(spark, clashing=True))).collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in got) == sorted(
        (str(r[0]), (r[1] or "").encode()) for r in rows)
    assert bpe.digests(docs(spark)).where("doc_id = 3").first()["n_tokens"] == 0


def test_empty_table_and_null_ids(spark):
    assert bpe.digests(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [464])], "doc_id long, ids array<int>")
    assert [bytes(r["data"]) for r in bpe.decode(nulls).orderBy("doc_id").collect()] == [b"", b"The"]


def test_round_trip_takes_one_worker_and_small_portions(spark, monkeypatch):
    frame = docs(spark, clashing=True)
    whole = bpe.round_trip(frame)
    assert whole._jdf.queryExecution().toString().count("MapInArrow") * 2 == bpe.decode(bpe.encode(frame))._jdf.queryExecution().toString().count("MapInArrow")
    both = [sorted(map(str, got.collect())) for got in (whole, bpe.decode(bpe.encode(frame)))]
    assert both[0] == both[1]
    ids = np.random.default_rng(3).integers(0, 50_000, 5_000, np.int32)
    want = bpe.decode_ids(ids, PATH)
    monkeypatch.setattr(bpe, "PORTION", 16 * 7)
    got = bpe.decode_ids(ids, PATH)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    texts = ["ab " * 50, "", "x" * 300, "é"]
    assert [text for portion in bpe._portions(iter(texts)) for text in portion] == texts
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    table = bpe.pa.RecordBatch.from_pydict({"_text": [text.encode() for text in texts]})
    assert bpe._encoded(encoder, table).to_pylist() == [REFERENCE.encode_ordinary(text) for text in texts]


def test_white_space_beside_spaces_is_found_without_a_pattern():
    blanks = [chr(code) for code in range(0x110000) if chr(code).isspace()]
    assert bpe.glued(" a") and bpe.glued("a ") and not bpe.glued("") and not bpe.glued("a b\nc d")
    for blank in blanks:
        for tail in ("", "é"):
            assert bpe.glued(f"a{blank} b{tail}") and bpe.glued(f"a {blank}b{tail}"), repr(blank)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for text in [f"a{x}{y}b{tail}" for x in [" ", *blanks] for y in (" ", "\n", "") for tail in ("", " é", " c")]:
        assert ids(encoder, text) == REFERENCE.encode_ordinary(text), repr(text)


def test_learning_new_chunks_does_not_wake_the_garbage_collector():
    encoder, own, runs = bpe.Encoder(PATH, public_tokenizers.PATTERN), random.Random(2), []
    text = " ".join("".join(own.choice("thearonqxz") for _ in range(9)) for _ in range(20_000))
    watch = lambda phase, info: runs.append(phase)
    bpe.gc.collect()
    bpe.gc.callbacks.append(watch)
    try:
        encoder.encode([text])
    finally:
        bpe.gc.callbacks.remove(watch)
    assert bpe.gc.isenabled() and len(runs) <= 4
