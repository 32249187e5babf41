import public_tokenizers
from tokenizers import Tokenizer, models

from barloom.llm import tokencount
from tests.llm.fixtures import awkward_rows, docs, empty, prose

SCORES = tokencount.load_scores(public_tokenizers.path("piece_bpe_32k.model"))


def test_equals_a_unigram_library():
    other = Tokenizer(models.Unigram([("<unk>", -1e9), *SCORES.items()], unk_id=0))
    trie = tokencount.Trie(SCORES)
    words = sorted(set((prose(8, 3000) + " Größe naïve don't x.y/z 12345 " + "ab" * 90).split()))
    tokens = [tokencount.START + word for word in words]
    assert list(trie.walk(tokens)) == [len(other.encode(token).tokens) for token in tokens]
    assert trie.nodes < sum(map(len, tokens))


def test_order_long_tokens_and_small_generations_change_nothing(monkeypatch):
    trie, token = tokencount.Trie(SCORES), tokencount.START + "theotheronable" * 40
    assert [trie._roll(token)] == list(trie.walk([token]))
    texts = [prose(seed, 200).encode().split() for seed in range(30)]
    whole = tokencount.Counts(trie).totals(texts)
    assert whole == [sum(next(trie.walk([tokencount.START + w.decode()])) for w in words) for words in texts]
    monkeypatch.setattr(tokencount, "KEPT", 5)
    monkeypatch.setattr(tokencount, "LONG", 6)
    small = tokencount.Counts(trie)
    assert [small.totals([words])[0] for words in texts + texts] == whole + whole
    assert len(small.young) <= 200


def test_brute_force_over_all_segmentations():
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "aba": -3.6, "ba": -2.9}
    trie = tokencount.Trie(scores)

    def best(text):
        if not text:
            return (0.0, 0)
        return max((s + scores[text[:k]], n - 1) for k in range(1, len(text) + 1) if text[:k] in scores
                   for s, n in [best(text[k:])])

    for text in ("a", "ab", "aba", "abab", "bababa", "aabbaab"):
        assert list(trie.walk([text])) == [-best(text)[1]]
    assert list(trie.walk(["é"])) == [2]  # bytes of a character without a piece


def test_rows(spark):
    got = tokencount.count_tokens(docs(spark, clashing=True)).collect()
    assert len(got) == len(awkward_rows())
    by_id = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in got}
    assert by_id[3] == by_id[4] == by_id[5] == (0, 0) and by_id[1] == by_id[2] and by_id[8] == (1, by_id[8][1])
    assert tokencount.count_tokens(empty(spark)).count() == 0
