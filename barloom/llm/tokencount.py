"""Unigram token counts by dynamic programming shared along a trie of pre-tokens.

A pre-token is a word with the mark of a word start before it. Under a unigram model its best
segmentation maximises the sum of piece scores; of equally good ones the one with fewer pieces
counts. The best score of a prefix does not depend on what follows, so the distinct new pre-tokens of a batch form a trie
whose nodes are scored once, from the scores of their ancestors, for all pre-tokens below. The trie is walked depth
first, which is the sorted order of the pre-tokens: only the path to the current node is held, whatever the size of the trie.
Counts at terminal nodes are kept for later batches.

The public vocabulary is an ordered list of pieces without probabilities. Scores follow Zipf's law,
``-ln(place + SHIFT)``; both are parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from barloom.llm.common import bytes_of, decoded, map_batches, utf8

START = "▁"
SHIFT = 10
UNKNOWN_PENALTY = 10.0  # below the rarest piece, for every byte of a character without a piece
KEPT = 400_000  # words whose counts a worker keeps, in each of two generations
LONG = 1_000_000  # longer pre-tokens, mere blobs, are scored without holding their whole path
NO_ENDING = object()


@lru_cache(maxsize=2)
def load_scores(path: str, shift: int = SHIFT) -> dict[str, float]:
    """Pieces of a SentencePiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {piece: -math.log(place + shift) for place, piece in enumerate(usable)}


class Trie:
    """Best scores of the nodes of tries of pre-tokens, with their numbers of tokens."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # Every ending of a piece, with the score of those that are pieces: a walk back from a place ends at the first
        # text that no piece ends with.
        self.endings: dict[str, float | None] = dict.fromkeys(
            (piece[at:] for piece in scores for at in range(len(piece)))) | scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.nodes = 0  # scored so far

    def _best(self, token: str, end: int, scores: list[float], tokens: list[int], shift: int) -> tuple[float, int]:
        """Best score of the prefix of length ``end`` and its tokens; ``scores[i - shift]`` is that of length i."""
        best, fewest, endings = -math.inf, 0, self.endings
        for start in range(end - 1, -1, -1):
            gain = endings.get(token[start:end], NO_ENDING)
            if gain is NO_ENDING:
                break
            if gain is not None:
                score, count = scores[start - shift] + gain, tokens[start - shift] + 1
                if score > best or score == best and count < fewest:
                    best, fewest = score, count
        char = token[end - 1]
        if char not in self.scores:
            size = len(char.encode("utf-8"))
            score, count = scores[end - 1 - shift] + self.unknown * size, tokens[end - 1 - shift] + size
            if score > best or score == best and count < fewest:
                best, fewest = score, count
        return best, fewest

    def walk(self, tokens: list[str]) -> Iterator[int]:
        """Tokens of sorted pre-tokens, in their order."""
        before, scores, counts = "", [0.0], [0]
        for token in tokens:
            if len(token) > LONG:
                yield self._roll(token)
                continue
            shared, least = 0, min(len(before), len(token))
            while shared < least and before[shared] == token[shared]:
                shared += 1
            del scores[shared + 1:], counts[shared + 1:]
            for end in range(shared + 1, len(token) + 1):
                best, fewest = self._best(token, end, scores, counts, 0)
                scores.append(best)
                counts.append(fewest)
            self.nodes += len(token) - shared
            before = token
            yield counts[-1]

    def _roll(self, token: str) -> int:
        scores, counts, shift = [0.0], [0], 0
        for end in range(1, len(token) + 1):
            best, fewest = self._best(token, end, scores, counts, shift)
            scores.append(best)
            counts.append(fewest)
            if len(scores) > 4 * self.longest:
                cut = len(scores) - self.longest
                del scores[:cut], counts[:cut]
                shift += cut
        return counts[-1]


class Counts:
    """Tokens of words, with the counts of recent ones: what is used again when a generation is full moves on to the next."""

    def __init__(self, trie: Trie) -> None:
        self.trie, self.young, self.old = trie, {}, {}

    def totals(self, texts: list[list[bytes]]) -> list[int]:
        """Tokens of texts given by their words."""
        if len(self.young) >= KEPT:
            self.old, self.young = self.young, {}
        fresh = []
        for word in set().union(*texts).difference(self.young):
            known = self.old.get(word)
            if known is None:
                fresh.append(word)
            else:
                self.young[word] = known
        fresh.sort()
        self.young.update(zip(fresh, self.trie.walk([START + decoded(word) for word in fresh])))
        return [sum(map(self.young.__getitem__, words)) for words in texts]


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    return Counts(Trie(load_scores(path)))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, n_tokens`` for every row.

    Defined cases: null and empty texts count 0; a word of any length is one pre-token; equal rows give equal
    results; a null id is kept; an empty table gives an empty result; other columns are ignored.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        counts = _counts(path)
        for batch in batches:
            texts = [data.split() for data in bytes_of(batch, "_text")]  # on bytes: at space and 9-13 only
            words, tokens = list(map(len, texts)), counts.totals(texts)
            yield {id_col: batch.column(0), "n_words": words, "n_tokens": tokens}

    return map_batches(docs.select(id_col, utf8(text_col).alias("_text")), work,
                       f"`{id_col}` {kind}, n_words long, n_tokens long")
