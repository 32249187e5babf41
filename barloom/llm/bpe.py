"""Byte-level BPE by a hierarchical-bitmap rank queue.

Every merge rank has a bucket of positions of a linked list over bytes. A bitmap over the ranks, with a bitmap over its
words, tells by find-first-set which bucket is next. A merge changes two neighbouring pairs; their new ranks are
entered and the old entries stay where they are, to be skipped when they come up and no longer describe their position. The
work is O(n) queue steps for n bytes, so very long pre-tokens are no special case; for the same reason all new pre-tokens of
a batch share one list, with borders that no merge crosses, and one queue.
"""

from __future__ import annotations

import base64
import gc
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import decoded, map_batches, utf8

CHUNKS, TOKENS = 100_000, 250_000  # kept by a worker in each of two generations
LISTED = 1 << 20  # bytes; longer lists are packed to save memory
PORTION = 1 << 20  # characters of texts that are split at once, and 16 times the ids decoded at once; a longer text passes whole


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one ``base64(bytes) rank`` per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Kept(dict):
    """A cache of two generations: what is used again when a generation is full moves on to the next one."""

    def __init__(self, bound) -> None:
        super().__init__()
        self.bound, self.older = bound, {}

    def turn(self) -> None:
        if len(self) >= self.bound():
            self.older = dict(self)
            self.clear()

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that neither generation has; those of the older one are taken over."""
        fresh = [key for key in keys if key not in self]
        found = {key: self.older[key] for key in fresh if key in self.older}
        self.update(found)
        return [key for key in fresh if key not in found]


BLANKS = [chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace()]
ASCII_GLUED, GLUED = ([pair for blank in BLANKS if blank < end for pair in dict.fromkeys((blank + " ", " " + blank))]
                      for end in ("\x80", "\U0010ffff"))


def glued(text: str) -> bool:
    """Whether white space stands beside a space, or a space at an end; a few searches for fixed strings beat one pattern."""
    if text[:1] == " " or text[-1:] == " ":
        return True
    for pair in ASCII_GLUED if text.isascii() else GLUED:
        if pair in text:
            return True
    return False


class Encoder:
    """Encodes texts with the ranks of a file; keeps the packed ids of frequent chunks and pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        # Python's integers may be as wide as the root of the number of ranks, so two levels are enough.
        self.shift = max(1, max(self.ranks.values(), default=1).bit_length() + 1 >> 1)
        self.single = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int32)
        self.double = np.full(1 << 16, -1, np.int32)
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                self.double[piece[0] << 8 | piece[1]] = rank
        self.tokens, self.chunks = Kept(lambda: TOKENS), Kept(lambda: CHUNKS)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of ids of each. Pieces must not be empty."""
        data = b"".join(pieces)
        size = len(data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(data, np.uint8)
        border = np.zeros(size + 1, bool)  # a piece starts, or the data end
        border[starts] = border[size] = True
        first = self.double[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        first[border[1:-1]] = -1

        listed = (lambda a: a.tolist()) if size <= LISTED else (lambda a: array("q", a.astype(np.int64).tobytes()))
        end = listed(np.arange(1, size + 1))  # of the part that starts here
        before = listed(np.where(border[:-1], -1, np.arange(-1, size - 1)))  # start of the part before
        pair = listed(np.append(first, -1))  # rank of the part with the next one; -1: none, or merged away
        ident = listed(self.single[raw])  # id of the part that starts here
        border = border.tobytes()

        rank_of, shift, mask = self.ranks.get, self.shift, (1 << self.shift) - 1
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        names, begins = np.unique(first[order], return_index=True)
        for rank, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)]):
            buckets[rank] = order[a:b].tolist()
            words[rank >> shift] = words.get(rank >> shift, 0) | 1 << (rank & mask)
            top |= 1 << (rank >> shift)

        while top:
            high = top & -top
            word = high.bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = (word << shift) + low.bit_length() - 1
            words[word] = bits ^ low
            if bits == low:
                top ^= high
            bucket = buckets.pop(rank)
            bucket.sort()  # leftmost first
            lower = False
            for turn, at in enumerate(bucket, 1):
                if pair[at] != rank:
                    continue  # stale
                gone = end[at]
                stop = end[gone]
                end[at], ident[at], ident[gone] = stop, rank, -1
                pair[gone] = pair[at] = -1
                left = before[at]
                if not border[stop]:
                    before[stop] = at
                    fresh = rank_of(data[at:end[stop]])
                    if fresh is not None:
                        pair[at] = fresh
                        if fresh in buckets:
                            buckets[fresh].append(at)
                        else:
                            buckets[fresh] = [at]
                            word = fresh >> shift
                            words[word] = words.get(word, 0) | 1 << (fresh & mask)
                            top |= 1 << word
                            lower = fresh < rank
                if left >= 0:
                    fresh = rank_of(data[left:stop])
                    if fresh is None:
                        pair[left] = -1
                    else:
                        pair[left] = fresh
                        if fresh in buckets:
                            buckets[fresh].append(left)
                        else:
                            buckets[fresh] = [left]
                            word = fresh >> shift
                            words[word] = words.get(word, 0) | 1 << (fresh & mask)
                            top |= 1 << word
                            lower = lower or fresh < rank
                if lower:  # a smaller rank goes first; the rest waits
                    if turn < len(bucket):
                        buckets[rank] = bucket[turn:]
                        word = rank >> shift
                        words[word] = words.get(word, 0) | 1 << (rank & mask)
                        top |= 1 << word
                    break
        ids = np.array(ident, np.int64)
        alive = ids >= 0
        return ids[alive].astype(np.int32), np.add.reduceat(alive, starts) if size else np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Work out the ids of new chunks."""
        split = [self.split(chunk) for chunk in chunks]
        known, rank_of = self.tokens, self.ranks.get
        known.turn()
        new, pieces = [], []
        for token in known.missing({token for tokens in split for token in tokens}):
            piece = token.encode("utf-8")
            whole = rank_of(piece)
            if whole is None:
                new.append(token)
                pieces.append(piece)
            else:
                known[token] = whole.to_bytes(4, "little")
        if pieces:
            ids, counts = self.merge(pieces)
            packed, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            for token, a, b in zip(new, [0, *ends], ends):
                known[token] = packed[a:b]
        for chunk, tokens in zip(chunks, split):
            self.chunks[chunk] = known[tokens[0]] if len(tokens) == 1 else b"".join(map(known.__getitem__, tokens))

    def cut(self, text: str) -> list[str]:
        """Chunks whose ends are also ends of pre-tokens.

        Where a single space stands between two characters that are not white space, the pattern always begins a
        new pre-token with the space, so texts are cut there.
        """
        chunks = text.split(" ")
        chunks[1:] = [" " + chunk for chunk in chunks[1:]]
        if not glued(text):
            return chunks
        whole = chunks[:1]
        for chunk in chunks[1:]:
            if len(chunk) == 1 or chunk[1].isspace() or not whole[-1] or whole[-1][-1].isspace():
                whole[-1] += chunk
            else:
                whole.append(chunk)
        return whole

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of whole texts."""
        self.chunks.turn()
        cut = [self.cut(text) for text in texts]
        new = self.chunks.missing({chunk for chunks in cut for chunk in chunks})
        if new:
            collects = gc.isenabled()
            gc.disable()  # it makes very many lists, none of them in a cycle
            try:
                self.learn(new)
            finally:
                if collects:
                    gc.enable()
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in cut]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces one after another, and the start and length of each rank's piece."""
    ranks = load_ranks(path)
    lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    for piece, rank in ordered:
        lengths[rank] = len(piece)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int32)
    return np.frombuffer(b"".join(piece for piece, _ in ordered), np.uint8), starts, lengths


def decode_ids(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids one after another, and where each id's bytes end."""
    letters, starts, lengths = _pieces(path)
    size = lengths[ids]
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(ids), PORTION >> 4):  # the places take many times the bytes that they name
        own, widths, stops = (values[a:a + (PORTION >> 4)] for values in (ids, size, ends))
        first, last = int(stops[0] - widths[0]), int(stops[-1])
        out[first:last] = letters[np.repeat(starts[own] - (stops - widths), widths) + np.arange(first, last)]
    return out, ends


def _portions(texts: Iterator[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(encoder: Encoder, batch: pa.RecordBatch) -> pa.ListArray:
    texts = (decoded(data.as_py()) for data in batch.column("_text"))
    lists = [packed for portion in _portions(texts) for packed in encoder.encode(portion)]
    ends = np.cumsum([0, *(len(packed) // 4 for packed in lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(lists), np.int32)))


def _decoded(ids: pa.ListArray, path: str) -> list[bytes]:
    data, ends = decode_ids(ids.flatten().to_numpy(zero_copy_only=False), path)
    rows = np.cumsum([0, *ids.value_lengths().to_pylist()])
    cuts = np.concatenate([[0], ends])[rows].tolist()
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids`` for every row; special tokens are ordinary text.

    Defined cases: null and empty texts give an empty list; equal rows give equal results; a null id
    is kept; an empty table gives an empty result; other columns are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            yield {id_col: batch.column(0), "ids": _encoded(encoder, batch)}

    return map_batches(docs.select(id_col, utf8(text_col).alias("_text")), work,
                       f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Adds ``data``, the bytes that ``ids`` stand for, to ``<id_col>, ids``; null ids give no bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = coded.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            ids = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            yield {id_col: batch.column(0), "ids": ids, "data": _decoded(ids, path)}

    return map_batches(coded.select(id_col, "ids"), work,
                       f"`{id_col}` {kind}, ids array<int>, data binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids, data`` as ``decode(encode(docs))`` gives them, by one Python worker a task instead of two."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            ids = _encoded(encoder, batch)
            yield {id_col: batch.column(0), "ids": ids, "data": _decoded(ids, path)}

    return map_batches(docs.select(id_col, utf8(text_col).alias("_text")), work,
                       f"`{id_col}` {kind}, ids array<int>, data binary")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Round trip of every text as counts and hashes."""
    return round_trip(docs, path, id_col=id_col).select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
