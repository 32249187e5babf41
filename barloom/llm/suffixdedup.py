"""Removal of repeated 100-byte passages by suffix arrays over shards of the corpus.

A byte goes if it lies in a string of `LENGTH` bytes that also starts earlier: in a document with a smaller id, or before in
the same document. Shards are cut by content, so that equal strings always meet:

1. Every window of LENGTH bytes has an anchor, the GRAM-byte piece in it with the smallest hash (a minimizer). Equal
   windows have equal anchors. The runs of windows around an anchor are short texts of at most 2 * LENGTH - GRAM bytes. Hashes
   of anchors and of run texts are shuffled, packed by batch. A run whose anchor occurs once cannot repeat. Of runs with equal
   texts (anchor and text hash, 128 bits) only the first is looked at further; the windows of the others are repeats.
2. First runs whose anchor also has other texts are dealt to shards by the anchor's hash.
3. A shard's texts are joined and sorted by induced sorting with common-prefix values (`suffixsort`). Neighbours that
   share LENGTH symbols are equal windows; all but the earliest are repeats.
   Hot anchors (HOT_RUNS runs or more) take neither step 2 nor the verdicts of step 1, as all their runs would meet in one task:
   their windows are dealt one by one, by the window's own 128-bit hash, the earliest of each batch only. A first pass counts
   anchors, by batch those with COUNTED runs or more. So an anchor that is not hot has fewer than
   HOT_RUNS + COUNTED * batches runs.
4. Repeats go back to their documents, where overlapping ones are united and the rest of the text is kept.

The texts are shuffled once, by document; both visits to the documents read that shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from barloom.llm import suffixsort
from barloom.llm.common import bytes_of, map_batches, quoted, returning, utf8

LENGTH = 100
GRAM = 32
PIECE = 1 << 20  # bytes of text searched for anchors at once
PART_BYTES = 32 << 20  # of input text for every partition
SHARDS = 4  # for every partition, sorted one after another
HOT_RUNS = 1 << 10  # an anchor with so many counted runs is hot
COUNTED = 8  # runs of an anchor in one batch from which on they are counted
BATCH_WINDOWS = 1 << 18  # hot windows remembered at once
DIGEST = 16  # bytes of the hash of a hot window; texts of runs are longer
NO_ID = (1 << 63) - 1  # rows without an id come last

_RANDOM = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from every place, by joining halves."""
    value, width, factor = _RANDOM[data], 1, int(_STEP)
    while width < gram:
        value = value[:-width] * np.uint64(factor) + value[width:]
        value ^= value >> np.uint64(29)
        factor, width = (factor * factor | 1) % (1 << 64), 2 * width
    return value * _STEP


def anchor_runs(data: np.ndarray, usable: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: first window, number of windows, anchor hash.

    ``usable`` marks the places where a whole window of one document starts.
    """
    hashes = gram_hashes(data, gram)
    bits = np.uint64(max(1, len(hashes)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, want = 1, length - gram + 1
    while 2 * width <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < want:
        best = np.minimum(best[:width - want], best[want - width:])
    usable = usable[:len(best)]
    anchor = (best & low).astype(np.int64)
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (usable[1:] != usable[:-1])])
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, len(anchor)))
    good = usable[starts]
    starts, counts = starts[good], counts[good]
    return starts, counts, hashes[anchor[starts]]


def _document_runs(texts: list[bytes]):
    """Anchor runs of many texts: number of the text, first window, number of windows, anchor hash."""
    group, size = [], 0

    def flush():
        if not group:
            return None
        data = np.frombuffer(b"".join(text for _, _, text in group), np.uint8)
        sizes = np.array([len(text) for _, _, text in group])
        ends = np.cumsum(sizes)
        usable = np.zeros(len(data), bool)
        owner = np.repeat(np.arange(len(group)), sizes)
        usable[:] = np.arange(len(data)) + LENGTH <= ends[owner]
        starts, counts, hashes = anchor_runs(data, usable)
        own = owner[starts]
        numbers = np.array([number for number, _, _ in group])
        offsets = np.array([offset for _, offset, _ in group]) - (ends - sizes)
        return numbers[own], starts + offsets[own], counts, hashes

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            piece = text[at:at + PIECE + LENGTH - 1]
            if size + len(piece) > PIECE and group:
                yield flush()
                group, size = [], 0
            group.append((number, at, piece))
            size += len(piece)
    if group:
        yield flush()


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """``_id, _tie, _own, _text`` and with ``keep`` the other columns as ``row``.

    Rows with equal ids and texts are one document; other rows with equal ids go by a hash of their text.
    """
    others = [F.col(quoted(name)) for name in docs.columns if name != text_col]
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.hash(utf8(text_col)).alias("_tie"),
        F.col(id_col).alias("_own"), utf8(text_col).alias("_text"),
        *([F.struct(F.col(text_col).isNull().alias("_null"), *others).alias("row")] if keep else []))


def _hot_anchors(keyed: DataFrame) -> np.ndarray:
    """Sorted hashes of the hot anchors; there is at most one for every HOT_RUNS runs of the table."""
    counted = COUNTED

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            parts = [np.unique(value, return_counts=True) for *_, value in _document_runs(bytes_of(batch, "_text"))]
            if not parts:
                continue
            anchors, own = np.unique(np.concatenate([part[0] for part in parts]), return_inverse=True)
            runs = np.bincount(own, np.concatenate([part[1] for part in parts])).astype(np.int64)
            often = runs >= counted
            if often.any():
                yield {"anchor": anchors[often].view(np.int64), "runs": runs[often]}

    found = (
        map_batches(keyed.select("_text"), work, "anchor long, runs long")
        .groupBy("anchor").agg(F.sum("runs").alias("runs")).where(F.col("runs") >= HOT_RUNS).select("anchor").collect()
    )
    return np.sort(np.array([row[0] for row in found], np.int64).view(np.uint64))


def _among(value: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(value), bool)
    return hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value


def _packed_runs(keyed: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """``bucket, docs, runs``: a batch's documents (id, tie, number of runs) and their runs for one bucket, in order.

    Runs of hot anchors are left out; documents that have some also come with no runs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = bytes_of(batch, "_text")
            for number, start, count, value in _document_runs(texts):
                warm = _among(value, hot)
                if warm.any():
                    used = np.unique(number[warm])
                    docs = np.zeros(len(used), DOC)
                    docs["id"], docs["tie"] = ids[used], ties[used]
                    yield {"bucket": [int(value[0] % np.uint64(buckets))], "docs": [docs.tobytes()], "runs": [b""]}
                    number, start, count, value = number[~warm], start[~warm], count[~warm], value[~warm]
                runs = np.empty(len(number), RUN)
                runs["anchor"] = value
                runs["text"] = _text_hashes(texts, number, start, count)
                bucket = ((value >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                names, begins = np.unique(bucket[order], return_index=True)
                for name, a, b in zip(names.tolist(), begins, [*begins[1:], len(order)]):
                    own = order[a:b]
                    used, counts = np.unique(number[own], return_counts=True)
                    docs = np.empty(len(used), DOC)
                    docs["id"], docs["tie"], docs["runs"] = ids[used], ties[used], counts
                    yield {"bucket": [name], "docs": [docs.tobytes()], "runs": [runs[own].tobytes()]}

    return map_batches(keyed.select("_id", "_tie", "_text"), work, "bucket int, docs binary, runs binary")


RUN = np.dtype([("anchor", np.uint64), ("text", np.uint64)])
DOC = np.dtype([("id", np.int64), ("tie", np.int32), ("runs", np.uint32)])
FIRST_ALONE, FIRST, GONE, HOT = 0, 1, 2, 3


def _text_hashes(texts: list[bytes], number: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    digest, more = xxhash.xxh3_64_intdigest, LENGTH - 1
    return np.array([digest(texts[k][a:a + c + more])
                     for k, a, c in zip(number.tolist(), start.tolist(), count.tolist())], np.uint64)


def _verdicts(table: pa.Table) -> pa.Table:
    """Runs of one bucket whose anchor occurs more than once: by document and text, what is known of them.

    GONE: the text occurs in an earlier document. FIRST: the document's first run of that text is the first of all, and
    the anchor has other texts too. FIRST_ALONE: it is the first, and there are no others. HOT, with text 0: the document
    has runs of hot anchors.
    """
    runs, ids, ties, marks = [np.empty(0, RUN)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, DOC)]
    for docs, own in zip(table.column("docs").to_pylist(), table.column("runs").to_pylist()):
        docs = np.frombuffer(docs, DOC)
        if not own:
            marks.append(docs)
            continue
        runs.append(np.frombuffer(own, RUN))
        ids.append(np.repeat(docs["id"], docs["runs"]))
        ties.append(np.repeat(docs["tie"], docs["runs"]))
    runs, ids, ties = np.concatenate(runs), np.concatenate(ids), np.concatenate(ties)
    order = np.argsort(runs["anchor"], kind="stable")
    value = runs["anchor"][order]
    same = value[1:] == value[:-1]
    kept = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    runs, ids, ties = runs[kept], ids[kept], ties[kept]
    order = np.lexsort((ties, ids, runs["text"], runs["anchor"]))
    anchor, text, ids, ties = runs["anchor"][order], runs["text"][order], ids[order], ties[order]
    new = np.ones(len(order), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    group = np.cumsum(new) - 1
    fresh = new.copy()
    fresh[1:] |= text[1:] != text[:-1]
    other = fresh.copy()
    other[1:] |= (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    several = np.bincount(group[fresh], minlength=1)[group] > 1 if len(order) else fresh
    verdict = np.where(fresh, np.where(several, FIRST, FIRST_ALONE), GONE)[other]
    mark = np.unique(np.concatenate(marks))
    return pa.table({"_id": np.append(ids[other], mark["id"]), "_tie": np.append(ties[other], mark["tie"]),
                     "text": np.append(text[other].view(np.int64), np.zeros(len(mark), np.int64)),
                     "verdict": np.append(verdict, np.full(len(mark), HOT)).astype(np.int8)})


PLACE = np.dtype([("id", np.int64), ("tie", np.int32), ("start", np.int64), ("count", np.int64)])


def _segments(texts: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """``shard, texts, sizes, places``: first run texts for one shard with their places, hashes of windows of hot anchors as
    texts of DIGEST bytes, and spans known to be repeats as places of size 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            ids, ties = batch.column("_id").to_pylist(), batch.column("_tie").to_pylist()
            # in order of the documents, so that the first window of its kind is the earliest of the batch
            order = sorted(range(len(ids)), key=lambda k: (ids[k], ties[k]))
            ids, ties = [ids[k] for k in order], [ties[k] for k in order]
            data, verdicts = bytes_of(batch, "_text"), batch.column("verdicts").to_pylist()
            data = [data[k] for k in order]
            known = [{v["text"]: v["verdict"] for v in verdicts[k] if v["verdict"] != HOT} for k in order]
            out: dict[int, tuple[list, list, list]] = {}
            windows: dict[bytes, tuple] = {}  # of hot anchors: first place
            whole: dict[tuple, tuple] = {}  # runs of hot anchors: first place
            span = None  # repeats of one document that touch are sent as one

            def send(shard: int, text: bytes, place: tuple) -> None:
                own = out.setdefault(shard, ([], [], []))
                own[0].append(text)
                own[1].append(len(text))
                own[2].append(place)

            def flush() -> None:
                if span is not None:
                    send(span[0] % shards, b"", (span[0], span[1], span[2], span[3] - span[2] - LENGTH + 1))

            def packed() -> Iterator[dict[str, object]]:
                for shard, (own, sizes, places) in out.items():
                    yield {"shard": [shard], "texts": [b"".join(own)], "sizes": [np.array(sizes, np.uint8).tobytes()],
                           "places": [np.array(places, PLACE).tobytes()]}
                out.clear()

            def gone(k: int, a: int, c: int) -> None:
                nonlocal span
                if span is not None and span[:2] == (ids[k], ties[k]) and span[2] <= a <= span[3]:
                    span = (*span[:3], max(span[3], a + c + LENGTH - 1))
                else:
                    flush()
                    span = (ids[k], ties[k], a, a + c + LENGTH - 1)

            for number, start, count, value in _document_runs(data):
                warm = _among(value, hot).tolist()
                hashes = _text_hashes(data, number, start, count).view(np.int64).tolist()
                anchors = ((value >> np.uint64(20)) % np.uint64(shards)).tolist()
                for k, a, c, text, shard, own, heat in zip(number.tolist(), start.tolist(), count.tolist(), hashes, anchors,
                                                           value.tolist(), warm):
                    if heat:
                        place = (ids[k], ties[k], a)
                        first = whole.setdefault((own, text), place)
                        if first != place:
                            gone(k, a, c)
                            continue
                        for at in range(a, a + c):
                            digest, place = xxhash.xxh3_128_digest(data[k][at:at + LENGTH]), (ids[k], ties[k], at)
                            first = windows.setdefault(digest, place)
                            if first != place:
                                gone(k, at, 1)
                            else:
                                send(int.from_bytes(digest[:8]) % shards, digest, (*place, 1))
                        if len(windows) >= BATCH_WINDOWS:
                            windows.clear()
                            whole.clear()
                            yield from packed()
                        continue
                    verdict = known[k].get(text)
                    if verdict is None:
                        continue
                    if verdict == GONE:
                        gone(k, a, c)
                        continue
                    known[k][text] = GONE  # from here on
                    if verdict == FIRST:
                        send(shard, data[k][a:a + c + LENGTH - 1], (ids[k], ties[k], a, c))
            flush()
            yield from packed()

    return map_batches(texts, work, "shard int, texts binary, sizes binary, places binary")


def repeats_of(texts: list[bytes], places: np.ndarray, memory: int = suffixsort.MEMORY,
               names_in_memory: int = suffixsort.IN_MEMORY_NAMES) -> tuple[np.ndarray, np.ndarray]:
    """Windows of distinct texts that are not the earliest of their kind: text number and offset."""
    sizes = np.array([len(text) for text in texts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    whole = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.uint16) + 2
    whole[begins[1:] - 1] = 1
    whole[-1] = 0
    bad_text, bad_offset, group = [], [], []

    def close() -> None:
        at = np.concatenate(group) if len(group) > 1 else group[0]
        group.clear()
        if len(at) < 2:
            return
        text = np.searchsorted(begins, at, side="right") - 1
        offset = at - begins[text]
        inside = offset + LENGTH <= sizes[text]  # others share symbols only across the end of their text
        text, offset = text[inside], offset[inside]
        order = np.lexsort((places["start"][text] + offset, places["tie"][text], places["id"][text]))[1:]
        bad_text.append(text[order])
        bad_offset.append(offset[order])

    for batch in suffixsort.induced(whole, LENGTH, memory, names_in_memory):
        fresh = np.flatnonzero(batch["lcp"] < LENGTH)
        cuts = [0, *fresh.tolist(), len(batch)] if not len(fresh) or fresh[0] else [*fresh.tolist(), len(batch)]
        # only ends and groups of two or more matter
        lengths = np.diff(cuts)
        for k in np.flatnonzero((lengths > 1) | (np.arange(len(lengths)) == 0) | (np.arange(len(lengths)) == len(lengths) - 1)):
            part = batch["at"][cuts[k]:cuts[k + 1]]
            if not len(part):
                continue
            if group and batch["lcp"][cuts[k]] < LENGTH:
                close()
            group.append(part)
            if k < len(lengths) - 1:
                close()
    if group:
        close()
    if not bad_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(bad_text), np.concatenate(bad_offset)


def _spans(number: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows as (text number, first offset, end of the last window)."""
    order = np.lexsort((offset, number))
    number, offset = number[order], offset[order]
    head = np.concatenate([[True], (number[1:] != number[:-1]) | (offset[1:] > offset[:-1] + 1)])
    begins = np.flatnonzero(head)
    lasts = np.append(begins[1:], len(offset)) - 1
    return number[begins], offset[begins], offset[lasts] + LENGTH


def _shard_repeats(sorted_: DataFrame) -> DataFrame:
    """``_id, _tie, start, stop``: spans to remove, from rows that come shard by shard."""

    def finish(known: dict[bytes, tuple], gone: list[tuple]) -> Iterator[dict[str, object]]:
        texts = [text for text in known if len(text) > DIGEST]  # distinct hashes are distinct windows
        if texts:
            places = np.array([known[text] for text in texts], PLACE)
            number, offset = repeats_of(texts, places)
            if len(number):
                text, first, stop = _spans(number, offset)
                own = places[text]
                yield {"_id": own["id"], "_tie": own["tie"], "start": own["start"] + first, "stop": own["start"] + stop}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        shard, known = None, {}
        for batch in batches:
            gone: list[tuple] = []
            for name, texts, sizes, places in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if name != shard:
                    yield from finish(known, gone)
                    shard, known = name, {}
                at = 0
                for size, place in zip(sizes, np.frombuffer(places, PLACE).tolist()):
                    if not size:
                        gone.append(place)
                        continue
                    text = texts[at:at + size]
                    at += size
                    first = known.setdefault(text, place)
                    if first is not place:
                        if place < first:
                            known[text], place = place, first
                        if place != first or known[text] != first:
                            gone.append(place)
            if gone:
                own = np.array(gone, PLACE)
                yield {"_id": own["id"], "_tie": own["tie"], "start": own["start"],
                       "stop": own["start"] + own["count"] + LENGTH - 1}
        yield from finish(known, [])

    return map_batches(sorted_, work, "_id long, _tie int, start long, stop long")


def _without(texts: DataFrame, keep: bool) -> DataFrame:
    """Unites the spans of every text and cuts them out; adds ``n_bytes, n_removed, n_spans, kept``.

    With ``keep`` the bytes before stay too, and what is left of parted characters goes.
    """
    names = [name for name in texts.columns if name not in ("_id", "_tie", "spans") and (keep or name != "_text")]
    schema = StructType([texts.schema[name] for name in names])
    for name, kind in (("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept", BinaryType())):
        schema = schema.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            removed, runs, kept, total = [], [], [], []
            for text, spans in zip(bytes_of(batch, "_text"), batch.column("spans").to_pylist()):
                parts, at, gone, count = [], 0, 0, 0
                stop = -1
                for span in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if span[0] > stop:
                        if stop >= 0:
                            gone += stop - begin
                            at = stop
                        parts.append(text[at:span[0]])
                        begin, stop, count = span[0], span[1], count + 1
                    else:
                        stop = max(stop, span[1])
                if stop >= 0:
                    gone, at = gone + stop - begin, stop
                parts.append(text[at:])
                removed.append(gone)
                runs.append(count)
                total.append(len(text))
                left = b"".join(parts)
                kept.append(left if not keep or not count else left.decode("utf-8", "ignore").encode("utf-8"))
            yield {**{name: batch.column(name) for name in names}, "n_bytes": total, "n_removed": removed,
                   "n_spans": runs, "kept": kept}

    return map_batches(texts, work, schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``_own`` (the id), ``n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for every row; with ``keep`` also ``row``,
    the other columns, and ``_text``, the bytes before.

    Defined cases: a null or empty text has nothing to remove; texts shorter than LENGTH neither; rows that repeat id and
    text are one document and get equal results; other rows with equal ids go by a hash of their text; rows without an id
    come last; an empty table gives an empty result; other columns, of any name, are only carried in ``row``.
    """
    keyed = _keyed(docs, id_col, text_col, keep)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-size // PART_BYTES))
    dealt = _dealt(keyed, parts)
    spans = (
        _shard_repeats(dealt.repartition(parts, "shard").sortWithinPartitions("shard"))
        .groupBy("_id", "_tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )
    return _without(keyed.join(spans, ["_id", "_tie"], "left"), keep)


def _dealt(keyed: DataFrame, parts: int) -> DataFrame:
    """What the shards get, see ``_segments``."""
    hot = _hot_anchors(keyed)
    verdicts = (
        _packed_runs(keyed, parts, hot).repartition(parts, "bucket").groupBy("bucket")
        .applyInArrow(returning(_verdicts), "_id long, _tie int, text long, verdict tinyint")
        .groupBy("_id", "_tie").agg(F.collect_list(F.struct("text", "verdict")).alias("verdicts"))
    )
    # The same columns of the same side in both joins, so that Spark shuffles the texts once.
    return _segments(keyed.join(verdicts, ["_id", "_tie"]), SHARDS * parts, hot)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and hash of what is left of every document."""
    return cut_repeats(docs, id_col, text_col).select(
        F.col("_own").alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeats cut out of their texts; rows of which nothing is left go.

    A cut may part a character; what is left of it is dropped, so that texts stay valid. Rows whose text was null or empty
    before are kept as they are. ``size_col``, if there, follows the text.
    """
    cut_ = cut_repeats(docs, id_col, text_col, keep=True)
    changed = F.col("n_removed") > 0
    text = F.when(~F.col("row._null"), F.when(changed, F.col("kept")).otherwise(F.col("_text")).cast("string"))
    own = {text_col: text.alias(text_col)}
    if size_col in docs.columns:
        own[size_col] = F.when(changed, F.length(text).cast(docs.schema[size_col].dataType)).otherwise(
            F.col("row")[size_col]).alias(size_col)
    return cut_.where(~changed | (F.length("kept") > 0)).select(
        *[own[name] if name in own else F.col("row")[name].alias(name) for name in docs.columns])
