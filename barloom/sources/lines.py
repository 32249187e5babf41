"""Vendor CSV files and ZIP members of mixed headers, delimiters and encodings as one row source.

A file is read in splits by many tasks, quoted line breaks included. First every file's head gives its delimiter and header,
once for each charset that it may be in. Then a task reads a split, from its first line start to the first line start after
it, and finds which charsets decode it and in which state a quote-tracking automaton leaves it: entered outside quotes and
entered inside them. Splits start at line feeds, which are part of no longer character in any charset, so a split decodes
alone. Spark composes these two-valued maps in file order, which tells every split the state it begins in. At last the
splits are read again and parsed: one that begins inside quotes drops the record it begins in, and the task before reads
on until that record ends. Members of archives cannot be entered in the middle and are one split.

Nothing depends on how splits are packed into tasks, and what is wrong with a file is a value of its row, never an error
of the job. No task holds more than a chunk, a record and a batch of rows.
"""

from __future__ import annotations

import codecs
import csv
import re
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from barloom.constants import CSV_CHARSETS, CSV_DELIMITERS, MINUTE_ALIASES
from barloom.functions.normalize import map_headers
from barloom.session import cut

SPLIT_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 20_000
UNITS_PER_TASK = 8  # splits or members, beyond as many as there are shuffle partitions
DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError)
BOM = codecs.BOM_UTF8
CODECS = {"UTF-8": "utf-8", "GB18030": "gb18030"}
LINE = re.compile(rb"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+")


def decoded_path(path: Column) -> Column:
    """File URI with percent escapes resolved."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def csv_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(unit, member, entry, error, size): every matching file below ``root``; only names and sizes are read."""
    path = decoded_path(F.col("path"))
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
        .select(path.alias("unit"), path.alias("member"), F.lit("").alias("entry"), F.lit("").alias("error"),
                F.col("length").alias("size"))
    )


@contextmanager
def open_member(unit: str, entry: str, at: int = 0):
    """Byte stream of a file from a place on, or of an archive's member."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(unit)
    with system.open_input_file(inner) as handle:
        if not entry:
            handle.seek(at)
            yield handle
        else:
            with zipfile.ZipFile(handle) as archive, archive.open(entry) as stream:
                while at > 0:
                    at -= len(stream.read(min(at, CHUNK_BYTES))) or at
                yield stream


def _chunks(stream) -> Iterator[bytes]:
    return iter(lambda: stream.read(CHUNK_BYTES), b"")


def _lines(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines with their ends (any kind of line break), and the place after each."""
    rest = b""
    for chunk in chain(_chunks(stream), [b""]):
        data = rest + chunk
        lines = LINE.findall(data)
        # The last line may go on, and a carriage return may be half a line break.
        rest = lines.pop() if chunk and lines and not lines[-1].endswith(b"\n") else b""
        for line in lines:
            at += len(line)
            yield at, line


def _dealt(frame: DataFrame, units: int, *keys: str) -> DataFrame:
    """Rows that stand for work, dealt by key. The number of tasks is given, as adaptive planning sees only how small the rows
    are and would put them into one task."""
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(least, units // UNITS_PER_TASK), *keys)


# --- heads -----------------------------------------------------------------------------------


def _head(unit: str, entry: str, codec: str) -> tuple[str, int, list[str]] | None:
    """Delimiter, end of the header and its cells as one charset reads them; None if it can't."""
    end = 0
    with open_member(unit, entry) as stream:
        def lines() -> Iterator[str]:
            nonlocal end
            for end, line in _lines(stream, 0):
                if end == len(line) and codec == "utf-8":
                    line = line.removeprefix(BOM)
                yield line.decode(codec)

        try:
            own = lines()
            lead = next((line for line in own if line.strip()), "").lstrip()
            sep = max(CSV_DELIMITERS, key=lambda mark: (lead.count(mark), -CSV_DELIMITERS.index(mark)))
            records = csv.reader(chain([lead] if lead else [], own), delimiter=sep)
            header = next((cells for cells in records if any(cell.strip() for cell in cells)), [])
        except UnicodeDecodeError:
            return None
    return sep, end, header


_HEAD = "struct<sep:string,begin:bigint,found:array<string>,header:array<string>>"
_HEAD_COLUMNS = [f"head_{i}" for i in range(len(CSV_CHARSETS))]


def _heads(members: DataFrame, aliases) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row |= {name: None for name in _HEAD_COLUMNS}
                if row["error"]:
                    continue
                try:
                    for name, charset in zip(_HEAD_COLUMNS, CSV_CHARSETS):
                        if head := _head(row["unit"], row["entry"], CODECS[charset]):
                            sep, begin, header = head
                            row[name] = {"sep": sep, "begin": begin, "header": header,
                                         "found": sorted(map_headers(header, aliases).values())}
                except DAMAGE:
                    row["error"] = "damaged member"
                except (OSError, csv.Error) as exc:
                    row["error"] = f"unreadable: {type(exc).__name__}"
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    schema = ("unit string, member string, entry string, error string, size bigint, "
              + ", ".join(f"{name} {_HEAD}" for name in _HEAD_COLUMNS))
    shape = _arrow(schema)
    rows = members.select("unit", "member", "entry", "error", "size")
    return _dealt(rows, members.count(), "unit", "entry").mapInArrow(read, schema)


def _arrow(schema: str) -> pa.Schema:
    """On the driver only: parsing a schema needs the session."""
    return to_arrow_schema(_parse_datatype_string(schema))


# --- the automaton ---------------------------------------------------------------------------

OUTSIDE, WITHIN, QUOTED, CLOSING = range(4)  # before a cell, in a bare cell, in quotes, after a quote in quotes
_TO_LONE_QUOTE = re.compile(r'[^"]*+(?:""[^"]*+)*+')


def advance(text: str, state: int, sep: str) -> int:
    """State of the quote automaton after a text. A quote opens only where a cell begins; inside, two are one character."""
    at, size = 0, len(text)
    ends = sep + "\r\n"
    opening = re.compile(f'[{re.escape(ends)}]"')
    while at < size:
        if state == QUOTED:
            at = _TO_LONE_QUOTE.match(text, at).end()
            if at < size:
                state, at = CLOSING, at + 1
        elif state == CLOSING:
            state, at = (QUOTED if text[at] == '"' else OUTSIDE if text[at] in ends else WITHIN), at + 1
        elif state == OUTSIDE and text[at] == '"':
            state, at = QUOTED, at + 1
        elif found := opening.search(text, at):
            state, at = QUOTED, found.end()
        else:
            state, at = (OUTSIDE if text[-1] in ends else WITHIN), size
    return state


class _Track:
    """What one charset makes of a split: whether it decodes, and its end states by the state at its start."""

    def __init__(self, charset: str, head: dict | None) -> None:
        self.decoder, self.head, self.ok = codecs.getincrementaldecoder(CODECS[charset])(), head, head is not None
        self.states = [OUTSIDE, QUOTED]

    def feed(self, chunk: bytes, at: int, last: bool = False) -> None:
        if not self.ok:
            return
        try:
            if at < self.head["begin"] and chunk:  # the header, which is read apart
                before = chunk[:self.head["begin"] - at]
                self.decoder.decode(before)
                chunk = chunk[len(before):]
                self.states = [OUTSIDE, OUTSIDE]
            text = self.decoder.decode(chunk, last)
        except UnicodeDecodeError:
            self.ok = False
            return
        if text:
            once = advance(text, self.states[0], self.head["sep"])
            self.states = [once, once if self.states[0] == self.states[1] else advance(text, self.states[1], self.head["sep"])]


def _piece(stream, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the lines that start in ``[start, stop)``; the stream stands at ``max(start - 1, 0)``."""
    at, skipping = max(start - 1, 0), start > 0
    for chunk in _chunks(stream):
        if skipping:
            feed = chunk.find(b"\n")
            if feed < 0:
                at += len(chunk)
                continue
            at, chunk, skipping = at + feed + 1, chunk[feed + 1:], False
            if at >= stop:
                return
        feed = chunk.find(b"\n", max(stop - 1 - at, 0)) if at + len(chunk) >= stop else -1
        if feed >= 0:
            yield at, chunk[:feed + 1]
            return
        yield at, chunk
        at += len(chunk)


def _facts(row: dict) -> dict:
    """Bounds of a split's lines and its tracks."""
    tracks = [_Track(charset, row[name]) for charset, name in zip(CSV_CHARSETS, _HEAD_COLUMNS)]
    first = after = None
    with open_member(row["unit"], row["entry"], max(row["start"] - 1, 0)) as stream:
        for at, chunk in _piece(stream, row["start"], row["stop"]):
            first, after = at if first is None else first, at + len(chunk)
            for track in tracks:
                track.feed(chunk, at)
    for track in tracks:
        track.feed(b"", 0, True)
    inside = lambda state: state == QUOTED
    return {"first": first, "after": after,
            "tracks": [{"ok": track.ok, "out": inside(track.states[0]), "quoted": inside(track.states[1])} for track in tracks]}


def _split_facts(heads: DataFrame, split_bytes: int, units: int) -> DataFrame:
    """One row for every split, with the columns of its member."""
    count = F.when(F.col("entry") == "", F.greatest(F.lit(1), F.ceil(F.col("size") / split_bytes))).otherwise(1).cast("int")
    splits = heads.withColumn("split", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("split").cast("bigint") * split_bytes
    splits = splits.withColumns({
        "start": start, "stop": F.when(F.col("entry") == "", start + split_bytes).otherwise(F.lit((1 << 63) - 1))}).drop("split")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row |= {"first": None, "after": None, "tracks": None}
                if not row["error"]:
                    try:
                        row |= _facts(row)
                    except DAMAGE:
                        row["error"] = "damaged member"
                    except OSError as exc:
                        row["error"] = f"unreadable: {type(exc).__name__}"
                yield pa.RecordBatch.from_pylist([row], schema=shape)

    schema = (", ".join(f"{field.name} {field.dataType.simpleString()}" for field in splits.schema)
              + ", first bigint, after bigint, tracks array<struct<ok:boolean,out:boolean,quoted:boolean>>")
    shape = _arrow(schema)
    return _dealt(splits, units, "unit", "entry", "start").mapInArrow(read, schema)


def file_formats(members: DataFrame, aliases=MINUTE_ALIASES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Per member: what is wrong with it (or ``''``), its charset, delimiter, canonical columns, header, the place where its
    data begins and its splits with the state each begins in."""
    fixed = {canonical: tuple(names) for canonical, names in aliases.items()}
    members = cut(members)
    units = members.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    facts = _split_facts(_heads(members, fixed), split_bytes, units)
    member = ["unit", "member", "entry"]
    whole = Window.partitionBy(*member)
    decodes = [F.coalesce(F.min(F.col("tracks")[i]["ok"]).over(whole), F.lit(False)) for i in range(len(CSV_CHARSETS))]
    which = F.when(decodes[0], 0)
    for i in range(1, len(CSV_CHARSETS)):
        which = which.when(decodes[i], i)
    facts = facts.withColumn("which", which).withColumn("error", F.max("error").over(whole))

    # A split maps the state it begins in to the one it leaves: the same, the other one, or a fixed one.
    track = F.col("tracks")[F.coalesce("which", F.lit(0))]
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    maps = facts.where(F.col("first").isNotNull() | (F.col("start") == 0)).withColumns({
        "fixed": track["out"] == track["quoted"], "value": track["out"], "turned": track["out"] & ~track["quoted"]})
    maps = maps.withColumn("turns", F.coalesce(F.sum(F.col("turned").cast("int")).over(before), F.lit(0)))
    since = F.last(F.when(F.col("fixed"), F.struct("value", "turns")), ignorenulls=True).over(before)
    maps = maps.withColumn("since", since)
    odd = (F.col("turns") - F.coalesce(F.col("since.turns"), F.lit(0))) % 2 == 1
    maps = maps.withColumn("inside", F.coalesce(F.col("since.value"), F.lit(False)) != odd)

    charset, head = F.lit(None).cast("string"), F.col(_HEAD_COLUMNS[0])
    for i, name in enumerate(CSV_CHARSETS):
        charset = F.when(F.col("which") == i, name).otherwise(charset)
        head = F.when(F.col("which") == i, F.col(_HEAD_COLUMNS[i])).otherwise(head)
    grouped = maps.groupBy(*member).agg(
        F.first("error").alias("error"), F.first(charset).alias("charset"), F.first(head).alias("head"),
        F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "after", "inside"))).alias("splits"))
    error = F.when(F.col("error") != "", F.col("error")).when(
        F.col("charset").isNull(), f"neither {' nor '.join(CSV_CHARSETS)}").otherwise("")
    sound = lambda value, other: F.when(F.col("error") == "", value).otherwise(other)
    none = F.array().cast("array<string>")
    return grouped.withColumn("error", error).select(
        *member, "error", sound(F.col("charset"), "").alias("charset"), sound(F.col("head.sep"), "").alias("sep"),
        sound(F.col("head.found"), none).alias("found"), sound(F.col("head.header"), none).alias("header"),
        F.col("head.begin").alias("begin"), "splits")


def has_columns(formats: DataFrame, required: set[str]) -> DataFrame:
    """Members with the canonical columns their header lacks; ``''`` too for members with an error."""
    wanted = F.array(*[F.lit(name) for name in sorted(required)])
    lacking = F.when(F.col("error") == "", F.array_join(F.array_except(wanted, "found"), ",")).otherwise("")
    return formats.select("member", lacking.alias("missing_columns"))


# --- rows ------------------------------------------------------------------------------------


def _records(row: dict) -> Iterator[list[list[str]]]:
    """Batches of the records that start in a split. A record that a broken file ends in has no cells."""
    start, after, codec = max(row["first"], row["begin"]), row["after"], CODECS[row["charset"]]
    if start >= after:
        return
    batch: list[list[str]] = []
    at = start
    with open_member(row["unit"], row["entry"], start) as stream:
        def lines() -> Iterator[str]:
            nonlocal at
            inside = row["inside"] and start > row["begin"]
            for at, line in _lines(stream, start):
                text = line.decode(codec)
                yield '"' + text if inside else text
                inside = False

        records = csv.reader(lines(), delimiter=row["sep"])
        try:
            if row["inside"] and start > row["begin"]:
                next(records, None)  # what is left of the record that began before
            while at < after and (cells := next(records, None)) is not None:
                if any(cell.strip() for cell in cells):
                    batch.append(cells)
                    if len(batch) == BATCH_ROWS:
                        yield batch
                        batch = []
        except (*DAMAGE, OSError, csv.Error):
            batch.append([])
    yield batch


def parse_rows(formats: DataFrame, aliases=MINUTE_ALIASES) -> DataFrame:
    """(unit, member, block, pos, canonical text columns) of every data record of the sound members.

    ``block`` is the place of the split in its member and ``pos`` counts a split's records. A record that a broken file
    ends in has only nulls, so that the file is found unparsable.
    """
    fixed = {canonical: tuple(names) for canonical, names in aliases.items()}
    columns = list(fixed)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for row in batch.to_pylist():
                places = {canonical: row["header"].index(name) for name, canonical in map_headers(row["header"], fixed).items()}
                pos = 0
                for cells in _records(row):
                    out = [pa.array([row["unit"]] * len(cells), pa.string()), pa.array([row["member"]] * len(cells), pa.string()),
                           pa.array([row["first"]] * len(cells), pa.int64()), pa.array(range(pos, pos + len(cells)), pa.int64())]
                    for name in columns:
                        at = places.get(name, 1 << 30)
                        found = pa.array([record[at] if at < len(record) else "" for record in cells], pa.string())
                        out.append(pc.if_else(pc.equal(found, ""), pa.scalar(None, pa.string()), found))
                    pos += len(cells)
                    yield pa.RecordBatch.from_arrays(out, schema=shape)

    schema = "unit string, member string, block bigint, pos bigint, " + ", ".join(f"{name} string" for name in columns)
    shape = _arrow(schema)
    splits = (
        formats.where(F.col("error") == "")
        .select("unit", "member", "entry", "charset", "sep", "header", "begin", F.explode("splits").alias("split"))
        .select("*", "split.*").drop("split")
    )
    units = formats.agg(F.sum(F.size("splits"))).first()[0] or 0
    return _dealt(splits, units, "unit", "entry", "first").mapInArrow(parse, schema)
