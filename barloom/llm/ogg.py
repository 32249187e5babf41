"""Media columns in Ogg: lossless storing of byte payloads and reading them back.

A file has two logical streams whose pages alternate: `samples` (8-bit samples, one packet per frame of
576 samples) and `notes` (one packet of text after its header). Both begin with a header packet that names
the stream. A page holds up to 255 lacing values; a packet longer than a page goes on in the next one.
The granule position of a sample page is the number of samples that end in it, so its time is
that number over the sample rate.

Reading trusts nothing: it looks for the capture pattern, checks every page's checksum and sequence number,
puts packets together from lacing values, sorts pages by stream serial, and takes times from granule positions.
Broken pages are reported, and packets that miss a part are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import bytes_of, map_batches, utf8

FRAME = 576  # samples of a frame; payloads are padded to whole frames
PAD = b"\xff"
RATE = 8_000  # samples a second
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_POSITION = -1
HEADER = struct.Struct("<4sBBqIIIB")
CHECK_AT = 22
SAMPLES_MAGIC, NOTES_MAGIC = b"PCM8\x00\x01", b"NOTE\x00\x01"
FRAMES_PER_PAGE = 85  # 85 frames of three lacing values fill a page

_MIRROR = bytes(int(f"{value:08b}"[::-1], 2) for value in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 04C11DB7, most significant bit first, from 0 and without final inversion.

    zlib has the mirrored form of the same polynomial, so bytes and the result are mirrored.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, position: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, position, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:CHECK_AT] + struct.pack("<I", page_checksum(whole)) + whole[CHECK_AT + 4:]


def lacing_of(size: int) -> bytes:
    """Values of a packet: 255 for every full segment, then the rest, which may be 0."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, packets: list[bytes], positions: list[int]) -> list[bytes]:
    """Pages of one logical stream. The header packet has the first page to itself."""
    pages: list[bytes] = []
    values, body, position, begun = bytearray(), bytearray(), NO_POSITION, False

    def close(last: bool) -> None:
        nonlocal values, body, position, begun
        flags = (CONTINUED if begun else 0) | (0 if pages else FIRST) | (LAST if last else 0)
        pages.append(page(serial, len(pages), position, flags, bytes(values), bytes(body)))
        begun = bool(values) and values[-1] == 255
        values, body, position = bytearray(), bytearray(), NO_POSITION

    for number, packet in enumerate(packets):
        offset = 0
        for value in lacing_of(len(packet)):
            if len(values) == 255:
                close(False)
            values.append(value)
            body += packet[offset:offset + value]
            offset += value
        position = positions[number]
        if number == 0 or (number % FRAMES_PER_PAGE == 0 and number + 1 < len(packets)):
            close(len(packets) == 1)
    if values or not pages:
        close(True)
    return pages


def mux(payload: bytes, note: bytes) -> bytes:
    """Store a payload of whole frames. Serials come from the payload, so equal payloads give equal files."""
    serial = zlib.crc32(payload)
    frames = [payload[at:at + FRAME] for at in range(0, len(payload), FRAME)]
    head = SAMPLES_MAGIC + struct.pack("<IH", RATE, FRAME)
    samples = stream_pages(serial, [head, *frames], [FRAME * k for k in range(len(frames) + 1)])
    notes = stream_pages(serial ^ 0x5A5A5A5A, [NOTES_MAGIC, note], [0, len(payload)])
    mixed = [samples[0], notes[0]]  # the first pages of all streams come before any other
    later = [notes[1:], samples[1:]]
    for k in range(max(map(len, later))):
        mixed += [own[k] for own in later if k < len(own)]
    return b"".join(mixed)


class Stream:
    """One logical stream while its pages arrive."""

    def __init__(self, serial: int) -> None:
        self.serial, self.next, self.last_position, self.ended = serial, 0, 0, False
        self.packets: list[bytes] = []
        self.times: list[tuple[int, int]] = []  # (packets complete, granule position) of every page that has one
        self.open: list[bytes] | None = None
        self.pages = self.lost = 0

    def add(self, flags: int, position: int, number: int, lacing: bytes, body: bytes) -> None:
        self.pages += 1
        if number != self.next:
            self.lost += 1
            self.open = None
        self.next = number + 1
        parts = self.open if flags & CONTINUED else []
        offset = start = 0
        for value in lacing:
            offset += value
            if value < 255:
                if parts is not None:
                    parts.append(body[start:offset])
                    self.packets.append(b"".join(parts))
                parts, start = [], offset
        if lacing and lacing[-1] == 255:
            if parts is not None:
                parts.append(body[start:offset])
            self.open = parts
        else:
            self.open = None
        if position != NO_POSITION:
            self.last_position = position
            self.times.append((len(self.packets), position))
        self.ended = self.ended or bool(flags & LAST)


def demux(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial, and the number of pages whose checksum is wrong."""
    streams: dict[int, Stream] = {}
    bad = at = 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            break
        _, version, flags, position, serial, number, check, count = HEADER.unpack_from(data, at)
        start = at + HEADER.size + count
        lacing = data[at + HEADER.size:start]
        end = start + sum(lacing)
        whole = data[at:end]
        if version or len(lacing) < count or end > len(data) or \
                page_checksum(whole[:CHECK_AT] + b"\0\0\0\0" + whole[CHECK_AT + 4:]) != check:
            bad += 1
            at += 1  # look for the next capture pattern inside
            continue
        streams.setdefault(serial, Stream(serial)).add(flags, position, number, lacing, data[start:end])
        at = end
    return streams, bad


def read_back(data: bytes) -> dict[str, object]:
    """Payload, note and figures of a stored file."""
    streams, bad = demux(data)
    payload, note, rate, duration, last_times = b"", b"", RATE, 0, []
    for stream in streams.values():
        head, rest = (stream.packets[0], stream.packets[1:]) if stream.packets else (b"", [])
        if head.startswith(SAMPLES_MAGIC):
            rate = struct.unpack_from("<IH", head, len(SAMPLES_MAGIC))[0]
            payload = b"".join(rest)
            duration = stream.last_position
            last_times = [position / rate for _, position in stream.times[1:]]
        elif head.startswith(NOTES_MAGIC):
            note = b"".join(rest)
    packets = sum(len(s.packets) for s in streams.values())
    return {
        "payload": payload, "note": note, "streams": len(streams), "packets": packets,
        "pages": sum(s.pages for s in streams.values()), "bad_pages": bad,
        "lost_pages": sum(s.lost for s in streams.values()),
        "seconds": duration / rate, "page_times": last_times,
    }


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, media``: the text's UTF-8 bytes, padded to whole frames, as an Ogg file.

    The note stream keeps the unpadded length. Defined cases: null and empty texts give one frame of
    padding; equal texts give equal files; a null id is kept; an empty table gives an empty result; other columns
    are ignored; length is not bounded.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            media = []
            for data in bytes_of(batch, "_text"):
                padding = -len(data) % FRAME if data else FRAME
                media.append(mux(data + PAD * padding, b"bytes=%d" % len(data)))
            yield {id_col: batch.column(0), "media": media}

    return map_batches(docs.select(id_col, utf8(text_col).alias("_text")), work,
                       f"`{id_col}` {kind}, media binary")


READ_SCHEMA = ("n_bytes long, payload binary, streams int, packets long, pages long, bad_pages long, "
               "lost_pages long, seconds double, page_times array<double>")


def read(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Payload and figures of every ``media`` value, ``media`` itself kept; null media gives an empty payload."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [part.split()[0] for part in READ_SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            rows = [read_back(data or b"") for data in bytes_of(batch, "media")]
            for row in rows:
                note = row["note"]
                row["n_bytes"] = int(note[6:]) if note.startswith(b"bytes=") else len(row["payload"])
            yield {id_col: batch.column(0), "media": batch.column(1),
                   **{name: [row[name] for row in rows] for name in names}}

    return map_batches(media.select(id_col, "media"), work,
                       f"`{id_col}` {kind}, media binary, {READ_SCHEMA}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and hashes of what was stored and read back."""
    tail = F.expr("substring(payload, greatest(length(payload) - 31, 1), 32)")
    feature = F.concat_ws(
        ";", F.concat(F.lit("streams="), "streams"), F.concat(F.lit("pages="), "pages"),
        F.concat(F.lit("packets="), "packets"), F.concat(F.lit("bad="), "bad_pages"),
        F.concat(F.lit("lost="), "lost_pages"), F.format_string("seconds=%.3f", "seconds"),
        F.concat(F.lit("page_times="), F.substring(F.md5(F.to_json("page_times").cast("binary")), 1, 16)),
    )
    return read(store(docs, id_col, text_col), id_col).select(
        id_col, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
