import hashlib
import zlib

from barloom.llm import ogg
from tests.llm.fixtures import awkward_rows, docs, empty


def slow_checksum(data):
    value = 0
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


def test_checksum_bit_by_bit():
    for data in (b"", b"a", b"OggS" * 9, bytes(range(256))):
        assert ogg.page_checksum(data) == slow_checksum(data)


def test_files_of_all_sizes_come_back():
    for frames in (1, 2, 84, 85, 86, 170, 171, 600):
        payload = bytes(i * 7 % 256 for i in range(frames * ogg.FRAME))
        back = ogg.read_back(ogg.mux(payload, b"bytes=5"))
        assert back["payload"] == payload and back["note"] == b"bytes=5"
        assert back["streams"] == 2 and back["bad_pages"] == back["lost_pages"] == 0
        assert back["seconds"] == len(payload) / ogg.RATE and back["page_times"][-1] == back["seconds"]


def test_packets_longer_than_a_page():
    packets = [b"head", b"x" * 200_000, b"", b"y" * 255, b"z" * 510]
    streams, bad = ogg.demux(b"".join(ogg.stream_pages(7, packets, list(range(5)))))
    assert bad == 0 and streams[7].packets == packets and streams[7].ended


def test_a_broken_page_is_found_and_left_out():
    payload = bytes(ogg.FRAME * 300)
    data = bytearray(ogg.mux(payload, b"bytes=1"))
    data[len(data) // 2] ^= 1
    back = ogg.read_back(bytes(data))
    assert back["bad_pages"] == 1 and back["lost_pages"] >= 1 and len(back["payload"]) < len(payload)
    assert ogg.read_back(b"junk" + ogg.mux(payload, b"bytes=1"))["payload"] == payload


def test_query_columns(spark):
    got = {(r["doc_id"], r["n_bytes"]): r for r in ogg.digests(docs(spark, clashing=True)).collect()}
    for row in awkward_rows():
        text = (row[1] or "").encode()
        payload = text + b"\xff" * ((-len(text)) % 576 or (0 if text else 576))
        r = got[row[0], len(text)]
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and "bad=0" in r["feature"]
    assert ogg.digests(empty(spark)).count() == 0
    missing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert ogg.read(missing).first()["streams"] == 0
