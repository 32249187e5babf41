"""Splits of one file give the rows of one task, wherever the borders fall."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from barloom.session import cut
from barloom.sources import ingest, lines as L

HEADER = "ts_code,trade_time,open,high,low,close,vol,amount\n"
FIELDS = ["open", "high", "low", "close", "volume"]


def split_rows(path, split_bytes, charset="UTF-8"):
    """All records of a file by the split functions, with the states composed here."""
    size, unit = path.stat().st_size, path.as_uri()
    codec = L.CODECS[charset]
    sep, begin, header = L._head(unit, "", codec)
    heads = {name: {"sep": sep, "begin": begin} if L.CODECS[own] == codec else None
             for name, own in zip(L._HEAD_COLUMNS, L.CSV_CHARSETS)}
    at, out, inside = L.CSV_CHARSETS.index(charset), [], False
    for start in range(0, max(size, 1), split_bytes):
        facts = L._facts({"unit": unit, "entry": "", "start": start, "stop": start + split_bytes, **heads})
        if facts["first"] is None:
            continue
        track = facts["tracks"][at]
        assert track["ok"]
        row = {"unit": unit, "entry": "", "charset": charset, "sep": sep, "begin": begin, "inside": inside, **facts}
        out += [cells for batch in L._records(row) for cells in batch]
        inside = track["quoted"] if inside else track["out"]
    return header, out


def plain_rows(data, codec, sep):
    text = data.decode("utf-8-sig" if codec == "utf-8" else codec).lstrip()
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(c.strip() for c in r)]
    return rows[0], rows[1:]


CELLS = ["1", "", "x y", 'a"b', '"two\nlines"', '"say ""hi"""', '""', '"a,b;c"', '"\r\n"', "é日", '"q"tail', '"ends""\n"', '"""', " "]


@pytest.mark.parametrize("charset,sep,ending", [
    ("UTF-8", ",", "\n"), ("UTF-8", "\t", "\r\n"), ("GB18030", "|", "\n"), ("GB18030", ";", "\r\n"), ("UTF-8", ",", "\r")])
def test_every_border_gives_the_rows_of_one_reader(tmp_path, charset, sep, ending):
    own = random.Random(charset + sep)
    for number in range(12):
        cells = CELLS if number % 2 else [c for c in CELLS if c.count('"') % 2 == 0]
        body = ending.join(sep.join(own.choices(cells, k=4)) for _ in range(30))
        lead = own.choice(["", "\n \n", "  "])
        text = f'{lead}代码{sep}"two{ending}""headers"""{sep}c{sep}d{ending}{body}{own.choice(["", ending])}'
        data = (b"\xef\xbb\xbf" if charset == "UTF-8" and number % 3 == 0 else b"") + text.encode(L.CODECS[charset])
        path = tmp_path / f"{number}.csv"
        path.write_bytes(data)
        want = plain_rows(data, L.CODECS[charset], sep)
        for split_bytes in (1, 2, 3, 7, 16, 61, 200, 1 << 20):
            assert split_rows(path, split_bytes, charset) == want, (number, split_bytes)


def test_chunks_change_nothing(tmp_path, monkeypatch):
    path = tmp_path / "a.csv"
    text = 'a,b\n' + '"x ""y""\r\nz",1\r\n' * 40
    path.write_text(text, newline="")
    want = plain_rows(text.encode(), "utf-8", ",")
    for chunk in (1, 2, 5, 13):
        monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
        assert split_rows(path, 50) == want


def test_automaton_keeps_its_state_over_any_cut():
    own = random.Random(2)
    for _ in range(300):
        text = "".join(own.choices('",\n\rab', k=30))
        for start in (L.OUTSIDE, L.QUOTED):
            whole, state = L.advance(text, start, ","), start
            for a in range(0, 30, 7):
                state = L.advance(text[a:a + 7], state, ",")
            assert state == whole


@pytest.mark.parametrize("split_bytes", [100, 777, 1 << 20])
def test_import_of_one_file_in_many_splits(spark, tmp_path, split_bytes):
    body = "".join(f'000001.SZ,2024-01-03 {h:02d}:{m:02d}:00,1,2,0.5,1.5,10,"{"1" * (m % 3 + 1)}"\n'
                   for h in (10, 13, 14) for m in range(60) if h != 13 or m)
    noted = HEADER.replace("\n", ",note\n") + body.replace('"\n', '","break\n""in"", note"\n')
    (tmp_path / "stock").mkdir()
    (tmp_path / "stock/000001.SZ.csv").write_text(noted, newline="")
    (tmp_path / "stock/000002.SZ.csv").write_bytes(HEADER.encode() + b"000002.SZ,2024-01-03 09:31:00,1,2,0.5,1.5,10,100\n" * 9 + b"\xff\xff\n")
    files = L.csv_files(spark, str(tmp_path))
    formats = L.file_formats(files, split_bytes=split_bytes).collect()
    by = {r["member"].rsplit("/", 1)[-1]: r for r in formats}
    assert by["000002.SZ.csv"]["error"] == "neither UTF-8 nor GB18030"
    splits = by["000001.SZ.csv"]["splits"]
    assert by["000001.SZ.csv"]["charset"] == "UTF-8" and len(splits) > 20 if split_bytes == 100 else splits
    if split_bytes == 100:
        assert any(s["inside"] for s in splits) and not all(s["inside"] for s in splits)
    result = ingest.import_directory(spark, str(tmp_path), "1min", split_bytes=split_bytes)
    report = {r["unit"].rsplit("/", 1)[-1]: r for r in result.report.collect()}
    assert (report["000001.SZ.csv"]["status"], report["000001.SZ.csv"]["rows_input"]) == ("success", 179)
    amounts = [r["amount"] for r in result.bars.orderBy("bar_time").collect()]
    assert amounts == [float("1" * (m % 3 + 1)) for h in (10, 13, 14) for m in range(60) if h != 13 or m]


def test_rows_of_a_split_go_to_tasks_of_their_own(spark, tmp_path):
    (tmp_path / "big.csv").write_text("symbol,open,close\n" + "".join(f'{i:06d},"{i}",2\n' for i in range(4000)))
    formats = cut(L.file_formats(L.csv_files(spark, str(tmp_path)), split_bytes=2_000))
    rows = L.parse_rows(formats).withColumn("task", F.spark_partition_id())
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks"), F.count_distinct("task").alias("tasks"),
                    F.count_distinct("symbol").alias("symbols"), F.sum(F.col("open").cast("int")).alias("total")).first()
    assert (seen["n"], seen["symbols"], seen["total"]) == (4000, 4000, 4000 * 3999 // 2)
    assert seen["blocks"] > 20 and seen["tasks"] == 4
