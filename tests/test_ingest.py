import zipfile

import pytest

from barloom.operators.quality import DataQualityError
from barloom.sources import ingest, lines as L, store
from barloom.streaming import inbox

HEADER = "ts_code,trade_time,open,high,low,close,vol,amount\n"


def rows(code, *clocks, close=1.5, day="2024-01-03"):
    return "".join(f"{code},{day} {c}:00,1,2,0.5,{close},10,100\n" for c in clocks)


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def run(spark, root, **kwargs):
    result = ingest.import_directory(spark, str(root), "1min", **kwargs)
    report = {r["unit"].rsplit("/", 1)[-1]: r for r in result.report.collect()}
    return result, report


def test_directory_end_to_end(spark, tmp_path):
    write(tmp_path / "stock/000001.SZ.csv", HEADER + rows("000001.SZ", "09:31", "09:32", "13:01"))
    placeholder = "510300.SH,2024-01-03 09:31:00,1,1,1,1,0,0\n"
    write(tmp_path / "etf/510300.SH.csv", HEADER + placeholder + rows("510300.SH", "09:32"))
    write(tmp_path / "index/000300.SH.csv", "﻿" + HEADER)
    result, report = run(spark, tmp_path)
    assert {k: (r["status"], r["rows_written"], r["rows_filtered"]) for k, r in report.items()} == {
        "000001.SZ.csv": ("success", 3, 0), "510300.SH.csv": ("success", 1, 1),
        "000300.SH.csv": ("empty", 0, 0)}
    assert {(r["symbol"], r["asset_type"]) for r in result.bars.collect()} == {
        ("000001.SZ", "stock"), ("510300.SH", "etf")}


@pytest.mark.parametrize("body,reason", [
    (rows("000001.SZ", "09:31") + rows("000001.SZ", "09:31", close=1.6), "conflicting"),
    (rows("000001.SZ", "09:32", "09:31"), "not ascending"),
    (rows("000002.SZ", "09:31"), "symbol differs"),
    (rows("000001.SZ", "12:00"), "session grid"),
    (rows("000001.SZ", "09:31", close="x"), "unparsable"),
    (rows("000001.SZ", "09:31", close=9), "illegal"),
])
def test_bad_files_are_rejected_whole(spark, tmp_path, body, reason):
    write(tmp_path / "stock/000001.SZ.csv", HEADER + body)
    write(tmp_path / "stock/000009.SZ.csv", HEADER + rows("000009.SZ", "09:31"))
    result, report = run(spark, tmp_path)
    assert report["000001.SZ.csv"]["status"] == "failed"
    assert reason in report["000001.SZ.csv"]["reason"]
    assert [r["symbol"] for r in result.bars.collect()] == ["000009.SZ"]


def test_identical_repeats_collapse(spark, tmp_path):
    write(tmp_path / "stock/000001.SZ.csv", HEADER + rows("000001.SZ", "09:31", "09:31", "09:32"))
    result, report = run(spark, tmp_path)
    assert report["000001.SZ.csv"]["rows_filtered"] == 1 and result.bars.count() == 2


def test_chinese_header_encoding_and_delimiter(spark, tmp_path):
    text = "代码;日期;时间;开盘;最高;最低;收盘;成交量\n000001;20240103;9:31:00;1;2;0.5;1.5;10\n"
    write(tmp_path / "stock/000001.csv", text, "gb18030")
    result, _ = run(spark, tmp_path)
    row = result.bars.first()
    assert (row["symbol"], str(row["bar_time"]), row["amount"]) == (
        "000001.SZ", "2024-01-03 09:31:00", None)


def test_bar_start_convention_moves_to_bar_end(spark, tmp_path):
    write(tmp_path / "stock/000001.SZ.csv", HEADER + rows("000001.SZ", "09:30"))
    result, _ = run(spark, tmp_path, convention="bar_start")
    row = result.bars.first()
    assert str(row["bar_time"]) == "2024-01-03 09:31:00" and not row["is_auction"]


def test_manifest_decides_files_and_row_counts(spark, tmp_path):
    write(tmp_path / "stock/a.csv", HEADER + rows("000001.SZ", "09:31"))
    write(tmp_path / "stock/b.csv", HEADER + rows("000002.SZ", "09:31"))
    write(tmp_path / "stock/unlisted.csv", HEADER + rows("000003.SZ", "09:31"))
    write(tmp_path / "manifest.csv", "﻿category,ts_code,relative_file,rows\n"
          "stock,000001.SZ,stock/a.csv,1\nstock,000002.SZ,stock/b.csv,2\n"
          "stock,000004.SZ,../outside.csv,\nstock,000005.SZ,stock/gone.csv,1\n")
    listed = ingest.manifest(spark, str(tmp_path))
    assert [r["problem"] != "" for r in listed.orderBy("symbol").collect()] == [
        False, False, True, False]
    result, report = run(spark, tmp_path, use_manifest=True)
    assert {k: r["status"] for k, r in report.items()} == {"a.csv": "success", "b.csv": "failed"}
    formats = L.file_formats(L.csv_files(spark, f"{tmp_path}/stock"))
    good = listed.where("problem = ''")
    sources = ingest.directory_sources(formats, str(tmp_path), good)
    found = {(r["finding"], r["key"]): r["count"]
             for r in ingest.directory_profile(sources, formats, good).collect()}
    assert found == {("files", "stock"): 2, ("missing_file", "stock/gone.csv"): 1}


def test_bad_header_is_reported(spark, tmp_path):
    write(tmp_path / "stock/000001.SZ.csv", "ts_code,trade_time,open\n000001.SZ,x,1\n")
    write(tmp_path / "stock/000002.SZ.csv", HEADER + rows("000002.SZ", "09:31"))
    _, report = run(spark, tmp_path)
    assert "missing columns" in report["000001.SZ.csv"]["reason"]
    assert report["000002.SZ.csv"]["status"] == "success"


def _zip(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as target:
        for name, text in members:
            target.writestr(name, text)


def test_archives_are_judged_as_a_whole(spark, tmp_path):
    _zip(tmp_path / "good.zip", [("stock/a.csv", HEADER + rows("000001.SZ", "09:31")),
                                 ("stock/b.csv", HEADER + rows("000001.SZ", "09:32"))])
    _zip(tmp_path / "overlap.zip", [("a.csv", HEADER + rows("000002.SZ", "09:31", "09:32")),
                                    ("b.csv", HEADER + rows("000002.SZ", "09:33", "09:32"))])
    _zip(tmp_path / "unsafe.zip", [("../x.csv", HEADER)])
    _zip(tmp_path / "bomb.zip", [("x.csv", HEADER + " " * 3_000_000)])
    _zip(tmp_path / "none.zip", [("readme.txt", "x")])
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    _zip(tmp_path / "damaged.zip", [("a.csv", HEADER + rows("000003.SZ", "09:31") * 2000)])
    raw = bytearray((tmp_path / "damaged.zip").read_bytes())
    raw[150:155] = b"xxxxx"
    (tmp_path / "damaged.zip").write_bytes(bytes(raw))
    result = ingest.import_archives(spark, str(tmp_path), "1min")
    report = {r["unit"].rsplit("/", 1)[-1]: (r["status"], r["reason"])
              for r in result.report.collect()}
    assert report["good.zip"] == ("success", "")
    assert report["overlap.zip"][0] == "failed"
    assert report["unsafe.zip"][1] == "unsafe path"
    assert "ratio" in report["bomb.zip"][1]
    assert report["none.zip"][1] == "no CSV member"
    assert "unreadable" in report["broken.zip"][1]
    assert report["damaged.zip"][0] == "failed"
    assert result.bars.count() == 2


def test_symbol_from_member_name(spark, tmp_path):
    text = "datetime,open,high,low,close,volume\n2024-01-03 09:31:00,1,2,0.5,1.5,10\n"
    _zip(tmp_path / "x.zip", [("etf/sh_510300.csv", text)])
    row = ingest.import_archives(spark, str(tmp_path), "1min").bars.first()
    assert (row["symbol"], row["asset_type"]) == ("510300.SH", "etf")


def test_streaming_inbox_imports_each_file_once(spark, tmp_path):
    source, target = tmp_path / "inbox", str(tmp_path / "store")
    args = (spark, str(source), target, str(tmp_path / "state"), "1min", str(tmp_path / "report"))
    write(source / "000001.SZ.csv", HEADER + rows("000001.SZ", "09:31"))
    inbox.import_new_files(*args)
    write(source / "000001.SZ_b.csv", HEADER + rows("000001.SZ", "09:31", "09:32"))
    write(source / "000002.SZ.csv", HEADER + rows("000002.SZ", "12:31"))
    inbox.import_new_files(*args)
    inbox.import_new_files(*args)
    assert store.minute_store(spark, target).count() == 2
    report = spark.read.parquet(str(tmp_path / "report"))
    assert report.count() == 3 and report.where("status = 'failed'").count() == 1


def test_conflicting_increment_stops_the_merge(spark, tmp_path):
    target = str(tmp_path / "store")
    write(tmp_path / "a/stock/000001.SZ.csv", HEADER + rows("000001.SZ", "09:31"))
    write(tmp_path / "b/stock/000001.SZ.csv", HEADER + rows("000001.SZ", "09:31", close=1.7))
    store.merge_minute(run(spark, tmp_path / "a")[0].bars, target)
    with pytest.raises(DataQualityError, match="conflict"):
        store.merge_minute(run(spark, tmp_path / "b")[0].bars, target)
    assert store.minute_store(spark, target).first()["close"] == 1.5


def test_every_bad_file_is_rejected_alone(spark, tmp_path):
    for i in range(300):
        write(tmp_path / f"stock/{i:06d}.SZ.csv", f"{i},2024-01-03 09:31:00,1,2,0.5,1.5,10\n")
    (tmp_path / "stock/100001.SZ.csv").write_bytes(b"\xff\xff\x00 neither\n\xff")
    write(tmp_path / "stock/600000.SH.csv", HEADER + rows("600000.SH", "09:31"))
    quoted = HEADER.replace("amount", '"amount"').replace("\n", ',"a ""note""\nin lines"\n')
    body = rows("600001.SH", "09:31", "09:32").replace(",100\n", ',100,"two\nlines"\n')
    write(tmp_path / "stock/600001.SH.csv", "\n\n" + quoted + body)
    result, report = run(spark, tmp_path)
    assert report["100001.SZ.csv"]["reason"] == "neither UTF-8 nor GB18030"
    assert sum(r["reason"].startswith("missing columns") for r in report.values()) == 300
    assert report["600001.SH.csv"]["status"] == "success"
    assert sorted(r["symbol"] for r in result.bars.collect()) == ["600000.SH", "600001.SH", "600001.SH"]


def test_import_does_not_depend_on_the_layout_of_tasks(spark, tmp_path):
    for i in range(12):
        write(tmp_path / f"stock/{i:06d}.SZ.csv", HEADER + rows(f"{i:06d}.SZ", *[f"09:{m}" for m in range(31, 51)]))
    seen = set()
    for pieces in ("1", "7", "64"):
        spark.conf.set("spark.sql.files.minPartitionNum", pieces)
        try:
            result, report = run(spark, tmp_path)
            spark.conf.set("spark.sql.files.minPartitionNum", "3")
            seen.add((result.bars.count(), sum(r["rows_written"] for r in report.values())))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen == {(240, 240)}


def test_inbox_leaves_out_a_conflicting_file_and_goes_on(spark, tmp_path):
    source, target = tmp_path / "inbox", str(tmp_path / "store")
    args = (spark, str(source), target, str(tmp_path / "state"), "1min", str(tmp_path / "report"))
    write(source / "000001.SZ.csv", HEADER + rows("000001.SZ", "09:31"))
    inbox.import_new_files(*args)
    write(source / "000001.SZ_b.csv", HEADER + rows("000001.SZ", "09:31", "09:32", close=1.7))
    _zip(source / "more.zip", [("stock/a.csv", HEADER + rows("000002.SZ", "09:31")),
                               ("stock/b.csv", HEADER + rows("000002.SZ", "09:32"))])
    (source / "broken.zip").write_bytes(b"no archive")
    write(source / "x/000003.SZ_1.csv", HEADER + rows("000003.SZ", "09:31"))
    write(source / "x/000003.SZ_2.csv", HEADER + rows("000003.SZ", "09:31", "09:32", close=1.9))
    inbox.import_new_files(*args)
    write(source / "000004.SZ.csv", HEADER + rows("000004.SZ", "09:31"))
    inbox.import_new_files(*args)
    got = {(r["symbol"], r["close"]) for r in store.minute_store(spark, target).collect()}
    assert got == {("000001.SZ", 1.5), ("000002.SZ", 1.5), ("000003.SZ", 1.5), ("000004.SZ", 1.5)}
    report = {r["unit"].rsplit("/", 1)[-1]: (r["status"], r["batch"])
              for r in spark.read.parquet(str(tmp_path / "report")).collect()}
    assert report == {
        "000001.SZ.csv": ("success", 0), "000001.SZ_b.csv": ("failed", 1), "more.zip": ("success", 1),
        "broken.zip": ("failed", 1), "000003.SZ_1.csv": ("success", 1), "000003.SZ_2.csv": ("failed", 1),
        "000004.SZ.csv": ("success", 2)}
