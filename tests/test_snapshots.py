import hashlib

import pytest
from pyspark.sql import functions as F

from barloom.operators import snapshots as Snap
from tests.helpers import day

FACTS = ("asset_type string, trade_date date, symbol_count int, basic_verified boolean, "
         "basic_count int, missing_basic int, provider_expected int, prior_count int, "
         "response_complete boolean, response_limit int")


def verdict(spark, **values):
    base = dict(asset_type="stock", trade_date=day("2024-01-02"), symbol_count=100,
                basic_verified=False, basic_count=None, missing_basic=0, provider_expected=0,
                prior_count=0, response_complete=None, response_limit=0)
    base.update(values)
    frame = spark.createDataFrame([tuple(base.values())], FACTS)
    row = Snap.completeness(frame, {"stock": 4500, "convertible_bond": 250}, 0.9, 2).first()
    return row["expected_symbols"], row["status"]


@pytest.mark.parametrize("values,want", [
    (dict(response_complete=True), (100, "complete")),
    (dict(response_complete=True, basic_verified=True, basic_count=101), (101, "incomplete")),
    (dict(response_complete=True, asset_type="etf", provider_expected=100), (88, "complete")),
    (dict(response_complete=True, asset_type="etf", prior_count=100), (88, "complete")),
    (dict(response_complete=False, response_limit=6000), (6001, "incomplete")),
    (dict(basic_verified=True, basic_count=100), (88, "complete")),
    (dict(basic_verified=True, basic_count=100, missing_basic=1), (88, "incomplete")),
    (dict(provider_expected=200), (178, "incomplete")),
    (dict(asset_type="convertible_bond", prior_count=10), (250, "incomplete")),
    (dict(prior_count=100), (88, "complete")),
    (dict(), (4500, "incomplete")),
    (dict(asset_type="index"), (0, "incomplete")),
])
def test_completeness_branches(spark, values, want):
    assert verdict(spark, **values) == want


def test_delisting_day_is_out_and_b_shares_are_dropped(spark):
    rows = [("000001.SZ", day("2020-01-01"), None), ("000002.SZ", day("2020-01-01"), day("2024-01-02")),
            ("200011.SZ", day("2020-01-01"), None), ("000003.SZ", day("2024-01-03"), None)]
    master = spark.createDataFrame(rows, "symbol string, list_date date, delist_date date")
    days = spark.createDataFrame([(day(d),) for d in ("2024-01-01", "2024-01-02", "2024-01-03")],
                                 "cal_date date")
    got = {str(r["cal_date"]): r["active"] for r in Snap.active_counts(master, days).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 2}


def test_missing_ranges_cover_edges_and_unknown_symbols(spark):
    days = [day(f"2024-01-{i:02d}") for i in range(1, 8)]
    expected = spark.createDataFrame([(d,) for d in days], "trade_date date")
    keyed = "symbol string, trade_date date"
    bars = spark.createDataFrame([("A", days[i]) for i in (1, 2, 5)], keyed)
    empties = spark.createDataFrame([("A", days[3])], keyed)
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    got = sorted((r["symbol"], str(r["range_start"])[-2:], str(r["range_end"])[-2:], r["days"])
                 for r in Snap.missing_ranges(bars, empties, expected, symbols).collect())
    assert got == [("A", "01", "01", 1), ("A", "05", "05", 1), ("A", "07", "07", 1),
                   ("B", "01", "07", 7)]


def test_empty_calendar_delivery_keeps_stored_days(spark):
    stored = spark.createDataFrame([(day("2024-01-02"),)], "cal_date date")
    nothing = spark.createDataFrame([], "cal_date date, is_open int")
    assert Snap.replace_calendar_range(stored, nothing).count() == 1


def test_incomplete_never_overwrites_complete(spark):
    schema = "asset_type string, adjustment string, trade_date date, status string, checked_at int"
    d = day("2024-01-02")
    for old, new, keep, want in (("complete", "incomplete", True, ("complete", 1)),
                                 ("complete", "incomplete", False, ("incomplete", 2)),
                                 ("incomplete", "incomplete", True, ("incomplete", 2)),
                                 ("incomplete", "complete", True, ("complete", 2))):
        stored = spark.createDataFrame([("stock", "none", d, old, 1)], schema)
        incoming = spark.createDataFrame([("stock", "none", d, new, 2)], schema)
        row = Snap.upsert_status(stored, incoming, keep).first()
        assert (row["status"], row["checked_at"]) == want


def test_digest_and_sample_do_not_depend_on_order(spark):
    d = day("2024-01-02")
    names = ["b", "a", "c", "a"]
    frame = spark.createDataFrame([(d, n) for n in names], "trade_date date, symbol string")
    digest = Snap.symbol_digest(frame, ["trade_date"]).first()["digest"]
    assert digest == hashlib.sha256(b"a\nb\nc").hexdigest()
    want = sorted({"a", "b", "c"}, key=lambda s: hashlib.sha256(f"2024-01-02:{s}".encode()).digest())[:2]
    got = [r["symbol"] for r in Snap.validation_sample(frame, 2).orderBy("pick").collect()]
    assert got == want


@pytest.mark.parametrize("value,bad", [("1", False), ("0", True), ("-1", True), ("bad", True),
                                       ("Infinity", True), ("NaN", True), (None, True)])
def test_market_cap_values(spark, value, bad):
    frame = spark.createDataFrame([("A", day("2024-01-02"), value)],
                                  "symbol string, trade_date date, total_mv string")
    assert frame.select(Snap.bad_market_cap()).first()[0] is bad


def test_refresh_guards(spark):
    keyed = "symbol string, trade_date date"
    d1, d2 = day("2024-01-02"), day("2024-01-03")
    cached = spark.createDataFrame([("A", d1), ("A", d2)], keyed)
    lost = Snap.dropped_cached_dates(cached, spark.createDataFrame([("A", d2)], keyed)).first()
    assert (lost["symbol"], lost["lost_dates"]) == ("A", 1)
    now = spark.createDataFrame([("A", d1)], keyed)
    row = Snap.basic_refresh_guard(cached, now, F.lit(True), F.lit(True)).first()
    assert row["verdict"] == "complete"
    both = spark.createDataFrame([("A", d1), ("B", d1)], keyed)
    row = Snap.basic_refresh_guard(both, now, F.lit(True), F.lit(True)).first()
    assert (row["dropped"], row["verdict"]) == (1, "refused")


def test_calendar_shapes(spark):
    old = spark.createDataFrame([("2024-01-02", "1"), ("2024-01-03", "0")], "cal_date string, is_open string")
    new = spark.createDataFrame([("2024-01-02", "1"), ("2024-01-03", "0")],
                                "calendar_date string, is_trading_day string")
    assert [r[0] for r in Snap.trading_days(old).collect()] == [day("2024-01-02")]
    assert [r[0] for r in Snap.trading_days(new).collect()] == [day("2024-01-02")]


def test_refresh_guard_unknown_answers_and_emptied_dates(spark):
    schema = "symbol string, trade_date date, total_mv double"
    d = [day(f"2022-06-0{k}") for k in range(1, 6)]
    before = [(s, when, 1.0) for when in d for s in ("A", "B", "C")]
    now = [(s, when, 1.0) for when in (d[0], d[1], d[3]) for s in ("A", "B", "C")]  # the third and fifth came back empty
    complete = F.when(F.dayofmonth("trade_date") == 1, True).when(F.dayofmonth("trade_date") == 4, F.lit(None).cast("boolean"))
    known = F.dayofmonth("trade_date") <= 4

    def verdicts(floor=None):
        got = Snap.basic_refresh_guard(spark.createDataFrame(before, schema), spark.createDataFrame(now, schema), complete, known,
                                    floor)
        return [(r["symbols"], r["dropped"], r["verdict"]) for r in got.orderBy("trade_date").collect()]

    assert verdicts() == [(3, 0, "complete"), (3, 0, "refused"), (0, 3, "refused"), (3, 0, "refused"), (0, 3, "observed")]
    assert verdicts(F.lit(3))[3] == (3, 0, "complete") and verdicts(F.lit(4))[3] == (3, 0, "refused")


def test_doubled_master_rows_count_once(spark):
    rows = [("A", day("2022-01-01"), None), ("A", day("2022-02-01"), None), ("B", day("2022-01-01"), day("2022-03-01")),
            ("B", day("2022-02-01"), day("2022-04-01")), ("B", day("2022-06-01"), None), ("900001.SH", day("2022-01-01"), None)]
    master = spark.createDataFrame(rows, "symbol string, list_date date, delist_date date")
    days = spark.createDataFrame([(day(t),) for t in ("2021-12-31", "2022-02-15", "2022-03-15", "2022-04-01", "2022-07-01")],
                                 "cal_date date")
    got = Snap.active_counts(master, days).orderBy("cal_date").collect()
    assert [r["active"] for r in got] == [0, 2, 2, 1, 2]


def test_market_cap_report(spark):
    d = [day(f"2022-06-0{k}") for k in range(1, 6)]
    rows = [("A", d[0], 1.0), ("A", d[1], 1.0), ("A", d[1], 2.0), ("900001.SH", d[2], 1.0), ("A", d[3], -1.0), ("A", d[4], 1.0)]
    basic = spark.createDataFrame(rows, "symbol string, trade_date date, total_mv double")
    asked = spark.createDataFrame([(x,) for x in [*d[:4], day("2022-06-30")]], "trade_date date")
    got = {r["trade_date"]: r["verdict"] for r in Snap.market_cap_report(basic, asked).collect()}
    assert got == {d[0]: "valid", d[1]: "invalid", d[2]: "invalid", d[3]: "invalid", d[4]: "foreign",
                   day("2022-06-30"): "missing"}
    with pytest.raises(Exception, match="total_mv"):
        Snap.market_cap_report(basic.drop("total_mv"), asked)


def test_review_day_is_the_latest_complete_one_or_refused(spark):
    d = [day(f"2022-06-0{k}") for k in range(1, 5)]
    status = spark.createDataFrame(list(zip(d, ["complete", "incomplete", "complete", "incomplete"])),
                                   "trade_date date, status string")

    def anchors(*others):
        return lambda when: spark.createDataFrame([(when, *others)], ", ".join(f"a{k} date" for k in range(len(others) + 1)))

    assert Snap.require_review_day(status, anchors(d[0])) == d[2]
    assert Snap.require_review_day(status, anchors(), d[0]) == d[0]
    with pytest.raises(Exception, match="2022-06-02 incomplete"):
        Snap.require_review_day(status, anchors(d[1]))
    with pytest.raises(Exception, match="no complete day"):
        Snap.require_review_day(status.where("status = 'none'"), anchors())
