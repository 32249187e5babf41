import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import panel as P, stats
from tests.helpers import day, gappy_panel, wide


@pytest.fixture(scope="module")
def gappy():
    return gappy_panel()


@pytest.fixture(scope="module")
def panel(spark, gappy):
    return P.with_date_idx(spark.createDataFrame(gappy)).cache()


def _wide(frame, column):
    pdf = frame.select("symbol", "trade_date", column).toPandas()
    return wide(pdf, column)


def _same(got, want):
    want = want.reindex(index=got.index, columns=got.columns)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("steps", [1, 5])
def test_panel_return_steps_over_shared_dates(panel, gappy, steps):
    got = _wide(panel.withColumn("x", P.panel_return("close", steps, P.series())), "x")
    prices = wide(gappy)
    want = (prices / prices.shift(steps) - 1).where(prices.notna())
    _same(got, want)


def test_moving_average_needs_a_full_window(panel, gappy):
    got = _wide(panel.withColumn("x", P.moving_average("close", 3, P.series())), "x")
    prices = wide(gappy)
    _same(got, prices.rolling(3).mean().where(prices.notna()))


def test_ema_decays_over_gaps(panel, gappy):
    got = _wide(P.with_ema(panel.select("symbol", "trade_date", "date_idx", "close"), "close", 10),
                "ema")
    prices = wide(gappy)
    _same(got, prices.ewm(span=10, adjust=False).mean().where(prices.notna()))


@pytest.mark.parametrize("span,block", [(1, 7), (2, 50), (10, 64), (20, 1000), (400, 33), (100_000, 100)])
def test_ema_is_the_same_in_any_blocks(spark, span, block):
    own = np.random.default_rng(span)
    days = np.sort(own.choice(6_000, 900, replace=False))
    days = np.concatenate([days[:800], days[800:] + 20_000])  # a long gap
    values = np.where(own.random(900) < 0.1, np.nan, own.lognormal(3, 1, 900))
    values[:3] = np.nan
    frame = pd.DataFrame({"symbol": "A", "date_idx": days, "close": values})
    frame = pd.concat([frame, frame.assign(symbol="B", close=values[::-1] * 1e-9)])
    given = spark.createDataFrame([(s, int(i), None if np.isnan(v) else float(v)) for s, i, v in frame.itertuples(index=False)],
                                  "symbol string, date_idx int, close double").repartition(5)
    got = P.with_ema(given, "close", span, block=block).toPandas().set_index(["symbol", "date_idx"])["ema"]
    for name, part in frame.groupby("symbol"):
        full = part.set_index("date_idx")["close"].reindex(range(days.max() + 1))
        want = full.ewm(span=span, adjust=False).mean().loc[days]
        np.testing.assert_allclose(got[name].loc[days].to_numpy(), want.to_numpy(), rtol=1e-11)


def test_ema_needs_no_python_and_refuses_repeated_dates(spark, panel):
    frame = panel.select("symbol", "trade_date", "date_idx", "close")
    plan = P.with_ema(frame, "close", 10)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    with pytest.raises(Exception, match="duplicate date"):
        P.with_ema(frame.union(frame.limit(1)), "close", 10).collect()


def test_one_long_series_is_many_tasks(spark):
    long = spark.range(0, 200_000, 1, 8).selectExpr("'A' symbol", "cast(id as int) date_idx", "cast(id % 97 + 1 as double) close")
    got = P.with_ema(long, "close", 15, block=1_000)
    x = pd.Series((np.arange(200_000) % 97 + 1).astype(float)).ewm(span=15, adjust=False).mean()
    # Else so few rows go to one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) > 1 and max(r["count"] for r in held) < 150_000
    tail = {r["date_idx"]: r["ema"] for r in got.where("date_idx % 10007 = 0").collect()}
    np.testing.assert_allclose([tail[i] for i in sorted(tail)], x.iloc[sorted(tail)].to_numpy(), rtol=1e-11)


@pytest.mark.parametrize("block", [1, 13, 64, 5_000])
def test_blocks_with_halo_equal_whole_windows(spark, block):
    own = np.random.default_rng(block)
    at = np.sort(own.choice(3_000, 1_200, replace=False)) - 500  # positions below zero too
    rows = [(name, int(i), None if own.random() < 0.2 else float(own.integers(1, 99))) for name in ("A", "B", None) for i in at]
    frame = spark.createDataFrame(rows, "symbol string, date_idx int, close double").repartition(6)
    columns = {"mean": lambda w: F.avg("close").over(w.rangeBetween(-20, 0)), "sma": lambda w: P.moving_average("close", 3, w),
               "lag": lambda w: P.lag_by("close", 20, w)}
    got = P.in_blocks(frame, columns, span=20, block=block)
    want = frame.withColumns({name: build(P.series()) for name, build in columns.items()})
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    filled = P.fill_in_blocks(frame, "close", "mark", block=block)
    whole = frame.withColumn("mark", P.forward_fill("close", P.series()))
    assert filled.exceptAll(whole).count() == 0 and whole.exceptAll(filled).count() == 0


def test_one_symbol_is_dealt_to_many_tasks(spark):
    long = spark.range(0, 100_000, 1, 4).selectExpr("'A' symbol", "cast(id as int) date_idx", "cast(id as double) close")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = P.in_blocks(long, {"mean": lambda w: F.avg("close").over(w.rangeBetween(-9, 0))}, span=9, block=2_000)
        held = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("mean").alias("total")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(held) == 4 and sum(r["n"] for r in held) == 100_000
    assert sum(r["total"] for r in held) == pytest.approx(pd.Series(np.arange(100_000.0)).rolling(10, min_periods=1).mean().sum())


def test_duplicate_dates_in_a_series_fail(spark):
    rows = [("A", day("2024-01-02"), 1.0), ("A", day("2024-01-02"), 2.0)]
    frame = P.with_date_idx(spark.createDataFrame(rows, "symbol string, trade_date date, close double"))
    with pytest.raises(Exception, match="duplicate date"):
        frame.select(P.require_unique(F.col("close"), P.series())).collect()


def test_percent_rank_averages_ties(spark):
    values = pd.Series([3.0, 1.0, 3.0, None, 2.0, 3.0])
    frame = spark.createDataFrame(
        [(i, "d", None if pd.isna(v) else float(v)) for i, v in enumerate(values)],
        "i int, trade_date string, x double")
    got = {r["i"]: r["p"] for r in frame.withColumn(
        "p", P.percent_rank("x", ["trade_date"])).collect()}
    want = values.rank(pct=True)
    for i, value in want.items():
        assert got[i] == (None if pd.isna(value) else pytest.approx(value))


@pytest.mark.parametrize("ranges", ["1", "7", "64"])
def test_distributed_percent_rank_matches_pandas(spark, ranges):
    rng = np.random.default_rng(7)
    table = pd.DataFrame({"i": range(600), "g": rng.choice(["a", "b", "c"], 600, p=[.8, .1, .1]),
                          "x": np.round(rng.normal(size=600), 1)})
    table.loc[::3, "x"] = 0.5  # one value holds a third of the rows
    table.loc[::50, "x"] = np.nan
    frame = spark.createDataFrame(table).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = stats.with_percent_rank(frame, "g", "x", "p").toPandas().set_index("i")["p"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = table.groupby("g")["x"].rank(pct=True)
    np.testing.assert_allclose(got.sort_index().to_numpy(float), want.to_numpy(float), rtol=1e-12)


def test_latch_keeps_state_without_observation(spark):
    values = [1.0, None, 6.0, 20.0, None, -6.0, 16.0]
    rows = [("A", i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "symbol string, date_idx int, v double")
    v = F.col("v")
    held = frame.withColumn("h", P.latch((v >= 5) & (v < 15), v <= -5, P.series()))
    got = [r["h"] for r in held.orderBy("date_idx").collect()]
    assert got == [False, False, True, True, True, False, False]


def test_period_starts_follow_the_calendar_not_the_window(spark):
    days = ["2024-09-30", "2024-10-08", "2024-10-09", "2024-10-10"]
    axis = P.date_axis(spark.createDataFrame([(day(d),) for d in days], "trade_date date"))
    flags = [r["is_start"] for r in P.with_period_start(axis, "week_fri").orderBy(
        "trade_date").collect()]
    assert flags == [True, True, False, False]


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 1001])
def test_exact_median_matches_pandas(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 3)
    frame = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None)],
                                  "period string, ret double")
    got = stats.exact_median(frame, "period", "ret").first()["median"]
    assert got == pytest.approx(float(np.median(values)))


def test_exact_median_with_heavy_ties(spark):
    frame = spark.range(200_000).select(
        F.lit("g").alias("period"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("ret"))
    want = float(np.median([0.0 if i % 3 == 0 else float(i) for i in range(200_000)]))
    assert stats.exact_median(frame, "period", "ret").first()["median"] == want


def _awkward(own, n):
    """Ties, subnormals, neighbours in the last bit, both zeros, a spread over all exponents, whole infinities apart."""
    base = np.concatenate([
        own.lognormal(0, 200, n), -own.lognormal(0, 200, n), own.integers(0, 50, n) * 5e-324, np.full(n, 1.0),
        np.nextafter(1.0, 2.0) * np.ones(n // 2), np.nextafter(1.0, 0.0) * np.ones(n // 2), [0.0, -0.0, 2.0 ** -1022, 1.7e308],
        1e9 + own.integers(0, 9, n) * 1e-7, 2.0 ** own.integers(-1074, 1023, n)])
    return base[np.isfinite(base)]


def test_ordered_key_orders_like_the_double(spark):
    values = _awkward(np.random.default_rng(5), 300)
    values = np.concatenate([values, -values, [np.inf, -np.inf]])
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = frame.select("x", stats.ordered_key("x").alias("key")).toPandas()
    bits = np.abs(got["x"].to_numpy()).view(np.int64)
    assert (got["key"].to_numpy() == np.where(got["x"] < 0, -bits, bits)).all()


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 41), (3, 500)])
def test_exact_median_of_awkward_values(spark, seed, n):
    own = np.random.default_rng(seed)
    values = own.permutation(_awkward(own, n))
    close = 1 + own.integers(0, 1 << 20, 997) * 2.0 ** -52  # all in one bucket of the first two digits
    rows = [("all", float(v)) for v in values] + [("close", float(v)) for v in close] + [("none", None), ("top", 2.0 ** 1023), ("top", 1.5 * 2.0 ** 1023)]
    got = {r["period"]: r["median"] for r in stats.exact_median(spark.createDataFrame(rows, "period string, ret double"), "period", "ret").collect()}
    assert got == {"all": float(np.median(values)), "close": float(np.median(close)), "top": 1.25 * 2.0 ** 1023}


@pytest.mark.parametrize("block,stretch", [(256, 2048), (3, 50)])
def test_correlation_is_pairwise_complete(spark, gappy, block, stretch):
    got = stats.return_correlation(spark.createDataFrame(gappy), sorted(set(gappy["symbol"])), block=block,
                                   dates_per_task=stretch).toPandas()
    want = wide(gappy).pct_change(fill_method=None).corr()
    assert len(got) == len(want) * (len(want) + 1) // 2
    for row in got.itertuples():
        assert row.corr == pytest.approx(want.loc[row.symbol_a, row.symbol_b], abs=1e-9)


def test_islands_collapse_runs(spark):
    rows = [(day("2024-01-01"), 1), (day("2024-01-02"), 2), (day("2024-01-05"), 5)]
    frame = spark.createDataFrame(rows, "cal_date date, pos int")
    got = sorted(tuple(r) for r in P.islands(frame, "pos").collect())
    assert got == [(day("2024-01-01"), day("2024-01-02"), 2), (day("2024-01-05"), day("2024-01-05"), 1)]


def test_returns_over_zero_prices_are_infinite_not_errors(spark):
    closes = [0.0, 2.0, 0.0, 0.0, None, 4.0]
    rows = [("a", k, close) for k, close in enumerate(closes)]
    frame = spark.createDataFrame(rows, "symbol string, date_idx int, close double")
    steps = {"whole": frame.withColumn("ret", P.panel_return("close", 1, P.series())),
             "blocks": P.in_blocks(frame, {"ret": lambda w: P.panel_return("close", 1, w)}, span=1, block=2)}
    for got in steps.values():
        rets = [r["ret"] for r in got.orderBy("date_idx").collect()]
        assert rets[0] is None and rets[1:3] == [float("inf"), -1.0] and np.isnan(rets[3]) and rets[4:] == [None, None]
    peak = [r[0] for r in frame.limit(2).select(P.drawdown("close", P.series())).collect()]
    assert np.isnan(peak[0]) and peak[1] == 0.0
