"""Literal price tables and small counterparts used by the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def bars_frame(spark, rows, columns="symbol string, trade_date date, close double"):
    return spark.createDataFrame(rows, columns)


def price_table(spark, dates, closes, opens=None, caps=None):
    """Bars from one list of closes per symbol (None: no bar); opens default to the closes."""
    rows = []
    for symbol, own in closes.items():
        for k, (when, close) in enumerate(zip(dates, own, strict=True)):
            if close is not None:
                rows.append((symbol, when if isinstance(when, dt.date) else day(when),
                             float((opens or closes)[symbol][k]), float(close),
                             float(caps[symbol][k]) if caps else None))
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double, total_mv double")


def gappy_panel(symbols=8, days=120, keep=0.8, seed=1) -> pd.DataFrame:
    """Random walk closes with a fifth of the cells missing."""
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2024-01-01", periods=days)
    rows = []
    for s in range(symbols):
        price = 10 * np.exp(np.cumsum(rng.normal(0, 0.03, days)))
        for i, when in enumerate(dates):
            if rng.random() < keep:
                rows.append((f"{s:06d}.SZ", when.date(), float(price[i] * (1 + rng.normal(0, .01))),
                             float(price[i]), float(rng.integers(1, 500))))
    return pd.DataFrame(rows, columns=["symbol", "trade_date", "open", "close", "total_mv"])


def wide(frame: pd.DataFrame, value="close") -> pd.DataFrame:
    out = frame.assign(trade_date=pd.to_datetime(frame["trade_date"]))
    return out.pivot(index="trade_date", columns="symbol", values=value).sort_index()


def weights_of(frame) -> dict:
    return {(r["trade_date"], r["symbol"]): r["weight"] for r in frame.collect()}
