"""Fixed table schemas. Daily dates are DATE, minute times TIMESTAMP_NTZ, values DOUBLE."""

from __future__ import annotations

from pyspark.sql import types as T

_PRICES = [
    T.StructField(name, T.DoubleType())
    for name in ("open", "high", "low", "close", "volume", "amount")
]

DAILY_BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        *_PRICES,
        T.StructField("source", T.StringType()),
        T.StructField("adjustment", T.StringType()),
    ]
)

MINUTE_BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("asset_type", T.StringType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("bar_time", T.TimestampNTZType()),
        *_PRICES,
        T.StructField("is_auction", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)

WEIGHT = T.StructType(
    [
        T.StructField("portfolio_id", T.StringType()),
        T.StructField("signal_date", T.DateType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
