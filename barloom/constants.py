"""Labels, aliases and domains that results and inputs must agree on."""

# --- fixed values: enumerations -------------------------------------------------------------
ASSET_TYPES = ("stock", "etf", "index", "convertible_bond")
MINUTE_ASSET_TYPES = ("stock", "etf", "index")
ADJUSTMENTS = ("none", "qfq", "hfq")
MINUTE_FREQUENCIES = ("1min", "5min", "15min", "30min", "60min")

# --- fixed values: review labels ------------------------------------------------------------
PERIODS = ("今年", "本月", "本周", "当天")
YEAR, MONTH, WEEK, DAY = PERIODS

# (label, lower bound exclusive, upper bound inclusive); None = open end
BREADTH_BUCKETS = (
    ("涨幅>10%", 0.10, None),
    ("涨幅>5%到10%", 0.05, 0.10),
    ("涨幅>0%到5%", 0.0, 0.05),
    ("涨幅>-5%到0%", -0.05, 0.0),
    ("涨幅>-10%到-5%", -0.10, -0.05),
    ("涨幅小于-10%", None, -0.10),
)
SUMMARY_MEAN, SUMMARY_MEDIAN, SUMMARY_COUNT = "等权平均", "中位数", "数量"

REVIEW_COUNT_ROWS = ("A股总数量", "A股上涨数量", "A股下跌数量", "A股零涨幅数量")
REVIEW_RATIO_ROWS = ("A股上涨比例", "A股下跌比例")
REVIEW_AVERAGE_ROWS = ("A股算术平均涨幅", "A股涨幅中位数")
REVIEW_CONVERTIBLE_ROWS = ("可转债算术平均涨幅", "可转债涨幅中位数")
REVIEW_UNDERLYING_ROWS = ("正股算术平均涨幅", "正股涨幅中位数")
REVIEW_TAIL_ROWS = ("微盘股（自建等权）", "可转债等权", "我的实盘合计")

METRIC_LABELS = {
    "total_return": "累计收益率",
    "cagr": "年化收益率",
    "annual_volatility": "年化波动率",
    "sharpe": "Sharpe 比率",
    "max_drawdown": "最大回撤",
    "calmar": "Calmar 比率",
}
CASH_SUMMARY = "空仓"
SUMMARY_SEPARATOR = "、"
MISSING_CELL = "—"

# --- fixed values: header aliases of vendor files ---------------------------------------------
MINUTE_ALIASES = {
    "symbol": ("symbol", "ts_code", "code", "证券代码", "股票代码", "代码"),
    "bar_time": ("bar_time", "trade_time", "datetime", "time", "交易时间", "时间"),
    "trade_date": ("trade_date", "date", "交易日期", "日期"),
    "open": ("open", "开盘", "开盘价"),
    "high": ("high", "最高", "最高价"),
    "low": ("low", "最低", "最低价"),
    "close": ("close", "收盘", "收盘价"),
    "volume": ("volume", "vol", "成交量"),
    "amount": ("amount", "成交额", "成交金额"),
}
NAV_DATE_ALIASES = ("trade_date", "date", "日期")
NAV_VALUE_ALIASES = ("nav", "equity", "净值", "总资产")
SYMBOL_LIST_ALIASES = ("正股代码", "代码", "symbol")
HOLDING_CODE_ALIASES = ("代码", "symbol")
HOLDING_WEIGHT_ALIASES = ("权重", "weight")
FILENAME_SYMBOL_REGEX = r"(\d{6})(?:[._-]?(SH|SZ|BJ))?"
CSV_DELIMITERS = (",", "\t", ";", "|")
CSV_CHARSETS = ("UTF-8", "GB18030")

OHLC = ("open", "high", "low", "close")
BAR_VALUES = ("open", "high", "low", "close", "volume", "amount")
MINUTE_COLUMNS = (
    "symbol", "asset_type", "frequency", "trade_date", "bar_time",
    "open", "high", "low", "close", "volume", "amount", "is_auction", "source",
)
DAILY_COLUMNS = (
    "symbol", "trade_date", "bar_time", "open", "high", "low", "close",
    "volume", "amount", "source", "adjustment",
)
