"""Price normalisation, look-back and ticker filters, price series."""

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.functions.parse import to_number, to_utc
from tapewire.operators.columns import (
    align,
    first_present,
    flatten_columns,
    rename_aliases,
)
from tapewire.schemas import PRICE_VALUES, PRICES

_ALIASES = {
    "adj_close": ("adj_close", "adj close", "adjclose"),
    "date": ("date", "datetime", "index"),
}
_DATE_COLUMNS = ("date", "Date")
_CLOSE_COLUMNS = ("adj_close", "adj close", "Adj Close", "close", "Close")

PERIODS = {"1y": 12, "2y": 24, "5y": 60, "10y": 120, "max": None}


def normalize_prices(
    raw: DataFrame,
    ticker: str | None = None,
    unit: str = "day",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Raw OHLCV rows, often all text, to the fixed price columns.

    ``ticker`` names the instrument of the whole input; without it the input's
    own ``ticker`` column holds. Dates go to UTC and are cut to ``unit``. Rows
    without a readable date or adjusted close are dropped. ``keep`` lists
    further columns to carry along, such as ``row_seq``.
    """
    df = rename_aliases(flatten_columns(raw, ticker), _ALIASES)
    if "date" not in df.columns:
        return raw.sparkSession.createDataFrame([], PRICES)
    types = {f.name: f.dataType for f in df.schema.fields}
    name = F.lit(ticker) if ticker is not None else F.col("ticker")
    if ticker is None and "ticker" not in types:
        raise ValueError("prices have no ticker column, and no ticker was given.")
    values = {c: to_number(F.col(c), types[c]) for c in PRICE_VALUES if c in types}
    df = df.withColumns(
        {"date": F.date_trunc(unit, to_utc(F.col("date"), types["date"])), **values, "ticker": name}
    )
    # parsed numbers are never NaN
    return align(df, PRICES, keep).where("date is not null and adj_close is not null")


def usable(prices: DataFrame) -> DataFrame:
    """Rows that have a date and an adjusted close."""
    return prices.where(
        F.col("date").isNotNull() & F.col("adj_close").isNotNull() & ~F.isnan("adj_close")
    )


def in_period(prices: DataFrame, period: str, anchor: dt.date | Column) -> DataFrame:
    """Rows of the last 1y, 2y, 5y or 10y up to ``anchor``, or all for max."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {list(PERIODS)}, not {period!r}")
    months = PERIODS[period]
    if months is None:
        return prices
    day = anchor if isinstance(anchor, Column) else F.lit(anchor)
    return prices.where(F.col("date") >= F.add_months(day, -months).cast("timestamp"))


def parse_tickers(tickers: str) -> list[str]:
    """``"SPY, CL=F,,^VIX"`` to ``["SPY", "CL=F", "^VIX"]``."""
    return re.findall(r"[^\s,](?:[^,]*[^\s,])?", tickers)


def with_tickers(prices: DataFrame, tickers: str) -> DataFrame:
    return prices.where(F.col("ticker").isin(parse_tickers(tickers)))


def price_series(
    prices: DataFrame,
    keep: tuple[str, ...] = ("ticker",),
    session_close_offset: dt.timedelta | None = None,
) -> DataFrame:
    """``ts`` and ``adj_close`` of every usable price row, and the ``keep`` columns.

    The adjusted close is one column for the whole table, the first present of
    the accepted names; plain close stands in only where no adjusted column
    exists. ``session_close_offset`` moves ``ts`` from midnight to the time at
    which the price is known.
    """
    date = first_present(prices, _DATE_COLUMNS, "prices")
    close = first_present(prices, _CLOSE_COLUMNS, "prices")
    at = [f"c{i}" for i in range(len(prices.columns))]
    where = dict(zip(reversed(prices.columns), reversed(at)))
    types = {f.name: f.dataType for f in reversed(prices.schema.fields)}
    ts = to_utc(F.col(where[date]), types[date])
    if session_close_offset:
        ts = ts + F.lit(session_close_offset)
    extra = [F.col(where[c]).alias(c) for c in keep if c in where]
    series = prices.toDF(*at).select(
        *extra, ts.alias("ts"), to_number(F.col(where[close]), types[close]).alias("adj_close")
    )
    return series.where(F.col("ts").isNotNull() & F.col("adj_close").isNotNull())
