"""Landed price downloads into the price table."""

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tapewire.operators.bars import INTERVALS, ohlcv_bars
from tapewire.operators.columns import union_batches
from tapewire.operators.prices import in_period, normalize_prices, parse_tickers, with_tickers
from tapewire.operators.upsert import latest_prices
from tapewire.sources.landed import price_download_groups
from tapewire.sources.tables import save_prices

DEFAULT_TICKERS = "SPY,CL=F,^VIX"
#: Columns as of ``ingest_report``.
_REPORT = "ticker string, rows long, usable_rows long, first_date timestamp, last_date timestamp"


def landed_prices(
    raw: DataFrame,
    tickers: str | None = None,
    period: str = "max",
    anchor: dt.date | None = None,
    interval: str = "1d",
) -> DataFrame:
    """Normalised prices of the tickers in the look-back period up to ``anchor``.

    Hourly data keep the hour as their date; everything else is dated by day. For weeks and
    months the days are put together in bars, dated by their first day; of a day that was
    landed more than once the last arrival counts.
    """
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {list(INTERVALS)}, not {interval!r}")
    prices = normalize_prices(raw, unit="hour" if interval == "1h" else "day", keep=("row_seq",))
    if tickers is not None:
        prices = with_tickers(prices, tickers)
    if period != "max":
        if anchor is None:
            raise ValueError("a look-back period needs the day it ends on.")
        prices = in_period(prices, period, anchor)
    if interval in ("1wk", "1mo"):
        prices = ohlcv_bars(latest_prices(union_batches(None, prices)), interval)
    return prices


def ingest_prices(
    spark: SparkSession,
    landed: str | list[str],
    out: str,
    tickers: str = DEFAULT_TICKERS,
    period: str = "max",
    anchor: dt.date | None = None,
    interval: str = "1d",
) -> tuple[DataFrame, list[str]]:
    """Merge the landed files into the table at ``out``.

    Files may differ in their headers; each kind is normalised by itself. The files are
    parsed once, into the shared folder. The look-back is everything unless ``period``
    and ``anchor`` say otherwise, since a run over landed files has no "today".

    Returns the report per ticker written, and the requested tickers that were not: nothing
    usable was landed for them, or they would share a folder with another ticker.
    """
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {list(INTERVALS)}, not {interval!r}")
    files = price_download_groups(spark, landed)
    kinds = [landed_prices(raw, tickers, period, anchor, interval="1h" if interval == "1h" else "1d") for raw in files.groups]
    if not kinds:
        raise ValueError(f"no price files in {landed}.")
    prices = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    if interval in ("1wk", "1mo"):
        prices = ohlcv_bars(latest_prices(union_batches(None, prices)), interval)
    # counted while the tickers are judged, in the pass over the rows that the merge needs anyway
    try:
        written = [v for v in save_prices(out, prices, skip_shared=True) if not v.why]
    finally:
        files.drop()
    report = spark.createDataFrame([(v.ticker, v.rows, v.usable_rows, v.first_date, v.last_date) for v in written], _REPORT)
    names = {v.ticker for v in written}
    return report, [t for t in parse_tickers(tickers) if t not in names]
