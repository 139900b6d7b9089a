"""OHLCV bars from prices or ticks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVALS = {"1h": "hour", "1d": "day", "1wk": "week", "1mo": "month"}


def ohlcv_bars(
    ticks: DataFrame,
    interval: str,
    ts: str = "date",
    tie: str | None = None,
    by: str = "ticker",
    price: str | None = None,
) -> DataFrame:
    """One row per ticker and hour, day, Monday-based week or month.

    Input has the price columns, or one ``price`` column (ticks), where volume
    is the number of ticks. ``ts`` alone must order a ticker's rows, or ``tie``
    must break its ties.

    The aggregation runs map-side first, so a busy ticker shuffles one row per
    bar and task.
    """
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {list(INTERVALS)}, not {interval!r}")
    order = _order(ticks, ts, tie)
    opened, closed = (price, price) if price else ("open", "close")
    high, low, adjusted = (price, price, price) if price else ("high", "low", "adj_close")
    volume = F.count(F.lit(1)).cast("double") if price else F.sum("volume")
    start = F.date_trunc(INTERVALS[interval], F.col(ts))
    return (
        ticks.withColumns({"_bar": start, "_order": order})
        .groupBy(F.col(by).alias("ticker"), F.col("_bar").alias("date"))
        .agg(
            F.min_by(opened, "_order").alias("open"),
            F.max(high).alias("high"),
            F.min(low).alias("low"),
            F.max_by(closed, "_order").alias("close"),
            F.max_by(adjusted, "_order").alias("adj_close"),
            volume.alias("volume"),
        )
        .select("date", "open", "high", "low", "close", "adj_close", "volume", "ticker")
    )


def _order(df: DataFrame, ts: str, tie: str | None) -> Column:
    """Sort key that keeps the aggregation hash-based wherever it can be.

    A struct as key would make Spark sort all rows before aggregating, so an
    integer tie-break is packed with the time into one decimal.
    """
    if tie is None:
        return F.col(ts)
    if not isinstance(df.schema[tie].dataType, T.IntegralType):
        return F.struct(ts, tie)
    micros = F.unix_micros(F.col(ts)).cast("decimal(18,0)")
    # above twice any 64-bit integer, so ties never reach the next microsecond
    step = F.lit("20000000000000000000").cast("decimal(20,0)")
    return (micros * step + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")
