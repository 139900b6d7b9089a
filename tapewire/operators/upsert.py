"""Keyed upserts: which of several rows with the same key stays."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.operators.columns import union_batches
from tapewire.operators.prices import usable

PRICE_KEY = ("date", "ticker")
NEWS_KEY = ("url",)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; NULL keys form one group.

    Written as ``row_number() = 1``, for which Spark keeps one row per key and
    task before the shuffle. A key that holds most of the table, as NULL may,
    therefore reaches its reducer as one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_prices(batches: DataFrame) -> DataFrame:
    """Per date and ticker the row that arrived last."""
    order = [F.col("batch_seq").desc(), F.col("row_seq").desc()]
    return first_per_key(batches, PRICE_KEY, order)


def upsert_prices(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Existing and incoming prices, the last arrival winning, unusable rows dropped.

    The winner is chosen first and dropped if it is unusable, as an arrival
    without a price still replaces the earlier row.
    """
    return usable(latest_prices(union_batches(existing, incoming)).drop("batch_seq", "row_seq"))


def latest_news(batches: DataFrame, null_wins: bool = False) -> DataFrame:
    """Per url the row published last, then the one that arrived last.

    A row without ``published_at`` loses to any dated one; ``null_wins`` turns
    that round.
    """
    published = F.col("published_at")
    order = [
        published.desc_nulls_first() if null_wins else published.desc_nulls_last(),
        F.col("batch_seq").desc(),
        F.col("row_seq").desc(),
    ]
    return first_per_key(batches, NEWS_KEY, order)


def upsert_news(
    existing: DataFrame | None, incoming: DataFrame, null_wins: bool = False
) -> DataFrame:
    """Existing and incoming articles, one row per url."""
    return latest_news(union_batches(existing, incoming), null_wins).drop("batch_seq", "row_seq")
