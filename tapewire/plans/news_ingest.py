"""Landed news response pages into the news table."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tapewire.operators.news import (
    DEFAULT_QUERY,
    SOURCE,
    matching,
    newest_pages,
    normalize_articles,
    published_between,
)
from tapewire.sources.landed import read_news_payloads
from tapewire.sources.tables import BUCKETS, save_news


def landed_news(
    articles: DataFrame,
    query: str | None = DEFAULT_QUERY,
    since: str | dt.date | None = None,
    until: str | dt.date | None = None,
    pages: int | None = None,
    page_size: int = 100,
    source: str = SOURCE,
) -> DataFrame:
    """Flat articles that match the query and the dates, of all or the newest pages."""
    news = normalize_articles(articles, source=source, keep=("row_seq",))
    news = published_between(news, since, until)
    if query is not None:
        news = matching(news, query)
    return news if pages is None else newest_pages(news, pages, page_size)


def ingest_news(
    spark: SparkSession,
    landed: str | list[str],
    out: str,
    query: str | None = DEFAULT_QUERY,
    since: str | dt.date | None = None,
    until: str | dt.date | None = None,
    pages: int | None = None,
    page_size: int = 100,
    multi_line: bool = False,
    buckets: int = BUCKETS,
) -> bool:
    """Merge the landed pages into the table at ``out``; False if no article matched.

    ``buckets`` is for a table that does not exist yet.
    """
    articles = read_news_payloads(spark, landed, multi_line)
    return save_news(out, landed_news(articles, query, since, until, pages, page_size), buckets=buckets)
