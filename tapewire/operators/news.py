"""Article normalisation, date window, keyword search, newest-first pages."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.functions.parse import parse_instant
from tapewire.functions.text import compose_text, keyword_match
from tapewire.operators.columns import align
from tapewire.schemas import NEWS

# The source tag of delivered articles, and the default search.
SOURCE = "guardian"
DEFAULT_QUERY = "energy OR oil OR gas OR fed OR inflation"


def normalize_articles(
    articles: DataFrame, article: str = "article", source: str = SOURCE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Nested articles (column ``article``) to the flat news columns."""
    fields = {f.name for f in articles.schema[article].dataType.fields}
    has_text = "fields" in fields
    text_fields = (
        {f.name for f in articles.schema[article].dataType["fields"].dataType.fields}
        if has_text
        else set()
    )

    def part(name):
        return F.col(f"{article}.{name}") if name in fields else F.lit(None).cast("string")

    def text(name):
        return F.col(f"{article}.fields.{name}") if name in text_fields else F.lit(None).cast("string")

    flat = articles.select(
        part("id").alias("id"),
        part("webUrl").alias("url"),
        F.lit(source).alias("source"),
        part("sectionName").alias("section"),
        parse_instant(part("webPublicationDate")).alias("published_at"),
        text("headline").alias("title"),
        text("trailText").alias("description"),
        text("bodyText").alias("body"),
        *[c for c in keep if c in articles.columns],
    )
    return align(flat, NEWS, keep)


def published_between(
    news: DataFrame, since: str | dt.date | None = None, until: str | dt.date | None = None
) -> DataFrame:
    """Articles from the day ``since`` to the end of the day ``until``, either optional.

    Compared as timestamps, so that parquet statistics can skip row groups.
    """
    if since is not None:
        news = news.where(F.col("published_at") >= F.lit(_midnight(since)))
    if until is not None:
        day_after = _midnight(until) + dt.timedelta(days=1)
        news = news.where(F.col("published_at") < F.lit(day_after))
    return news


def _midnight(day: str | dt.date) -> dt.datetime:
    date = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return dt.datetime(date.year, date.month, date.day, tzinfo=dt.timezone.utc)


def matching(news: DataFrame, query: str = DEFAULT_QUERY) -> DataFrame:
    """Articles with any keyword of ``"a OR b OR c"`` as a word of their text."""
    return news.where(keyword_match(compose_text(news.columns), query))


def newest_pages(news: DataFrame, pages: int = 5, page_size: int = 100) -> DataFrame:
    """The first pages of the newest-first listing, as one top-k."""
    return _newest_first(news).limit(pages * page_size)


def newest_page(news: DataFrame, page: int, page_size: int = 100) -> DataFrame:
    """One page of the newest-first listing, counted from 1."""
    return _newest_first(news).offset((page - 1) * page_size).limit(page_size)


def _newest_first(news: DataFrame) -> DataFrame:
    return news.orderBy(
        F.col("published_at").desc_nulls_last(), F.col("url").asc_nulls_last()
    )
