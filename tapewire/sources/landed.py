"""Readers for landed downloads: price files and news response pages."""

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.schemas import PAYLOAD
from tapewire.session import Stored, store

#: What of a file's name is its ticker.
TICKER_PATTERN = r"^(?:prices_)?(.+)\.csv"
_BROKEN = "_unreadable"


def read_price_downloads(
    spark: SparkSession, path: str | list[str], ticker_pattern: str = TICKER_PATTERN
) -> DataFrame:
    """Landed OHLCV csv files, every column as text.

    Files without a ``ticker`` column get it from their name. ``row_seq`` orders
    rows by file time, then file, then place in the file.
    """
    # A file whose header differs fails instead of being read into the wrong
    # columns. The check needs all columns, hence no pruning.
    raw = spark.read.option("columnPruning", "false").csv(
        path, header=True, inferSchema=False, enforceSchema=False
    )
    meta = F.col("_metadata")
    out = raw.withColumn("row_seq", _arrival(F.monotonically_increasing_id()))
    if "ticker" not in [c.lower() for c in raw.columns]:
        out = out.withColumn("ticker", F.regexp_extract(_plain(meta["file_name"]), ticker_pattern, 1))
    return out


@dataclass(frozen=True)
class Landed:
    """Landed files as one frame for each header, until ``drop`` removes the stored lines that these read."""

    groups: list[DataFrame]
    stored: tuple[Stored, ...]

    def drop(self) -> None:
        for rows in self.stored:
            rows.drop()


def price_download_groups(spark: SparkSession, path: str | list[str], ticker_pattern: str = TICKER_PATTERN) -> Landed:
    """Landed OHLCV files as one frame, as of ``read_price_downloads``, for each header that occurs.

    The files are read once, as lines, into the shared folder. The first line of each is its header, and the lines of all
    files with the same header are taken apart by it. Only the different headers reach the driver. Files that are empty
    or hold nothing but a header give no rows.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        _plain(meta["file_path"]).alias("file"),
        meta["file_name"].alias("name"),
        meta["file_modification_time"].alias("landed_at"),
        F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line")).alias("position"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
    )
    kept = store(lines.where(F.trim("value") != ""))
    tops = kept.rows.groupBy("file").agg(F.min_by("value", "position").alias("header"), F.min("position").alias("top"))
    heads = store(tops.withColumn("header", F.trim("header")))
    # a row per file, joined by Spark as its size allows
    rows = kept.rows.join(heads.rows, "file").where(F.col("position") > F.col("top"))
    headers = sorted(r["header"] for r in heads.rows.select("header").distinct().collect())
    return Landed([_parsed(rows.where(F.col("header") == h), h, ticker_pattern) for h in headers], (kept, heads))


def _parsed(rows: DataFrame, header: str, ticker_pattern: str) -> DataFrame:
    """Lines of files with this header, every column as text."""
    names = next(csv.reader([header]))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    arrival = F.struct("landed_at", "file", "position").alias("row_seq")
    out = rows.select(F.from_csv("value", fields).alias("own"), "name", arrival)
    columns = [F.col(f"own.c{i}").alias(n.strip()) for i, n in enumerate(names)]
    if "ticker" not in [n.strip().lower() for n in names]:
        columns.append(F.regexp_extract(_plain(F.col("name")), ticker_pattern, 1).alias("ticker"))
    return out.select(*columns, "row_seq")


def _plain(name):
    """File names come percent-encoded; a plus sign in them is a plus sign."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_news_payloads(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Landed response pages (JSON) to one row per article, with ``row_seq``.

    Pages without a response or without results give no rows. A page that is no
    JSON, such as a truncated one, stops the job with the name of its file; so
    does one spread over several lines, unless ``multi_line`` is set.
    """
    pages = spark.read.schema(T.StructType([*PAYLOAD.fields, T.StructField(_BROKEN, T.StringType())])).json(
        path, multiLine=multi_line, columnNameOfCorruptRecord=_BROKEN
    )
    meta = F.col("_metadata")
    refusal = F.raise_error(F.concat(F.lit("news page that cannot be read as JSON, in "), meta["file_path"]))
    readable = F.when(F.col(_BROKEN).isNotNull(), refusal.cast("boolean")).otherwise(F.lit(True))
    return explode_payloads(
        pages.where(readable).select("response", _arrival(F.monotonically_increasing_id()).alias("_page"))
    )


def explode_payloads(pages: DataFrame) -> DataFrame:
    """``response.results`` of each page to rows ``article``, ``row_seq``."""
    have_page = "_page" in pages.columns
    page = F.col("_page") if have_page else F.monotonically_increasing_id()
    return (
        pages.select(page.alias("_page"), F.posexplode("response.results").alias("_pos", "article"))
        .where("article is not null")
        .select("article", F.struct("_page", "_pos").alias("row_seq"))
    )


def _arrival(position):
    """Sortable place of a row in the landed files."""
    meta = F.col("_metadata")
    return F.struct(
        meta["file_modification_time"].alias("landed_at"),
        meta["file_path"].alias("file"),
        position.alias("position"),
    )
