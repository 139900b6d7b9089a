"""Queries over the test tables, each with the SQL that must give the same rows.

The tables stand in for market data and news: ``events`` are price ticks (the
event type is the ticker), ``orders`` a long daily series, ``documents`` articles.
"""

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.functions.parse import iso_or_null, to_number, to_utc
from tapewire.functions.text import CAUSAL, CORRELATIONAL, compose_text, path_key, with_weak_label
from tapewire.operators import columns, guards, linear, news as news_ops, prices as price_ops, report, terms
from tapewire.operators.align import asof_join, forward_prices
from tapewire.operators.bars import ohlcv_bars
from tapewire.operators.split import stratified_split, time_split
from tapewire.operators.upsert import upsert_news, upsert_prices
from tapewire.plans.build_dataset import build_dataset, prepare_news, training_set
from tapewire.plans.news_ingest import ingest_news
from tapewire.plans.price_ingest import ingest_prices
from tapewire.plans.train_baseline import fit_classifier, predict, train_baseline, usable_rows
from tapewire.session import configure, durable, shared_dir
from tapewire.sources import landed, tables
from tapewire.sources.commits import Disk
from tapewire.streaming.upserts import stream_news, stream_prices

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Phrases that occur in the invented prose at useful rates.
SAMPLE_CAUSAL = ("license", "for the")
SAMPLE_CORRELATIONAL = ("the of", "in the")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return _clock_times(fn(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _clock_times(df: DataFrame) -> DataFrame:
    """UTC clock times without a zone, as in the test tables."""
    return df.select(
        *[
            F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer parts than there are cores, as of a test table in one small file, is dealt out to all of them.

    One with more is read as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return df.withColumns(
        {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- stand-in tables ---------------------------------------------------------

_FIRST_SECOND = 1703894400  # 2023-12-30 00:00:00 UTC


def _published(by: int = 1000003):
    return F.timestamp_seconds(
        F.lit(_FIRST_SECOND) + F.pmod(F.col("doc_id") * F.lit(by), F.lit(2880000))
    )


def articles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("id/"), "doc_id").alias("id"),
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        "source",
        F.col("lang").alias("section"),
        _published().alias("published_at"),
        F.col("source").alias("title"),
        F.nullif(F.col("lang"), F.lit("en")).alias("description"),
        F.col("text").alias("body"),
        "doc_id",
    )


_PUBLISHED_SQL = "TIMESTAMP '2023-12-30' + to_seconds((doc_id * 1000003) % 2880000)"
_COMPOSED_SQL = "trim(source || ' ' || coalesce(nullif(lang, 'en'), '') || ' ' || text, {})".format(
    "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30)"
    " || chr(31) || chr(133) || chr(160) || chr(8195) || chr(12288)"
)
_ARTICLES_SQL = f"""
SELECT 'id/' || doc_id AS id, 'doc/' || doc_id AS url, source, lang AS section,
       {_PUBLISHED_SQL} AS published_at, source AS title, nullif(lang, 'en') AS description,
       text AS body, doc_id
FROM documents"""


def ticks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").alias("date"), F.col("value").alias("close"),
        "event_id",
    )


def daily_prices(spark, sf_dir, interval: str = "1d") -> DataFrame:
    return ohlcv_bars(ticks(spark, sf_dir), interval, tie="event_id", price="close")


def trading_days(spark, sf_dir) -> DataFrame:
    """Daily prices without weekends."""
    return daily_prices(spark, sf_dir).where(F.dayofweek("date").between(2, 6))


def _bars_sql(unit: str) -> str:
    return f"""
SELECT date_trunc('{unit}', ts)::TIMESTAMP AS date, first(value ORDER BY ts, event_id) AS open,
       max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
       last(value ORDER BY ts, event_id) AS adj_close, count(*)::DOUBLE AS volume,
       event_type AS ticker
FROM events GROUP BY date_trunc('{unit}', ts), event_type"""


def long_series(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("ticker"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("adj_close"),
        F.col("o_orderkey").alias("row"),
    )


def _any(column: str, phrases) -> str:
    return " OR ".join(f"contains({column}, '{p}')" for p in phrases)


def _label_sql(text: str, causal=CAUSAL, correlational=CORRELATIONAL) -> str:
    t = f"lower({text})"
    return (
        f"CASE WHEN {_any(t, causal)} THEN 'causal' "
        f"WHEN {_any(t, correlational)} THEN 'correlational' END"
    )


# --- training set ------------------------------------------------------------


def _training_sql(causal, correlational) -> str:
    return f"""
WITH bars AS ({_bars_sql('day')}),
s AS (SELECT date AS ts, adj_close AS t0, lead(adj_close, 1) OVER w AS t1,
             lead(adj_close, 3) OVER w AS t3
      FROM bars WHERE ticker = 'view' AND isodow(date) <= 5 WINDOW w AS (ORDER BY date)),
n AS (SELECT {_COMPOSED_SQL} AS text, {_label_sql(_COMPOSED_SQL, causal, correlational)} AS label,
             {_PUBLISHED_SQL} AS published_at, 'doc/' || doc_id AS url, lang AS section
      FROM documents)
SELECT n.text, n.label, n.published_at, n.url, n.section, s.t0 AS spy_t0, s.t1 AS spy_t1,
       s.t1 - s.t0 AS delta_1d, s.t3 AS spy_t3, s.t3 - s.t0 AS delta_3d
FROM n ASOF LEFT JOIN s ON n.published_at >= s.ts WHERE n.label IS NOT NULL"""


@query(_training_sql(SAMPLE_CAUSAL, SAMPLE_CORRELATIONAL))
def training_set_sample_phrases(spark, sf_dir):
    return training_set(
        articles(spark, sf_dir),
        trading_days(spark, sf_dir),
        (1, 3),
        ticker="view",
        causal=SAMPLE_CAUSAL,
        correlational=SAMPLE_CORRELATIONAL,
    )


@query(_training_sql(CAUSAL, CORRELATIONAL))
def training_set_default_phrases(spark, sf_dir):
    return training_set(articles(spark, sf_dir), trading_days(spark, sf_dir), (1, 3), ticker="view")


@query(_training_sql(SAMPLE_CAUSAL, SAMPLE_CORRELATIONAL))
def training_set_stored(spark, sf_dir):
    news, prices, out = (scratch(spark, n) for n in ("news", "prices", "train"))
    tables.save_news(news, articles(spark, sf_dir), buckets=16)
    tables.save_prices(prices, trading_days(spark, sf_dir))
    build_dataset(
        spark, news, prices, out, (1, 3), ordered=True, ticker="view",
        causal=SAMPLE_CAUSAL, correlational=SAMPLE_CORRELATIONAL,
    )
    return tables.read_training_set(spark, out)


# --- as-of join and horizons -------------------------------------------------


def _named_events(spark, sf_dir):
    """Articles that each concern one of the tickers."""
    names = F.array(*[F.lit(n) for n in ("click", "error", "purchase", "signup", "view", "none")])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        _published().alias("ts"),
        F.element_at(names, (F.pmod("doc_id", F.lit(6)) + 1).cast("int")).alias("ticker"),
    )


_ASOF_TICKS_SQL = f"""
WITH s AS (SELECT event_type AS ticker, ts, value AS t0, lead(value, 1) OVER w AS t1,
                  lead(value, 5) OVER w AS t5, event_id
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY event_id DESC) = 1),
e AS (SELECT doc_id, {_PUBLISHED_SQL} AS ts,
             ['click', 'error', 'purchase', 'signup', 'view', 'none'][doc_id % 6 + 1] AS ticker
      FROM documents)
SELECT e.doc_id, e.ts, e.ticker, u.t0, u.t1, u.t5
FROM e ASOF LEFT JOIN u ON e.ticker = u.ticker AND e.ts >= u.ts"""


def _asof_ticks(spark, sf_dir, **settings):
    prices = price_ops.price_series(ticks(spark, sf_dir), ("ticker", "event_id"))
    events = _named_events(spark, sf_dir)
    return asof_join(events, prices, (1, 5), ["ticker"], ["event_id"], **settings)


@query(_ASOF_TICKS_SQL)
def asof_join_ticks(spark, sf_dir):
    return _asof_ticks(spark, sf_dir)


@query(_ASOF_TICKS_SQL)
def asof_join_merged(spark, sf_dir):
    return _asof_ticks(spark, sf_dir, broadcast_bytes=0)


_CROWDED = "CASE WHEN event_id % 20 = 0 THEN ts ELSE {hour} END"

_ASOF_CROWDED_SQL = _ASOF_TICKS_SQL.replace(
    "FROM events WINDOW",
    "FROM (SELECT * REPLACE ("
    + _CROWDED.format(hour="TIMESTAMP '2024-01-05 12:00:00' + to_microseconds((event_id * 7919) % 3600000000)")
    + " AS ts) FROM events) WINDOW",
).replace(_PUBLISHED_SQL, f"CASE WHEN doc_id % 3 = 0 THEN {_PUBLISHED_SQL} ELSE TIMESTAMP '2024-01-05 12:00:00' + to_microseconds((doc_id * 104729) % 3600000000) END")


@query(_ASOF_CROWDED_SQL)
def asof_join_crowded(spark, sf_dir):
    """Nineteen of twenty ticks, and two of three events, within one hour; small tasks."""
    noon = F.lit("2024-01-05 12:00:00").cast("timestamp")

    def within_hour(n):
        return F.timestamp_micros(F.unix_micros(noon) + F.pmod(n, F.lit(3_600_000_000)))

    rows = ticks(spark, sf_dir)
    date = "date" if "date" in rows.columns else "ts"
    rows = rows.withColumn(date, F.when(F.col("event_id") % 20 == 0, F.col(date)).otherwise(within_hour(F.col("event_id") * 7919)))
    prices = price_ops.price_series(rows, ("ticker", "event_id"))
    events = _named_events(spark, sf_dir)
    events = events.withColumn("ts", F.when(F.col("doc_id") % 3 == 0, F.col("ts")).otherwise(within_hour(F.col("doc_id") * 104729)))
    return asof_join(events, prices, (1, 5), ["ticker"], ["event_id"], broadcast_bytes=0, rows_per_task=500)


@query(
    """
SELECT o.o_orderkey, o.o_orderdate AS ts, s.o_totalprice AS t0, s.t2
FROM (SELECT o_orderkey, o_orderdate FROM orders) o
ASOF LEFT JOIN (
  SELECT day + INTERVAL 16 HOUR AS ts, o_totalprice, lead(o_totalprice, 2) OVER (ORDER BY day) AS t2
  FROM (SELECT o_orderdate AS day, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1)) s
ON o.o_orderdate >= s.ts"""
)
def asof_join_after_session_close(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    daily = orders.groupBy(F.col("o_orderdate").alias("date")).agg(
        F.max("o_totalprice").alias("close")
    )
    prices = price_ops.price_series(daily, (), dt.timedelta(hours=16))
    events = orders.select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return asof_join(events, prices, (2,))


@query(
    """
SELECT o_orderpriority AS ticker, o_orderdate AS ts, o_totalprice AS adj_close, o_orderkey AS row,
       lead(o_orderdate) OVER w AS next_ts, lead(o_totalprice, 1) OVER w AS t1,
       lead(o_totalprice, 5) OVER w AS t5, lead(o_totalprice, 20) OVER w AS t20
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)"""
)
def prices_at_horizons(spark, sf_dir):
    return forward_prices(long_series(spark, sf_dir), (1, 5, 20), ["ticker"], ["row"])


# --- text --------------------------------------------------------------------


@query(f"SELECT doc_id, {_COMPOSED_SQL} AS text FROM documents")
def composed_text(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("doc_id", compose_text(a.columns).alias("text"))


_WEAK_SQL = "SELECT doc_id, label FROM (SELECT doc_id, {} AS label FROM documents) WHERE label IS NOT NULL"


@query(_WEAK_SQL.format(_label_sql("text")))
def weak_labels(spark, sf_dir):
    return with_weak_label(table(spark, sf_dir, "documents")).select("doc_id", "label")


@query(_WEAK_SQL.format(_label_sql("text", SAMPLE_CAUSAL, SAMPLE_CORRELATIONAL)))
def weak_labels_sample_phrases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return with_weak_label(docs, "text", SAMPLE_CAUSAL, SAMPLE_CORRELATIONAL).select("doc_id", "label")


# --- parsing and normalisation -----------------------------------------------


def _raw_prices(spark, sf_dir):
    """Ticks as a text download with the flaws such files have."""
    e = table(spark, sf_dir, "events")
    kind, value, text = F.col("event_type"), F.col("value"), F.col("value").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    date = (
        F.when(kind == "view", F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("Z")))
        .when(kind == "click", F.concat(stamp, F.lit("-05:00")))
        .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd"))
        .when((kind == "error") & (value > 200), F.lit("not a date"))
        .otherwise(F.concat(F.lit("  "), stamp))
    )
    whole = F.lpad(F.floor("value").cast("string"), 3, "0")
    return e.select(
        date.alias("Date"),
        F.concat(F.lit("1,"), whole, F.lit(".5")).alias("Open"),
        F.when(value < 30, "None").when(value < 60, "").when(value < 90, "none").otherwise(text).alias("Close"),
        F.concat(text, F.when(value > 200, "d").otherwise("")).alias("High"),
        F.concat(text, F.lit("e1")).alias("Low"),
        F.when(value < 5, "null").when(value < 9, "nan").otherwise(F.concat(F.lit(" "), text, F.lit("\t"))).alias("Adj Close"),
        F.col("event_id").cast("string").alias("Volume"),
        kind.alias("Ticker"),
        F.col("event_id").alias("row_seq"),
    )


_RAW_DATE_SQL = """CASE WHEN event_type = 'click' THEN date_trunc('second', ts) + INTERVAL 5 HOUR
     WHEN event_type = 'error' AND value > 200 THEN NULL
     WHEN event_type = 'purchase' THEN date_trunc('day', ts)::TIMESTAMP
     ELSE date_trunc('second', ts) END"""

_NORMALISED_SQL = f"""
SELECT * FROM (
  SELECT date_trunc('day', {_RAW_DATE_SQL})::TIMESTAMP AS date, 1000 + floor(value) + 0.5::DOUBLE AS open,
       CASE WHEN value <= 200 THEN value END AS high, (value::VARCHAR || 'e1')::DOUBLE AS low,
       CASE WHEN value >= 90 THEN value END AS close, CASE WHEN value >= 9 THEN value END AS adj_close,
       event_id::DOUBLE AS volume, event_type AS ticker FROM events)
WHERE date IS NOT NULL AND adj_close IS NOT NULL"""


@query(_NORMALISED_SQL)
def prices_normalised(spark, sf_dir):
    return price_ops.normalize_prices(_raw_prices(spark, sf_dir))


@query(
    f"""
SELECT event_id, {_RAW_DATE_SQL} AS parsed,
       strftime({_RAW_DATE_SQL}, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events"""
)
def timestamps_parsed(spark, sf_dir):
    raw = _raw_prices(spark, sf_dir)
    return raw.select(
        F.col("row_seq").alias("event_id"),
        to_utc(F.col("Date"), raw.schema["Date"].dataType).alias("parsed"),
        iso_or_null(F.col("Date")).alias("iso"),
    )


@query(
    """
SELECT o_orderkey, o_orderdate::TIMESTAMP AS day, o_orderdate::TIMESTAMP + INTERVAL '13 hours 5 minutes 9 seconds' AS instant,
       o_orderdate::TIMESTAMP + INTERVAL '11 hours 5 minutes' AS shifted, NULL::TIMESTAMP AS month_alone,
       strftime(o_orderdate, '%Y-%m-%dT13:05:09+00:00') AS afternoon, strftime(o_orderdate, '%Y-%m-%dT00:05:00+00:00') AS midnight
FROM orders"""
)
def compact_times_parsed(spark, sf_dir):
    """Compact ISO dates, twelve-hour clocks, and numbers that are no year."""
    orders = table(spark, sf_dir, "orders")
    day, text = F.col("o_orderdate"), T.StringType()
    return orders.select(
        "o_orderkey",
        to_utc(F.date_format(day, "yyyyMMdd"), text).alias("day"),
        to_utc(F.date_format(day, "yyyyMMdd'T130509Z'"), text).alias("instant"),
        to_utc(F.date_format(day, "yyyyMMdd'T1305+0200'"), text).alias("shifted"),
        to_utc(F.date_format(day, "yyyyMM"), text).alias("month_alone"),
        iso_or_null(F.date_format(day, "M/d/yyyy '1:05:09 PM'")).alias("afternoon"),
        iso_or_null(F.date_format(day, "MMM d, yyyy '12:05am'")).alias("midnight"),
    )


@query(
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') AS month_name,
       strftime(o_orderdate, '%Y-%m-%dT13:05:09+00:00') AS mail_header,
       strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') AS slashes FROM orders"""
)
def free_format_times(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    return orders.select(
        "o_orderkey",
        iso_or_null(F.date_format(day, "MMM d, yyyy")).alias("month_name"),
        iso_or_null(F.date_format(day, "EEE, d MMM yyyy '13:05:09' '+0000'")).alias("mail_header"),
        iso_or_null(F.date_format(day, "M/d/yyyy")).alias("slashes"),
    )


@query(
    """
SELECT event_id, CASE WHEN value <= 200 THEN value END AS suffixed, 1000 + floor(value) + 0.5::DOUBLE AS grouped,
       CASE WHEN value >= 90 THEN value END AS tokens FROM events"""
)
def numbers_parsed(spark, sf_dir):
    raw = _raw_prices(spark, sf_dir)
    text = raw.schema["High"].dataType
    return raw.select(
        F.col("row_seq").alias("event_id"),
        to_number(F.col("High"), text).alias("suffixed"),
        to_number(F.col("Open"), text).alias("grouped"),
        to_number(F.col("Close"), text).alias("tokens"),
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_shipdate AS ts, l_extendedprice AS adj_close FROM lineitem"""
)
def price_series_of_close(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("Date"),
        F.col("l_extendedprice").alias("Adj Close"),
        F.col("l_quantity").alias("close"),
    )
    return price_ops.price_series(lines, ("l_orderkey", "l_linenumber"))


@query("SELECT event_id AS date, value AS bar_high, user_id AS bar_low, props AS note FROM events")
def columns_flattened(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("Index"),
        F.struct(F.col("value").alias("High"), F.col("user_id").alias("Low_SPY")).alias("Bar"),
        F.col("props").alias("NOTE"),
    )
    return columns.rename_aliases(columns.flatten_columns(nested, "SPY"), {"date": ("date", "index")})


@query(
    """
SELECT p_partkey, 'IDX_' || p_brand AS index_key, p_brand || '_' || p_type AS future_key,
       p_brand || '_' || p_size AS pair_key FROM part"""
)
def ticker_path_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        path_key(F.concat(F.lit(" ^"), "p_brand")).alias("index_key"),
        path_key(F.concat("p_brand", F.lit("="), "p_type", F.lit("\t"))).alias("future_key"),
        path_key(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"))).alias("pair_key"),
    )


def _delivered(spark, sf_dir, key: str = "doc_id"):
    """Documents as the nested articles of a news response."""
    docs = table(spark, sf_dir, "documents")
    stamp = F.date_format(_published(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return docs.select(
        F.struct(
            F.concat(F.lit("id/"), "doc_id").alias("id"),
            F.concat(F.lit("doc/"), key).alias("webUrl"),
            F.col("lang").alias("sectionName"),
            stamp.alias("webPublicationDate"),
            F.when(
                F.col("lang") != "de",
                F.struct(
                    F.col("source").alias("headline"),
                    F.nullif(F.col("lang"), F.lit("en")).alias("trailText"),
                    F.col("text").alias("bodyText"),
                ),
            ).alias("fields"),
        ).alias("article"),
        F.col("doc_id").alias("row_seq"),
    )


_DELIVERED_SQL = f"""
SELECT 'id/' || doc_id AS id, 'doc/' || doc_id AS url, 'guardian' AS source, lang AS section,
       {_PUBLISHED_SQL} AS published_at, CASE WHEN lang <> 'de' THEN source END AS title,
       CASE WHEN lang <> 'de' THEN nullif(lang, 'en') END AS description,
       CASE WHEN lang <> 'de' THEN text END AS body
FROM documents"""


@query(_DELIVERED_SQL)
def articles_normalised(spark, sf_dir):
    return news_ops.normalize_articles(_delivered(spark, sf_dir))


@query(_DELIVERED_SQL)
def landed_pages_read(spark, sf_dir):
    """Response pages of some fifty articles each, and empty ones, written as JSON and read back."""
    path = scratch(spark, "pages")
    delivered = _delivered(spark, sf_dir)
    n_pages = max(1, -(-delivered.count() // 50))
    pages = delivered.groupBy(F.pmod(F.xxhash64("article.webUrl"), F.lit(n_pages)).alias("page")).agg(F.collect_list("article").alias("results"))
    empty = pages.limit(3).withColumn("results", F.slice("results", 1, 0))
    pages.union(empty).select(F.struct("results").alias("response")).write.json(path)
    return news_ops.normalize_articles(landed.read_news_payloads(spark, path))


# --- bars --------------------------------------------------------------------


@query(_bars_sql("hour"))
def bars_hourly(spark, sf_dir):
    return daily_prices(spark, sf_dir, "1h")


@query(_bars_sql("day"))
def bars_daily(spark, sf_dir):
    return daily_prices(spark, sf_dir)


@query(_bars_sql("week"))
def bars_weekly(spark, sf_dir):
    return daily_prices(spark, sf_dir, "1wk")


@query(
    f"""
SELECT date_trunc('month', date)::TIMESTAMP AS date, first(open ORDER BY date) AS open, max(high) AS high,
       min(low) AS low, last(close ORDER BY date) AS close, last(adj_close ORDER BY date) AS adj_close,
       sum(volume) AS volume, ticker
FROM ({_bars_sql('day')}) GROUP BY date_trunc('month', date), ticker"""
)
def bars_monthly_from_daily(spark, sf_dir):
    return ohlcv_bars(daily_prices(spark, sf_dir), "1mo")


# --- filters, pages, reports -------------------------------------------------

_NEWS_COLUMNS = "id, url, source, section, published_at, title, description, body"


@query(
    f"""SELECT {_NEWS_COLUMNS} FROM ({_ARTICLES_SQL})
WHERE published_at::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""
)
def news_in_date_window(spark, sf_dir):
    a = articles(spark, sf_dir).drop("doc_id")
    return news_ops.published_between(a, "2024-01-05", "2024-01-20")


_WORD = r"(^|[^\p{L}\p{N}_\p{M}])(%s)($|[^\p{L}\p{N}_\p{M}])"


@query(
    f"""SELECT {_NEWS_COLUMNS} FROM ({_ARTICLES_SQL})
WHERE regexp_matches(title || ' ' || coalesce(description, '') || ' ' || body, '{_WORD % "that|license|src7"}', 'i')"""
)
def news_with_keywords(spark, sf_dir):
    return news_ops.matching(articles(spark, sf_dir).drop("doc_id"), "that OR license OR src7")


@query(
    f"""SELECT {_NEWS_COLUMNS} FROM ({_ARTICLES_SQL})
ORDER BY published_at DESC, url LIMIT 150"""
)
def news_newest_pages(spark, sf_dir):
    return news_ops.newest_pages(articles(spark, sf_dir).drop("doc_id"), 3, 50)


@query(
    f"""SELECT {_NEWS_COLUMNS} FROM ({_ARTICLES_SQL})
ORDER BY published_at DESC, url LIMIT 40 OFFSET 80"""
)
def news_newest_page(spark, sf_dir):
    return news_ops.newest_page(articles(spark, sf_dir).drop("doc_id"), 3, 40)


@query(
    f"SELECT row_number() OVER (ORDER BY published_at, url) AS place, url FROM ({_ARTICLES_SQL})"
)
def news_in_time_order(spark, sf_dir):
    """Each article's place in the order of publication, counted range by range."""
    ordered = articles(spark, sf_dir).select("url", "published_at")
    ranged = durable(
        tables.in_time_order(ordered)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    before = (
        ranged.groupBy("_range")
        .count()
        .withColumn(
            "_before",
            F.sum("count").over(Window.orderBy("_range")) - F.col("count"),
        )
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_place"))
    # one row per range
    return ranged.join(F.broadcast(before), "_range").select(
        (F.col("_before") + place).alias("place"), "url"
    )


@query(
    """
SELECT o_orderdate AS date, o_totalprice AS adj_close, o_orderpriority AS ticker, o_orderkey AS row
FROM orders WHERE o_orderdate >= TIMESTAMP '1999-08-01'"""
)
def prices_in_period(spark, sf_dir):
    p = long_series(spark, sf_dir).withColumnRenamed("ts", "date")
    return price_ops.in_period(p, "2y", dt.date(2001, 8, 1)).select("date", "adj_close", "ticker", "row")


@query("SELECT ts AS date, value AS close, event_type AS ticker, event_id FROM events WHERE event_type IN ('view', 'click')")
def prices_of_tickers(spark, sf_dir):
    return price_ops.with_tickers(ticks(spark, sf_dir), " view,click ,,absent")


@query(
    f"""
SELECT ticker, count(*) AS rows, count(adj_close) AS usable_rows, min(date) AS first_date,
       max(date) AS last_date FROM ({_NORMALISED_SQL}) GROUP BY ticker"""
)
def price_ingest_report(spark, sf_dir):
    return report.ingest_report(price_ops.normalize_prices(_raw_prices(spark, sf_dir)))


@query("SELECT count(CASE WHEN value >= 90 THEN value END) AS usable_rows FROM events")
def usable_price_count(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return report.usable_count(e.select(F.when(F.col("value") >= 90, F.col("value")).alias("adj_close")))


# --- upserts -----------------------------------------------------------------


def _price_batches(spark, sf_dir):
    """Two arrivals: ticks by day, and the same ticks corrected and ten days on."""
    e = table(spark, sf_dir, "events")

    def batch(days, factor):
        value = F.col("value") * F.lit(factor)
        return e.select(
            (F.date_trunc("day", "ts") + F.make_dt_interval(F.lit(days))).alias("date"),
            value.alias("open"),
            value.alias("high"),
            value.alias("low"),
            value.alias("close"),
            F.when(F.col("value") >= 2, value).alias("adj_close"),
            F.col("event_id").cast("double").alias("volume"),
            F.col("event_type").alias("ticker"),
            F.col("event_id").alias("row_seq"),
        )

    return batch(0, 1.0), batch(10, 2.0)


_PRICE_BATCHES_SQL = """
SELECT date_trunc('day', ts)::TIMESTAMP AS date, value AS v, event_id, event_type AS ticker, 0 AS batch FROM events
UNION ALL
SELECT date_trunc('day', ts)::TIMESTAMP + INTERVAL 10 DAY, value * 2, event_id, event_type, 1 FROM events"""
_UPSERTED_PRICES_SQL = f"""
SELECT date, v AS open, v AS high, v AS low, v AS close, v AS adj_close, event_id::DOUBLE AS volume, ticker
FROM (SELECT * FROM ({_PRICE_BATCHES_SQL})
      QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY batch DESC, event_id DESC) = 1)
WHERE v >= 2 * (1 + batch)"""


@query(_UPSERTED_PRICES_SQL)
def prices_upserted(spark, sf_dir):
    return upsert_prices(*_price_batches(spark, sf_dir))


@query(_UPSERTED_PRICES_SQL)
def price_table_merged(spark, sf_dir):
    path = scratch(spark, "prices")
    for batch in _price_batches(spark, sf_dir):
        tables.save_prices(path, batch)
    return tables.read_price_table(spark, path)


_REFUSED = ("error", "signup")


@query(
    f"""
SELECT date, v AS open, v AS high, v AS low, v AS close, v AS adj_close, event_id::DOUBLE AS volume, ticker, ticker IN {_REFUSED} AS refused
FROM (SELECT * FROM ({_PRICE_BATCHES_SQL}) WHERE batch = 0 OR ticker NOT IN {_REFUSED}
      QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY batch DESC, event_id DESC) = 1)
WHERE v >= 2 * (1 + batch)"""
)
def prices_refused_by_ticker(spark, sf_dir):
    """The second arrival has no price of two tickers: these are refused and keep what is stored, the others are merged."""
    path = scratch(spark, "prices")
    first, second = _price_batches(spark, sf_dir)
    tables.save_prices(path, first)
    without = F.when(F.col("ticker") == _REFUSED[0], F.lit(float("nan"))).when(F.col("ticker") != _REFUSED[1], F.col("adj_close"))
    verdicts = tables.save_prices(path, second.withColumn("adj_close", without))
    refused = [v.ticker for v in verdicts if v.why]
    return tables.read_price_table(spark, path).withColumn("refused", F.col("ticker").isin(refused))


@query(
    """
SELECT o_orderdate::TIMESTAMP AS date, max(o_totalprice) AS adj_close, lpad((o_custkey % 7)::VARCHAR, 6, '0') AS ticker
FROM orders WHERE o_custkey % 7 IN (1, 2) GROUP BY ALL"""
)
def price_table_of_numbered_tickers(spark, sf_dir):
    """Tickers that look like numbers, two saves of different days, read by a list of tickers."""
    orders = table(spark, sf_dir, "orders")
    prices = orders.groupBy(F.col("o_orderdate").alias("date"), F.lpad((F.col("o_custkey") % 7).cast("string"), 6, "0").alias("ticker")).agg(
        F.max("o_totalprice").alias("adj_close")
    )
    path = scratch(spark, "prices")
    for odd in (0, 1):
        tables.save_prices(path, prices.where(F.dayofmonth("date") % 2 == odd))
    return tables.read_price_table(spark, path, ["000001", "000002"]).select("date", "adj_close", "ticker")


def _news_batches(spark, sf_dir):
    """Two arrivals of articles, three documents to a url, some without a date."""
    docs = table(spark, sf_dir, "documents")

    def batch(shift, factor):
        published = F.when(F.col("lang") != "es", _published(factor))
        return docs.select(
            F.col("doc_id").cast("string").alias("id"),
            F.concat(F.lit("u/"), (F.floor(F.col("doc_id") / 3) + shift).cast("string")).alias("url"),
            "source",
            F.col("lang").alias("section"),
            published.alias("published_at"),
            F.lit(str(shift)).alias("title"),
            F.lit(None).cast("string").alias("description"),
            F.col("text").alias("body"),
            F.col("doc_id").alias("row_seq"),
        )

    return batch(0, 1000003), batch(20, 7000003)


def _upserted_news_sql(nulls: str) -> str:
    def batch(n, shift, factor):
        return f"""
SELECT doc_id::VARCHAR AS id, 'u/' || (doc_id // 3 + {shift}) AS url, source, lang AS section,
       CASE WHEN lang <> 'es' THEN TIMESTAMP '2023-12-30' + to_seconds((doc_id * {factor}) % 2880000) END
         AS published_at,
       '{shift}' AS title, NULL::VARCHAR AS description, text AS body, doc_id, {n} AS batch FROM documents"""

    return f"""
SELECT {_NEWS_COLUMNS} FROM ({batch(0, 0, 1000003)} UNION ALL {batch(1, 20, 7000003)})
QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at DESC NULLS {nulls}, batch DESC, doc_id DESC) = 1"""


@query(_upserted_news_sql("LAST"))
def news_upserted(spark, sf_dir):
    return upsert_news(*_news_batches(spark, sf_dir))


@query(_upserted_news_sql("FIRST"))
def news_upserted_undated_wins(spark, sf_dir):
    return upsert_news(*_news_batches(spark, sf_dir), null_wins=True)


@query(_upserted_news_sql("LAST"))
def news_table_merged(spark, sf_dir):
    path = scratch(spark, "news")
    for batch in _news_batches(spark, sf_dir):
        tables.save_news(path, batch, buckets=16)
    return tables.read_news_table(spark, path)


@query(
    """
SELECT event_id AS row_seq, value, NULL::VARCHAR AS note, 0::BIGINT AS batch_seq FROM events
UNION ALL SELECT event_id, NULL, props, 1 FROM events"""
)
def batches_united(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.select(F.col("event_id").alias("row_seq"), "value")
    new = e.select(F.col("event_id").alias("row_seq"), F.col("props").alias("note"))
    return columns.union_batches(old, new)


@query(
    """
SELECT date, v AS open, v AS high, v AS low, v AS close, v AS adj_close, event_id::DOUBLE AS volume, ticker
FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS date, value AS v, event_id, event_type AS ticker FROM events
      QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY event_id DESC) = 1)"""
)
def price_stream_merged(spark, sf_dir):
    raw = (
        spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema)
        # a pattern, as a stream takes no single file and tables may be folders
        .parquet(f"{sf_dir}/events.parque?")
    )
    value = F.col("value")
    prices = raw.select(
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("date"),
        *[value.alias(c) for c in ("open", "high", "low", "close", "adj_close")],
        F.col("event_id").cast("double").alias("volume"),
        F.col("event_type").alias("ticker"),
        F.col("event_id").alias("row_seq"),
    )
    path = scratch(spark, "prices")
    stream_prices(prices, path, scratch(spark, "progress")).awaitTermination()
    return tables.read_price_table(spark, path)


@query(
    f"""
SELECT {_NEWS_COLUMNS} FROM (
  SELECT page_id::VARCHAR AS id, url, 'web' AS source, NULL::VARCHAR AS section,
         TIMESTAMP '2023-12-30' + to_seconds((page_id * 1000003) % 2880000) AS published_at,
         NULL::VARCHAR AS title, NULL::VARCHAR AS description, html AS body, page_id FROM pages
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_at DESC, page_id DESC) = 1)"""
)
def news_stream_merged(spark, sf_dir):
    raw = (
        spark.readStream.schema(spark.read.parquet(f"{sf_dir}/pages.parquet").schema)
        # a pattern, as a stream takes no single file and tables may be folders
        .parquet(f"{sf_dir}/pages.parque?")
    )
    published = F.timestamp_seconds(
        F.lit(_FIRST_SECOND) + F.pmod(F.col("page_id") * F.lit(1000003), F.lit(2880000))
    )
    news = raw.select(
        F.col("page_id").cast("string").alias("id"),
        "url",
        F.lit("web").alias("source"),
        published.alias("published_at"),
        F.col("html").alias("body"),
        F.col("page_id").alias("row_seq"),
    )
    path = scratch(spark, "news")
    stream_news(news, path, scratch(spark, "progress")).awaitTermination()
    return tables.read_news_table(spark, path)


# --- whole ingests -----------------------------------------------------------


@query(
    f"""
SELECT date, open, high, low, close, adj_close, volume, ticker FROM (
  SELECT date_trunc('day', {_RAW_DATE_SQL})::TIMESTAMP AS date, 1000 + floor(value) + 0.5::DOUBLE AS open,
         CASE WHEN value <= 200 THEN value END AS high, (value::VARCHAR || 'e1')::DOUBLE AS low,
         CASE WHEN value >= 90 THEN value END AS close, value AS adj_close,
         event_id::DOUBLE AS volume, event_type AS ticker, event_id
  FROM events WHERE value >= 9 AND event_type IN ('view', 'click', 'error'))
WHERE date IS NOT NULL AND date >= TIMESTAMP '2023-01-20'
QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY event_id DESC) = 1"""
)
def prices_ingested(spark, sf_dir):
    """Landed csv files of ticks, with two headers, merged into an empty table."""
    path, out = _landed_ticks(spark, sf_dir), scratch(spark, "prices")
    ingest_prices(spark, path, out, "view, click,error", "1y", dt.date(2024, 1, 20))
    return tables.read_price_table(spark, out)


def _landed_ticks(spark, sf_dir) -> list[str]:
    """Ticks of one ticker and day share a file, so that the place in the file is the order of arrival."""
    raw = _raw_prices(spark, sf_dir)
    paths = []
    for other in (False, True):
        rows = raw.where((F.col("ticker") == "click") == F.lit(other))
        day = F.to_date(to_utc(F.col("Date"), T.StringType()))  # as stored
        rows = rows.repartition("ticker", day).sortWithinPartitions("row_seq").drop("row_seq")
        if other:
            rows = rows.withColumnRenamed("Date", "Datetime").select(*reversed(rows.withColumnRenamed("Date", "Datetime").columns))
        paths.append(scratch(spark, "landed"))
        rows.write.option("header", True).option("emptyValue", "").csv(paths[-1])
    return paths


@query(
    """
SELECT date_trunc('day', ts)::TIMESTAMP AS date, value AS adj_close, event_type AS ticker FROM events WHERE event_type IN ('view', 'click')
QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY event_id DESC) = 1"""
)
def prices_named_by_file(spark, sf_dir):
    """Landed csv files without a ticker column, one folder of them, take their ticker from their names."""
    raw = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    folder = scratch(spark, "landed")
    for ticker in ("view", "click"):
        written = scratch(spark, "part")
        own = raw.where(F.col("event_type") == ticker).select(F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.col("value").alias("Adj Close"), "event_id")
        # the order of arrival in one file is the order of its lines
        own.repartitionByRange(1, "event_id").sortWithinPartitions("event_id").drop("event_id").write.option("header", True).csv(written)
        disk = Disk(spark, folder)
        part = next(n for n in disk.names(written) if n.startswith("part-"))
        disk.move(f"{written}/{part}", f"{folder}/prices_{ticker}.csv")
    path = scratch(spark, "prices")
    ingest_prices(spark, folder, path, "view,click,absent")
    return tables.read_price_table(spark, path).select("date", "adj_close", "ticker")


@query(
    f"""
SELECT {_NEWS_COLUMNS} FROM ({_DELIVERED_SQL})
WHERE published_at >= TIMESTAMP '2024-01-02'
  AND regexp_matches(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(body, ''), '{_WORD % "that|und"}', 'i')"""
)
def news_ingested(spark, sf_dir):
    path, out = scratch(spark, "landed"), scratch(spark, "news")
    pages = _delivered(spark, sf_dir).select(
        F.struct(F.array("article").alias("results")).alias("response")
    )
    pages.write.json(path)
    ingest_news(spark, path, out, "that OR und", since="2024-01-02")
    return tables.read_news_table(spark, out)


# --- guards --------------------------------------------------------------------


@query(
    """
SELECT * FROM (VALUES
  ('news without a publication time', 'refused', NULL::BIGINT, 'news must include one of the columns [''published_at''].'),
  ('prices without a date', 'used', 0, NULL),
  ('prices without a ticker', 'refused', NULL, 'prices have no ticker column, and no ticker was given.'),
  ('prices without an adjusted close', 'used', 0, NULL),
  ('series without a close', 'refused', NULL, 'prices must include one of the columns [''adj_close'', ''adj close'', ''Adj Close'', ''close'', ''Close''].'),
  ('prices of none to store', 'refused', NULL, 'none of these prices has an adjusted close; nothing was stored.'),
  ('prices without a name to store', 'refused', NULL, 'price rows without a ticker cannot be stored.'),
  ('no prices to align with', 'refused', NULL, 'the prices hold no usable row to align the news with.'),
  ('no labelled rows', 'refused', NULL, 'no labelled rows to split.'),
  ('no texts with terms', 'refused', NULL, 'no terms remain: every term is in fewer documents than min_df.')) AS g(input, outcome, rows, message)
UNION ALL SELECT 'rows with null texts or labels', 'used', count(*) FILTER (WHERE doc_id % 3 <> 0 AND lang <> 'de'), NULL FROM documents
UNION ALL SELECT 'all prices by their date', 'used', count(*), NULL FROM events"""
)
def guards_of_inputs(spark, sf_dir):
    """Tables that lack a column, hold nulls in place of texts and labels, or hold nothing, and what is made of each."""
    news, prices = articles(spark, sf_dir), ticks(spark, sf_dir).withColumnRenamed("close", "adj_close")
    labelled = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"), F.nullif("lang", F.lit("de")).alias("label")
    )
    missing = F.lit(None).cast("double")

    def stored(rows):
        path = scratch(spark, "prices")
        tables.save_prices(path, rows)
        return tables.read_price_table(spark, path)

    return guards.guarded(
        spark,
        {
            "news without a publication time": lambda: prepare_news(news.drop("published_at")),
            "prices without a date": lambda: price_ops.normalize_prices(prices.drop("date")),
            "prices without a ticker": lambda: price_ops.normalize_prices(prices.drop("ticker")),
            "prices without an adjusted close": lambda: price_ops.normalize_prices(prices.drop("adj_close")),
            "all prices by their date": lambda: price_ops.normalize_prices(prices),
            "series without a close": lambda: price_ops.price_series(prices.drop("adj_close")),
            "prices of none to store": lambda: stored(prices.withColumn("adj_close", missing)),
            "prices without a name to store": lambda: stored(prices.withColumn("ticker", F.nullif("ticker", F.lit("view")))),
            "no prices to align with": lambda: training_set(news, prices.withColumn("adj_close", missing)),
            "rows with null texts or labels": lambda: usable_rows(labelled),
            "no labelled rows": lambda: stratified_split(usable_rows(labelled.where("label is null")), "label", ["doc_id"])[0],
            "no texts with terms": lambda: terms.fit_tfidf(labelled.select(F.lit("").alias("text"))).transform(labelled),
        },
    )


# --- learning ----------------------------------------------------------------


def _spoken(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("key"), "text"
    )


def _terms_sql(source: str) -> str:
    return f"""
tokens AS (SELECT key, regexp_extract_all(lower(text), '{terms.TOKEN}') AS t FROM {source}),
grams AS (SELECT key, unnest(t) AS term FROM tokens UNION ALL
          SELECT key, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) AS term
          FROM tokens WHERE len(t) >= 2)"""


_SPOKEN_SQL = "spoken AS (SELECT conv_id || '/' || turn AS key, text FROM conversations)"
_DOCS_SQL = "docs AS (SELECT doc_id AS key, text FROM documents)"


@query(f"WITH {_SPOKEN_SQL}, {_terms_sql('spoken')} SELECT key, term, count(*) AS n FROM grams GROUP BY ALL")
def terms_by_text(spark, sf_dir):
    t = terms.terms_transformer().transform(terms.dealt(_spoken(spark, sf_dir)))
    return terms.explode_terms(t, "key").groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))


_COUNTS_SQL = "SELECT term, count(*) AS tf, count(DISTINCT key) AS df FROM grams GROUP BY term"


@query(f"WITH {_DOCS_SQL}, {_terms_sql('docs')} {_COUNTS_SQL}")
def term_frequencies(spark, sf_dir):
    return terms.term_counts(terms.terms_transformer().transform(table(spark, sf_dir, "documents")))


_VOCABULARY_SQL = "SELECT * FROM ({}) WHERE df >= 2 ORDER BY tf DESC, term LIMIT 5000".format(_COUNTS_SQL)


@query(f"WITH {_DOCS_SQL}, {_terms_sql('docs')} {_VOCABULARY_SQL}")
def vocabulary_top(spark, sf_dir):
    t = terms.terms_transformer().transform(table(spark, sf_dir, "documents"))
    return terms.vocabulary(t, max_features=5000)


@query(
    f"""
WITH {_SPOKEN_SQL}, {_terms_sql('spoken')},
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM spoken)) / (1.0 + df)) + 1.0 AS idf
      FROM ({_COUNTS_SQL}) WHERE df >= 2),
w AS (SELECT key, term, count(*) * any_value(idf) AS w FROM grams JOIN v USING (term) GROUP BY key, term)
SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM w"""
)
def tfidf_weights(spark, sf_dir):
    spoken = _spoken(spark, sf_dir)
    weights = terms.fit_tfidf(spoken)
    return terms.weights_by_term(weights, spoken, "key").withColumn("weight", F.round("weight", 6))


_SPLIT_SQL = """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT sum(n) AS total, ceil(0.2 * sum(n)) AS n_test FROM c),
x AS (SELECT lang, n, n * (total - n_test)::DOUBLE / total AS exact, total - n_test AS n_train FROM c, t),
f AS (SELECT *, floor(exact) AS whole, row_number() OVER (ORDER BY floor(exact) - exact, lang) AS place FROM x),
k AS (SELECT lang, n - whole - CASE WHEN place <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS tests FROM f)
SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || doc_id)) <= k.tests AS is_test
FROM documents d JOIN k USING (lang)"""


@query(_SPLIT_SQL)
def split_by_class(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    train, test = stratified_split(docs, "lang", ["doc_id"])
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


#: Publication times so coarse that the cut falls among articles of the same one.
_HALF_DAY_SQL = "TIMESTAMP '2023-12-30' + to_seconds((doc_id * 1000003) % 2880000 // 43200 * 43200)"


@query(
    f"""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_HALF_DAY_SQL}, md5('42:' || doc_id)) AS place, count(*) OVER () AS total FROM documents)
SELECT doc_id, CASE WHEN place > total - ceil(0.2 * total) THEN 'test' WHEN place > total - ceil(0.2 * total) - 25 THEN 'gap' ELSE 'train' END AS part,
       true AS same_again FROM o"""
)
def split_by_time(spark, sf_dir):
    """The last fifth for testing after a gap of 25 articles; the parts do not hang on the partitions that come in."""
    seconds = F.pmod(F.col("doc_id") * F.lit(1000003), F.lit(2880000))
    published = F.timestamp_seconds(F.lit(_FIRST_SECOND) + F.floor(seconds / 43200) * 43200)
    docs = durable(table(spark, sf_dir, "documents").select("doc_id", published.alias("published_at")))

    def parts(rows):
        train, test = time_split(rows, key=["doc_id"], gap=25)
        return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))

    one, again = parts(docs), parts(docs.repartition(7, F.col("doc_id") % 3))
    both = docs.join(one.select("doc_id", "part"), "doc_id", "left").join(again.select("doc_id", F.col("part").alias("other")), "doc_id", "left")
    return both.select("doc_id", F.coalesce("part", F.lit("gap")).alias("part"), F.col("part").eqNullSafe(F.col("other")).alias("same_again"))


@query(
    """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT sum(n) AS total, ceil(0.2 * sum(n)) AS n_test FROM c),
x AS (SELECT lang, n, n * (total - n_test)::DOUBLE / total AS exact, total - n_test AS n_train FROM c, t),
f AS (SELECT *, floor(exact) AS whole, row_number() OVER (ORDER BY floor(exact) - exact, lang) AS place FROM x),
k AS (SELECT lang, n, (n - whole - CASE WHEN place <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS tests FROM f)
SELECT lang, n - tests AS train_rows, tests AS test_rows, n - tests AS same_train_rows FROM k"""
)
def split_of_repeated_keys(spark, sf_dir):
    """Twenty keys for all rows; the rows that come out do not hang on the partitions that come in."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"))
    train, test = stratified_split(docs, "lang", ["source"])
    again, _ = stratified_split(docs.repartition(7, "doc_id"), "lang", ["source"])
    one = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).unionByName(again.withColumn("part", F.lit("again")))
    counted = one.groupBy("lang", "source", "doc_id").agg(
        *[F.count_if(F.col("part") == p).alias(p) for p in ("train", "test", "again")]
    )
    return counted.groupBy("lang").agg(
        F.sum("train").alias("train_rows"),
        F.sum("test").alias("test_rows"),
        F.sum(F.least("train", "again")).alias("same_train_rows"),
    )


def _scored(spark, sf_dir):
    """Document quality as the truth, length and language as a fixed prediction."""
    docs = table(spark, sf_dir, "documents")
    guess = F.when(F.col("lang") == "de", "2").when(F.col("n_chars") > 1500, "1").otherwise("0")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(F.col("quality").cast("string").alias("label"), guess.alias("prediction"))
    )


@query(
    """
WITH s AS (SELECT quality::VARCHAR AS t, CASE WHEN lang = 'de' THEN '2' WHEN n_chars > 1500 THEN '1' ELSE '0' END AS p
           FROM labels JOIN documents USING (doc_id)),
c AS (SELECT name, (SELECT count(*) FROM s WHERE t = name) AS support,
             (SELECT count(*) FROM s WHERE p = name) AS predicted,
             (SELECT count(*) FROM s WHERE t = name AND p = name) AS hits
      FROM (SELECT t AS name FROM s UNION SELECT p FROM s)),
r AS (SELECT name, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
             CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
             CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1_score,
             support, hits FROM c),
a AS (SELECT name, precision, recall, f1_score, support FROM r
UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1_score * support) / sum(support), sum(support) FROM r)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score,
       support::BIGINT AS support FROM a"""
)
def class_report(spark, sf_dir):
    r = report.classification_report(_scored(spark, sf_dir))
    return r.select("name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


def _quality_rows(spark, sf_dir):
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents"), "doc_id")
        .select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    )


_QUALITY_SPLIT_SQL = """
r AS (SELECT doc_id, quality::VARCHAR AS label FROM labels JOIN documents USING (doc_id)),
c AS (SELECT label, count(*) AS n FROM r GROUP BY label),
t AS (SELECT sum(n) AS total, ceil(0.2 * sum(n)) AS n_test FROM c),
x AS (SELECT label, n, n * (total - n_test)::DOUBLE / total AS exact, total - n_test AS n_train FROM c, t),
f AS (SELECT *, floor(exact) AS whole, row_number() OVER (ORDER BY floor(exact) - exact, label) AS place FROM x),
k AS (SELECT label, n - whole - CASE WHEN place <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS tests FROM f),
e AS (SELECT doc_id, label FROM r JOIN k USING (label)
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id)) <= any_value(tests) OVER (PARTITION BY label))"""


@query(f"WITH {_QUALITY_SPLIT_SQL} SELECT doc_id, label, true AS known_class FROM e")
def baseline_test_rows(spark, sf_dir):
    """The test rows, each with a class of the training rows predicted for it."""
    predictions = baseline_predictions(spark, sf_dir)
    return predictions.select("doc_id", "label", F.col("prediction").isin("0", "1").alias("known_class"))


@query(
    f"""WITH {_QUALITY_SPLIT_SQL}
SELECT label AS name, count(*)::BIGINT AS support FROM e GROUP BY label
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), count(*)::BIGINT FROM e"""
)
def baseline_supports(spark, sf_dir):
    return baseline_report(spark, sf_dir).select("name", "support")


def _fitted(spark, sf_dir):
    """Train rows, their weights by term, and the model that they fit, as a table."""
    train, _ = stratified_split(durable(usable_rows(_quality_rows(spark, sf_dir))), "label", ["doc_id"])
    train = durable(train)
    weights = terms.fit_tfidf(train)
    features = durable(terms.weights_by_term(weights, train, "doc_id"))
    model = durable(linear.model_table(fit_classifier(train, tolerance=1e-9), spark))
    return train.select("doc_id", "label"), features, model, weights.documents


_TRAIN_TERMS_SQL = f"""
{_QUALITY_SPLIT_SQL},
train AS (SELECT doc_id AS key, text, r.label FROM r JOIN documents USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM e)),
{_terms_sql('train')},
v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM train)) / (1.0 + df)) + 1.0 AS idf
      FROM ({_COUNTS_SQL}) WHERE df >= 2 ORDER BY tf DESC, term LIMIT {terms.MAX_FEATURES}),
w AS (SELECT key, term, count(*) * any_value(idf) AS w FROM grams JOIN v USING (term) GROUP BY key, term),
u AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM w)"""


@query(
    f"""
WITH {_TRAIN_TERMS_SQL},
s AS (SELECT term, sum(CASE WHEN label = '1' THEN u.w ELSE 0 END) AS observed FROM u JOIN train USING (key) GROUP BY term
      UNION ALL SELECT '', sum((label = '1')::INT) FROM train)
SELECT '1' AS class, term, round(observed, 6) AS observed, true AS flat FROM s UNION ALL SELECT '0', '', (SELECT sum((label = '0')::INT)::DOUBLE FROM train), true"""
)
def baseline_gradient(spark, sf_dir):
    """At the fitted weights the penalised loss is flat in the direction of every weight.

    For each term the features of the rows of class 1 sum up to what the model expects there and the pull of the
    penalty; only the minimum has that. A model without term weights is off by up to a hundred times the limit.
    """
    rows, features, model, n = _fitted(spark, sf_dir)
    found = linear.slopes(rows, features, model, "doc_id", 1.0 / n)
    return found.select("class", "term", F.round("observed", 6).alias("observed"), (F.abs("slope") < FLAT).alias("flat"))


#: Largest slope of the loss, per row, that counts as none.
FLAT = 1e-4


def _stored_weights(spark, features, rows):
    """A model that SQL can follow: how much more of a term the rows of class 1 have than those of class 0."""
    summed = features.join(rows, "doc_id").groupBy("term").agg(
        *[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(f"of_{c}") for c in "01"]
    )
    weighted = summed.select(F.lit("1").alias("class"), "term", F.log((F.col("of_1") + 1) / (F.col("of_0") + 1)).alias("weight"))
    intercepts = spark.createDataFrame([("0", linear.INTERCEPT, 0.0), ("1", linear.INTERCEPT, 0.125)], "class string, term string, weight double")
    return durable(weighted.union(intercepts))


def _scored_test_rows(spark, sf_dir):
    train, test = stratified_split(durable(usable_rows(_quality_rows(spark, sf_dir))), "label", ["doc_id"])
    train, test = durable(train), durable(test)
    weights = terms.fit_tfidf(train)
    model = _stored_weights(spark, terms.weights_by_term(weights, train, "doc_id"), train.select("doc_id", "label"))
    scores = linear.margins(test, terms.weights_by_term(weights, test, "doc_id"), model, "doc_id")
    return test.select("doc_id", "label"), durable(scores)


_SCORES_SQL = f"""
{_TRAIN_TERMS_SQL},
m AS (SELECT term, ln((sum(CASE WHEN label = '1' THEN u.w ELSE 0 END) + 1) / (sum(CASE WHEN label = '0' THEN u.w ELSE 0 END) + 1)) AS weight
      FROM u JOIN train USING (key) GROUP BY term),
test AS (SELECT doc_id AS key, text, label FROM e JOIN documents USING (doc_id)),
tt AS (SELECT key, regexp_extract_all(lower(text), '{terms.TOKEN}') AS t FROM test),
tg AS (SELECT key, unnest(t) AS term FROM tt UNION ALL
       SELECT key, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) AS term FROM tt WHERE len(t) >= 2),
tw AS (SELECT key, term, count(*) * any_value(idf) AS w FROM tg JOIN v USING (term) GROUP BY key, term),
tu AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM tw),
ts AS (SELECT key, sum(w * weight) AS s FROM tu JOIN m USING (term) GROUP BY key),
scored AS (SELECT key AS doc_id, label, 0.125 + coalesce(s, 0) AS margin FROM test LEFT JOIN ts USING (key))"""


@query(
    f"""WITH {_SCORES_SQL}
SELECT doc_id, '1' AS class, round(margin, 6) AS margin FROM scored UNION ALL SELECT doc_id, '0', 0 FROM scored"""
)
def baseline_scores(spark, sf_dir):
    """Margins of the test rows under a stored table of weights, by join and sum."""
    _, scores = _scored_test_rows(spark, sf_dir)
    return scores.select("doc_id", "class", F.round("margin", 6).alias("margin"))


@query(
    f"""WITH {_SCORES_SQL},
guess AS (SELECT label AS t, CASE WHEN margin > 0 THEN '1' ELSE '0' END AS p FROM scored),
counted AS (SELECT name, (SELECT count(*) FROM guess WHERE t = name) AS support, (SELECT count(*) FROM guess WHERE p = name) AS predicted,
             (SELECT count(*) FROM guess WHERE t = name AND p = name) AS hits FROM (SELECT t AS name FROM guess UNION SELECT p FROM guess)),
rated AS (SELECT name, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
             CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1_score, support, hits FROM counted),
a AS (SELECT name, precision, recall, f1_score, support FROM rated
UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM rated
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM rated
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support) FROM rated)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support::BIGINT AS support FROM a"""
)
def baseline_scores_report(spark, sf_dir):
    """Precision, recall and F1 of the predictions that the stored scores make."""
    rows, scores = _scored_test_rows(spark, sf_dir)
    found = durable(linear.predicted(scores, "doc_id").join(rows, "doc_id"))
    made = report.classification_report(found)
    return made.select("name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query(f"WITH {_QUALITY_SPLIT_SQL} SELECT doc_id, label, true AS same_by_table FROM e")
def baseline_table_predictions(spark, sf_dir):
    """The fitted pipeline and its weights as a table predict the same class for every test row."""
    rows = durable(usable_rows(_quality_rows(spark, sf_dir)))
    train, test = stratified_split(rows, "label", ["doc_id"])
    train, test = durable(train), durable(test)
    model, weights = fit_classifier(train), terms.fit_tfidf(train)
    scores = linear.margins(test, terms.weights_by_term(weights, test, "doc_id"), linear.model_table(model, spark), "doc_id")
    by_table = linear.predicted(scores, "doc_id").withColumnRenamed("prediction", "by_table")
    found = predict(model, test).join(by_table, "doc_id")
    return found.select("doc_id", "label", (F.col("prediction") == F.col("by_table")).alias("same_by_table"))


@query()
def baseline_predictions(spark, sf_dir):
    return train_baseline(_quality_rows(spark, sf_dir), ["doc_id"]).predictions


@query()
def baseline_report(spark, sf_dir):
    return train_baseline(_quality_rows(spark, sf_dir), ["doc_id"]).report
