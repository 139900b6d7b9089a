"""Stored tables: prices by ticker, news by url bucket, training sets.

Both keyed tables are merged on write. The partitions an incoming batch touches
are read, merged with the batch and written anew; the rest of the table is neither
read nor written. The new files count from one moment on, for all partitions at once
(see ``commits``); a job that fails before that leaves the table as it was. Of two writers
at a time the later one fails.
"""

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.functions.parse import to_utc
from tapewire.functions.text import path_key
from tapewire.operators.columns import align
from tapewire.operators.upsert import upsert_news, upsert_prices
from tapewire.schemas import NEWS, PRICES
from tapewire.session import store
from tapewire.sources.commits import Disk, FileList, commit, newest

BUCKETS = 256
_BUCKET_COLUMN = "url_bucket_of_"


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_time_order(df: DataFrame, time: str = "published_at", tie: str = "url") -> DataFrame:
    """Rows in ascending order of time over all partitions, many with the same time included."""
    order = [c for c in (time, tie) if c in df.columns]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_training_set(
    df: DataFrame, path: str, ordered: bool = False, watch: Observation | None = None, *metrics: Column
) -> None:
    """Write the rows, by publication time if ``ordered``; ``watch`` gets ``metrics``."""
    if ordered:
        df = in_time_order(df)
    if watch is not None:
        # after the ranges, for which Spark reads the rows an extra time
        df = df.observe(watch, *metrics)
    df.write.mode("overwrite").parquet(path)


def _text_paths(schema: T.StructType) -> T.StructType:
    """Ticker paths are text, whatever they look like."""
    return T.StructType([T.StructField(f.name, T.StringType() if f.name == "ticker_path" else f.dataType) for f in schema])


def _read_files(spark: SparkSession, path: str, kind: T.StructType, parts: Sequence[str], files: Sequence[str]) -> DataFrame:
    """These files of a table, with its partition columns."""
    extra = [T.StructField(p, T.StringType() if p == "ticker_path" else T.IntegerType()) for p in parts]
    schema = T.StructType([*kind.fields, *extra])
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path.rstrip('/')}/{f}" for f in files])


def _read_split(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """All of a table: by its list, or where it has none, every parquet file in its folder."""
    listed = newest(Disk(spark, path))
    if listed is not None:
        return _read_files(spark, path, kind, listed.parts, listed.files)
    return spark.read.schema(_text_paths(spark.read.parquet(path).schema)).parquet(path)


def read_price_table(
    spark: SparkSession, path: str, tickers: Sequence[str] | None = None
) -> DataFrame:
    """A price table of this package, or plain parquet files with prices in them.

    With ``tickers`` only their rows, and of a split table only their folders. The rows are those at the
    time of this call, also if the table is merged into afterwards; they can be read until the merge after that.
    """
    raw = _read_split(spark, path, PRICES)
    split = "ticker_path" in raw.columns
    if tickers is not None and split:
        raw = raw.where(F.col("ticker_path").isin([path_key(F.lit(t)) for t in tickers]))
    if tickers is not None and "ticker" in raw.columns:
        raw = raw.where(F.col("ticker").isin(*tickers))
    return raw.drop("ticker_path", "year") if split else raw


def read_news_table(spark: SparkSession, path: str) -> DataFrame:
    """A news table of this package, or plain parquet files with articles in them; see ``read_price_table``."""
    raw = _read_split(spark, path, NEWS)
    return raw.drop(*[c for c in raw.columns if c.startswith(_BUCKET_COLUMN)])


@dataclass(frozen=True)
class _Layout:
    """Partition columns of a stored table, derived from its data columns."""

    parts: dict[str, Column]

    def add(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.parts)

    @property
    def names(self) -> list[str]:
        return list(self.parts)

    def folder(self, spark: SparkSession, row: T.Row) -> str:
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{n}={escape(str(row[n]))}" for n in self.names)

    def write(self, df: DataFrame, path: str, sort: list[str]) -> None:
        (
            df.hint("rebalance", *[F.col(n) for n in self.names])
            .sortWithinPartitions(*self.names, *sort)
            .write.partitionBy(*self.names)
            .parquet(path)
        )


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put a written folder in place of another, which goes only after that."""
    disk, path = Disk(spark, path), path.rstrip("/")
    old = f"{new}-old"
    if disk.exists(path):
        disk.move(path, old)
    disk.move(new, path)
    disk.remove(old)


def _there(spark: SparkSession, path: str) -> FileList | None:
    """The list of a table, made from its folder where it has none yet; None where there is no table."""
    disk = Disk(spark, path)
    listed = newest(disk)
    if listed is not None or _columns_of(spark, path) is None:
        return listed
    found = _read_split(spark, path, PRICES)
    files = disk.data_files(path)
    parts = list(dict.fromkeys(p.split("=", 1)[0] for f in files for p in f.split("/")[:-1]))
    names = {}
    if "ticker_path" in parts:
        # one row per ticker, once in the life of a table
        names = {r["ticker_path"]: r["ticker"] for r in found.select("ticker_path", "ticker").distinct().collect()}
    return FileList(0, parts, files, names)


def _merge_into(
    path: str, layout: _Layout, there: FileList | None, keys: list[T.Row], merge, schema: T.StructType, sort: list[str],
    names: dict[str, str] | None = None, batch: tuple[str, int] | None = None,
) -> None:
    """Rewrite the partitions that ``keys`` list. ``merge`` gets the rows stored in them, or None.

    The list of touched partitions is on the driver, since the files of each are moved by name.
    """
    spark = SparkSession.getActiveSession()
    path = path.rstrip("/")
    disk, now = Disk(spark, path), there or FileList(0, layout.names)
    folders = sorted({layout.folder(spark, k) for k in keys})
    stored = now.of_folders(folders)
    old = _read_files(spark, path, schema, layout.names, stored) if stored else None
    new = f"{path}.incoming-{uuid.uuid4().hex}"
    try:
        layout.write(align(merge(old), schema, layout.names), new, sort)
        added = disk.data_files(new)
        for file in added:
            disk.move(f"{new}/{file}", f"{path}/{file}")
    finally:
        disk.remove(new)
    gone = set(stored)
    after = FileList(
        0, layout.names, [f for f in now.files if f not in gone] + added, now.names | (names or {}), now.batches | ({batch[0]: batch[1]} if batch else {})
    )
    commit(disk, there, after)


def _price_layout(by_year: bool) -> _Layout:
    parts = {"ticker_path": path_key(F.col("ticker"))}
    if by_year:
        parts["year"] = F.year("date")
    return _Layout(parts)


def _news_layout(buckets: int) -> _Layout:
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    return _Layout({f"{_BUCKET_COLUMN}{buckets}": bucket})


def _columns_of(spark: SparkSession, path: str) -> list[str] | None:
    """Columns of the stored table, or None where there is none. An unreadable one raises."""
    try:
        return spark.read.parquet(path).columns
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass(frozen=True)
class Verdict:
    """What became of a ticker's rows in a merge: stored, or not, and ``why``."""

    ticker: str
    rows: int
    usable_rows: int
    first_date: dt.datetime
    last_date: dt.datetime
    why: str | None = None


_NO_PRICE = "no row with an adjusted close"


def save_prices(
    path: str, incoming: DataFrame, by_year: bool = False, skip_shared: bool = False, batch: tuple[str, int] | None = None
) -> list[Verdict]:
    """Merge prices into the table, the last arrival winning per date and ticker.

    The table is split by ticker. ``by_year`` splits it by year as well, which
    pays for ticks and not for daily prices: a batch then rewrites the current
    year of its tickers only. A table stays as it began.

    Each ticker is judged by itself. One without any usable row in ``incoming`` is refused: what is stored of it stays, and
    the others are merged. Where all are refused, ValueError is raised. So it is for rows without a ticker, and for tickers
    that would share a folder with others, unless ``skip_shared`` leaves these out.

    ``batch`` is the name of a stream and the number of its micro-batch; one that was merged before is passed over.
    Returns a verdict for each ticker; the driver holds these, as it holds the partitions to be rewritten.
    """
    spark = incoming.sparkSession
    there = _there(spark, path)
    if there is not None:
        if "ticker_path" not in there.parts:
            raise ValueError(f"{path} is no price table of this layout.")
        if there.has_merged(batch):
            return []
        by_year = "year" in there.parts
    layout = _price_layout(by_year)
    arrived = store(layout.add(incoming).where("date is not null"))
    try:
        keys, verdicts = _judged(arrived.rows, layout, there, skip_shared)
        refused = [v.ticker for v in verdicts if v.why]
        rows = arrived.rows
        if refused:
            known = spark.createDataFrame([(t,) for t in refused], "ticker string")
            rows = rows.join(F.broadcast(known), "ticker", "left_anti")
        names = {k["ticker_path"]: k["ticker"] for k in keys}
        _merge_into(path, layout, there, keys, lambda old: upsert_prices(old, rows), PRICES, ["date"], names, batch)
        return verdicts
    finally:
        arrived.drop()


def _judged(batch: DataFrame, layout: _Layout, there: FileList | None, skip_shared: bool) -> tuple[list[T.Row], list[Verdict]]:
    """The partitions of the tickers that pass, and the verdicts on all."""
    keys = batch.groupBy("ticker", *layout.names).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.nanvl("adj_close", F.lit(None).cast("double"))).alias("usable"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    ).collect()  # a row per partition to be rewritten
    if any(k["ticker"] is None for k in keys):
        raise ValueError("price rows without a ticker cannot be stored.")
    by_ticker: dict[str, list[T.Row]] = {}
    for k in keys:
        by_ticker.setdefault(k["ticker"], []).append(k)
    usable = {t: sum(k["usable"] for k in own) for t, own in by_ticker.items()}
    on_path: dict[str, set[str]] = {}
    for t, own in by_ticker.items():
        if usable[t]:
            on_path.setdefault(own[0]["ticker_path"], set()).add(t)
    for path, names in on_path.items():
        if there is not None and path in there.names:
            names.add(there.names[path])
    shared = {path: sorted(names) for path, names in on_path.items() if len(names) > 1}
    if shared and not skip_shared:
        raise ValueError("; ".join(f"tickers {names[0]!r} and {names[-1]!r} share the path {p!r}" for p, names in sorted(shared.items())))
    verdicts = []
    for t, own in sorted(by_ticker.items()):
        path = own[0]["ticker_path"]
        others = [n for n in shared.get(path, []) if n != t]
        why = _NO_PRICE if not usable[t] else f"shares the path {path!r} with {', '.join(map(repr, others))}" if others else None
        verdicts.append(Verdict(t, sum(k["rows"] for k in own), usable[t], min(k["first"] for k in own), max(k["last"] for k in own), why))
    if not any(usable.values()):
        raise ValueError("none of these prices has an adjusted close; nothing was stored.")
    passed = {v.ticker for v in verdicts if not v.why}
    return [k for k in keys if k["ticker"] in passed], verdicts


def save_news(
    path: str, incoming: DataFrame, null_wins: bool = False, buckets: int = BUCKETS, batch: tuple[str, int] | None = None
) -> bool:
    """Merge articles into the table, one row per url; False if there were none, or if the ``batch`` was merged before.

    A url always falls into the same of ``buckets`` partitions. The number is
    part of the partition column's name; a table keeps the one it began with. A
    batch rewrites the buckets it has urls for, so large tables that take small
    batches want many: about as many as rewrite files of a hundred megabytes.
    """
    spark = incoming.sparkSession
    there = _there(spark, path)
    if there is not None:
        names = [c for c in there.parts if c.startswith(_BUCKET_COLUMN)]
        if not names:
            raise ValueError(f"{path} is no news table of this layout.")
        if there.has_merged(batch):
            return False
        buckets = int(names[0].rsplit("_", 1)[1])
    layout = _news_layout(buckets)
    published = to_utc(F.col("published_at"), incoming.schema["published_at"].dataType)
    arrived = store(layout.add(incoming.withColumn("published_at", published)))
    try:
        keys = arrived.rows.select(*layout.names).distinct().collect()  # at most as many as buckets
        if not keys:
            return False
        _merge_into(path, layout, there, keys, lambda old: upsert_news(old, arrived.rows, null_wins), NEWS, ["url"], batch=batch)
        return True
    finally:
        arrived.drop()
