"""Shards by jump consistent hashing."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the key hash in which the rows of a shard are numbered side by side.
RANGES = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jump consistent hash, all keys at once.

    Growing from n to n + 1 shards moves a key with probability 1/(n + 1), and only into
    shard n. No table of ring points is kept.
    """
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while len(open_ := np.flatnonzero(ahead < shards)):
        shard[open_] = ahead[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[open_] = ((shard[open_] + 1) * step).astype(np.int64)
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """``jump`` as a column."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(key)


def jump_shards(key: Column, shards: int) -> Column:
    """The shard among ``shards`` and among one more, as a struct of shard and grown_shard."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("shard int, grown_shard int")
    def of(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy(np.int64)
        return pd.DataFrame({"shard": jump(k, shards).astype(np.int32), "grown_shard": jump(k, shards + 1).astype(np.int32)})

    return of(key)


def stable_key(id_: Column) -> Column:
    """64 bits that depend on the id alone; a null id has a key of its own."""
    return F.xxhash64(F.coalesce(id_.cast("long"), F.lit(-1)), id_.isNull())


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and position of every document; the id and the number of shards decide.

    Positions (``slot``) run from 0 without gaps in each shard, in the order of key range,
    id, checksum and size, so the same rows always get the same places. Rows are counted by
    shard and key range first, from the id column alone; each range is then numbered by
    itself after the rows of the ranges before it. No text is shuffled. The counts, which
    are broadcast, are at most ``shards * RANGES`` rows.

    Returns doc_id, size (UTF-8 bytes, null none, plus 1), text_crc32, law, shard, slot,
    grown_shard (with one shard more). A null text counts as empty. Rows with the same id
    go to the same shard, each with a slot of its own; null ids are one key.
    """
    key = stable_key(F.col(id_col))
    part = F.pmod(F.shiftright(key, 40), F.lit(RANGES)).cast("int")
    counts = (
        docs.select(jump_shard(key, shards).alias("shard"), part.alias("part")).groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
        part.alias("part"),
    )
    rows = rows.select(
        "doc_id", "size", "text_crc32", "part", jump_shards(F.col("key"), shards).alias("of")
    ).select("doc_id", "size", "text_crc32", "part", "of.shard", "of.grown_shard")
    place = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(place) - 1)
    return placed.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("place")).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """Write the documents, all columns, as one folder per shard under ``path``.

    The folders are named ``__shard=0`` and so on, with more underscores where the documents have such a column.
    """
    name = "__shard"
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    placed = docs.withColumn(name, jump_shard(stable_key(F.col(id_col)), shards))
    placed.write.partitionBy(name).mode("errorifexists").parquet(path)
