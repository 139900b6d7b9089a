"""Benchmark items inside documents: MinHash containment search by item size, verified on the shingles themselves."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.utf8 import Words, mix, raw, slices, words
from tapewire.session import durable

WORDS = 5
THRESHOLD = 0.8
#: Bits of each of the two filters that every task gets, whatever the number of items. A crowded filter
#: lets more shingles through to the join, and changes no result.
FILTER_BITS = 1 << 25
_BLOCK = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, past-last word and hash of each shingle; a text with fewer words is one shingle."""
    hashes = w.hashes()
    at = w.windows(width)
    found = [(at, at + width, w.window_hashes(width, at, hashes))]
    short = np.flatnonzero((w.count() > 0) & (w.count() < width))
    for n in np.unique(w.count()[short]):
        own = w.first[short[w.count()[short] == n]]
        found.append((own, own + n, w.window_hashes(int(n), own, hashes)))
    first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(first, kind="stable")
    return first[order], last[order], h[order]


def _text(w: Words, first: int, last: int) -> str:
    return b" ".join(w.data[w.start[first] : w.end[last - 1]].tobytes().split()).decode()


def _lowered(batch: pa.RecordBatch) -> Words:
    data, bounds = raw(batch.column("text"))
    return words(_LOWER[data], bounds)


def sketch_rank(hashes: np.ndarray) -> np.ndarray:
    """The MinHash order, from 0 to 2^63: independent of the bits that place a shingle in a filter."""
    return mix(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(1)


def of_class(hashes: np.ndarray, size_class: int) -> np.ndarray:
    """A shingle as a member of the sketches of one size class."""
    return mix(hashes + np.uint64(size_class))


def sketch_size(n: int, threshold: float) -> int:
    """How many of ``n`` shingles any document that holds the needed share must share one of."""
    return n - needed(n, threshold) + 1


def needed(n: int, threshold: float) -> int:
    return max(1, int(np.ceil(round(threshold * n, 9))))


def _item_shingles(width: int, threshold: float):
    """Distinct shingles of each item; those of the smallest rank are its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = _lowered(batch)
            first, last, h = shingles(w, width)
            rows = [[] for _ in range(8)]
            cuts = np.searchsorted(w.doc[first], np.arange(batch.num_rows + 1))
            for i in range(batch.num_rows):
                own = range(cuts[i], cuts[i + 1])
                texts = {_text(w, first[j], last[j]): h[j] for j in own}
                if not texts:
                    continue
                ranks = dict(zip(texts, sketch_rank(np.array(list(texts.values()), np.uint64)).tolist(), strict=True))
                n = len(texts)
                top = sorted(ranks.values())[sketch_size(n, threshold) - 1]
                for t, x in texts.items():
                    row = (i, t, int(x.view(np.int64)), ranks[t], ranks[t] <= top, n, needed(n, threshold), n.bit_length())
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            at = pa.array(rows[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(at), batch.column("item_no").take(at), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.bool_()), *(pa.array(r, pa.int32()) for r in rows[5:])],
                names=["item_id", "item_no", "shingle", "hash", "rank", "in_sketch", "n_item", "n_needed", "size_class"],
            )

    return run


_ITEMS = "item_id long, item_no long, shingle string, hash long, rank long, in_sketch boolean, n_item int, n_needed int, size_class int"


def item_shingles(items: DataFrame, width: int = WORDS, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The shingle table of the items; rows with the same id and text count once."""
    slim = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("item_no", F.xxhash64("text")).distinct()
    return slim.mapInArrow(_item_shingles(width, threshold), _ITEMS)


# --- filters -----------------------------------------------------------------


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each hash."""
    return np.concatenate([hashes % np.uint64(bits), (hashes >> np.uint64(29)) % np.uint64(bits)]).astype(np.int64)


def _within(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for place in _places(hashes, 8 * len(filter_)).reshape(2, -1):
        found &= (filter_[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return found


def shingle_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of the column ``hash``, within ``size_class`` if that is there, made block by block on the executors.

    ``bits / 8`` bytes reach the driver.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("hash").to_numpy().view(np.uint64)
            if "size_class" in batch.schema.names:
                h = of_class(h, batch.column("size_class").to_numpy().astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(h, bits)))], names=["place"])

    def block(table: pa.Table) -> pa.Table:
        at = table.column("place").to_numpy()
        own = np.zeros(_BLOCK, bool)
        own[at % _BLOCK] = True
        return pa.table({"block": pa.array([int(at[0]) // _BLOCK], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    placed = hashes.mapInArrow(places, "place long").distinct()
    rows = placed.groupBy(F.expr(f"place div {_BLOCK}").alias("b")).applyInArrow(block, "block long, bits binary")
    found = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():
        lo = row["block"] * (_BLOCK // 8)
        found[lo : lo + _BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return found


# --- search ------------------------------------------------------------------


def _search(width: int, shared):
    """Of documents with a shingle of some item's sketch, the shingles that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, sketch, ceilings = shared.value
        for batch in slices(batches):
            w = _lowered(batch)
            first, last, h = shingles(w, width)
            at = np.flatnonzero(_within(whole, h))
            rank, begun = sketch_rank(h[at]), np.zeros(len(at), bool)
            for size_class, ceiling in ceilings.items():
                low = np.flatnonzero(rank <= np.uint64(ceiling))
                begun[low] |= _within(sketch, of_class(h[at[low]], size_class))
            at = at[np.isin(w.doc[first[at]], w.doc[first[at[begun]]])]
            at = at[np.unique(np.stack([w.doc[first[at]].astype(np.uint64), h[at]]), axis=1, return_index=True)[1]] if len(at) else at
            rows = pa.array(w.doc[first[at]].astype(np.int32))
            texts = [_text(w, first[j], last[j]) for j in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(texts, pa.string())], names=["doc_id", "text_hash", "shingle"]
            )

    return run


def find_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Items of which a document holds at least ``threshold`` of the distinct word shingles.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text with fewer
    than ``width`` words is one shingle.

    Containment, other than similarity, does not fall with a document's length, so only items are sketched.
    An item of n shingles may miss n - needed(n); its sketch is one shingle more, those of the smallest
    MinHash rank, and every document that holds enough of the item holds one of them. Items are parted
    by size (powers of two), and each part has its own ceiling of ranks, above which no sketch reaches. A document with no shingle in a sketch is done with
    after one look at its shingles; of the others the shingles that items have meet the sketches by their text,
    and only pairs that share a sketch shingle are verified by counting all they share.

    Documents are read once and no text is shuffled. Two filters of fixed size are broadcast. Null and
    empty texts hold nothing. Rows with the same id and text count once, those with the same id and another
    text for themselves; null ids are kept. Returns doc_id, item_id, n_shared, n_item, containment.
    """
    spark = docs.sparkSession
    index = durable(item_shingles(items, width, threshold, item_id_col, item_text_col))
    top = index.where("in_sketch")
    ceilings = {r["size_class"]: r["ceiling"] for r in top.groupBy("size_class").agg(F.max("rank").alias("ceiling")).collect()}
    filters = shingle_filter(index.select("hash"), filter_bits), shingle_filter(top.select("hash", "size_class"), filter_bits)
    shared = spark.sparkContext.broadcast((*filters, ceilings))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = durable(slim.mapInArrow(_search(width, shared), "doc_id long, text_hash long, shingle string").distinct())
    # Pairs come from the sketches; what else they share is counted for these alone.
    begun = found.join(top.select("shingle", "item_id", "item_no"), "shingle")
    pairs = begun.select("doc_id", "text_hash", F.col("item_id").alias("of_id"), F.col("item_no").alias("of_no")).distinct()
    of_item = F.col("of_id").eqNullSafe(F.col("item_id")) & (F.col("of_no") == F.col("item_no"))
    wanted = pairs.join(index.select("item_id", "item_no", "shingle", "n_item", "n_needed"), of_item).drop("of_id", "of_no")
    there = found.select(F.col("doc_id").alias("by_id"), F.col("text_hash").alias("by_hash"), F.col("shingle").alias("own"))
    same = F.col("doc_id").eqNullSafe(F.col("by_id")) & (F.col("text_hash") == F.col("by_hash")) & (F.col("shingle") == F.col("own"))
    counted = wanted.join(there, same).groupBy("doc_id", "text_hash", "item_id", "item_no").agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.max("n_item").cast("long").alias("n_item"),
        F.max("n_needed").alias("n_needed"),
    )
    return counted.where("n_shared >= n_needed").select(
        "doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id no match of ``find_items`` names."""
    gone = find_items(docs, items, threshold, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"))
    return rows.join(gone, F.col("own_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
