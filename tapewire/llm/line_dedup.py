"""Lines that many documents share: all are dropped but those of the last document."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.utf8 import slices
from tapewire.session import store

MIN_CHARS = 20
MIN_DOCS = 3

_LINES = "key binary, doc_id long, text_hash long, pos int"
#: What a range of the sorted lines returns. ``drop``: a line that goes. ``edge``: a line whose key may go on in
#: the next range. ``sum``: of such a key, the documents seen here, from doc_id to last_doc.
_FOUND = pa.schema(
    [
        ("kind", pa.string()),
        ("key", pa.binary()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("pos", pa.int32()),
        ("part", pa.int32()),
        ("docs", pa.int64()),
        ("last_doc", pa.int64()),
    ]
)
_FOUND_DDL = "kind string, key binary, doc_id long, text_hash long, pos int, part int, docs long, last_doc long"


def line_keys(text: str, min_chars: int) -> list[tuple[int, bytes]]:
    """Position and hash of each line that is long enough, compared without outer white space and A-Z case."""
    found = []
    for pos, line in enumerate(text.encode().lower().split(b"\n")):
        key = line.strip()
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            found.append((pos, xxhash.xxh3_128_digest(key)))
    return found


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, pos, keys = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for p, k in line_keys(text or "", min_chars):
                    rows.append(i)
                    pos.append(p)
                    keys.append(k)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(pos, pa.int32())],
                names=["key", "doc_id", "text_hash", "pos"],
            )

    return run


def _heads(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where a new key, and where a new document of a key, begins in sorted rows. A null id is a document."""
    keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint64).reshape(-1, 2)
    ids = np.asarray(pc.fill_null(rows.column("doc_id"), 0), np.int64)
    null = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    new_key, new_doc = np.ones(len(ids), bool), np.ones(len(ids), bool)
    new_key[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    new_doc[1:] = new_key[1:] | (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return new_key, new_doc


def _rows(kind: str, rows: pa.RecordBatch) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays(
        [pa.repeat(kind, n), *(rows.column(c) for c in ("key", "doc_id", "text_hash", "pos")), *(pa.nulls(n, f.type) for f in list(_FOUND)[5:])],
        schema=_FOUND,
    )


def _whole_runs(rows: pa.RecordBatch, min_docs: int) -> pa.RecordBatch:
    """The lines that go, of keys all of whose lines are here: those of all documents but the first in order."""
    new_key, new_doc = _heads(rows)
    heads, run = np.flatnonzero(new_key), np.cumsum(new_key) - 1
    docs = np.add.reduceat(new_doc.astype(np.int64), heads)
    within = np.cumsum(new_doc)
    later = within > within[heads][run]
    return _rows("drop", rows.take(pa.array(np.flatnonzero(later & (docs[run] >= min_docs)))))


def _stream(min_docs: int):
    """Judge one sorted range; only the lines of the key at hand are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, first, sums = TaskContext.get().partitionId(), [], True, []

        def at_edge(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            _, new_doc = _heads(table)
            ends = table.column("doc_id")
            sums.append([table.column("key")[0].as_py(), ends[0].as_py(), part, int(new_doc.sum()), ends[-1].as_py()])
            yield _rows("edge", table)

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero(_heads(batch)[0])
            if held and batch.column("key")[0].as_py() == held[-1].column("key")[0].as_py():
                cuts = cuts[1:]
            if not len(cuts):
                held.append(batch)
                continue
            if cuts[0]:
                held.append(batch.slice(0, cuts[0]))
            whole = [batch.slice(cuts[0], cuts[-1] - cuts[0])] if len(cuts) > 1 else []
            if held and first:
                yield from at_edge(held)
                first = False
            elif held:
                whole = [*held, *whole]
            elif first and whole:  # the range begins with this batch
                head = cuts[1] - cuts[0]
                yield from at_edge([batch.slice(cuts[0], head)])
                first, whole = False, [batch.slice(cuts[1], cuts[-1] - cuts[1])]
            if whole and (rows := pa.Table.from_batches(whole)).num_rows:
                yield _whole_runs(rows.combine_chunks().to_batches()[0], min_docs)
            held = [batch.slice(cuts[-1])]
        if held:
            yield from at_edge(held)
        if sums:
            key, doc, parts, docs, last = (list(x) for x in zip(*sums, strict=True))
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat("sum", n), pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(parts, pa.int32()), pa.array(docs, pa.int64()), pa.array(last, pa.int64())],
                schema=_FOUND,
            )

    return run


def _edge_keys(sums: list, min_docs: int) -> list[tuple[bytes, int | None]]:
    """Keys at the edges of ranges that enough documents hold, with the first of these."""
    by_key: dict[bytes, list] = {}
    for row in sorted(sums, key=lambda r: r["part"]):
        by_key.setdefault(bytes(row["key"]), []).append(row)
    frequent = []
    for key, rows in by_key.items():
        docs = sum(r["docs"] for r in rows) - sum(a["last_doc"] == b["doc_id"] for a, b in zip(rows, rows[1:], strict=False))
        if docs >= min_docs:
            frequent.append((key, rows[0]["doc_id"]))
    return frequent


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the lines that go, for documents that lose any.

    ``docs`` has doc_id, text_hash and text. Line hashes are range-partitioned and sorted by key,
    falling document and position, so that a frequent key spreads over as many ranges as its rows
    need. Each range is streamed once: the first document of a key keeps its lines, and those of
    all later ones go. The first and the last key of a range may go on in the next one: their lines
    come back undecided, with two rows of counts per range, which are put together on the driver.

    Returns doc_id, text_hash and drops, an array of (word, bits): bit i of word w is line 64 w + i.
    """
    spark = docs.sparkSession
    order = [F.col("key"), F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("pos")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = docs.mapInArrow(_lines(min_chars), _LINES)
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = store(ranged.mapInArrow(_stream(min_docs), _FOUND_DDL)).rows

    frequent = _edge_keys(found.where("kind = 'sum'").collect(), min_docs)  # two rows per range
    edge_keys = spark.createDataFrame([(bytearray(k), d) for k, d in frequent], "key binary, first long")
    undecided = found.where("kind = 'edge'").join(F.broadcast(edge_keys), "key")
    later = undecided.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = found.where("kind = 'drop'").unionByName(later.select(found.columns))
    word = F.expr("pos div 64").cast("int").alias("word")
    return (
        gone.groupBy("doc_id", "text_hash", word)
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("word", "bits")).alias("drops"))
    )


def _without(text: Column, drops: Column) -> Column:
    words = F.map_from_entries(drops)

    def stays(line: Column, i: Column) -> Column:
        bits = F.coalesce(words[F.floor(i / 64).cast("int")], F.lit(0).cast("long"))
        return F.getbit(bits, i % 64) == 0

    return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents share, except in the document with the largest id.

    A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
    lower-cased; keys under ``min_chars`` code points are left alone. Texts are split at ``\\n`` only.
    Rows that share an id are one document: they count once and keep or lose a line together. A null
    id is one document, below all others. A null text is one empty line.

    Returns row (struct with the columns as they were), kept (the text without those lines), n_lines
    and n_dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    drops = dropped_lines(slim, min_chars, min_docs).withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), text.alias("own_text")).withColumn(
        "own_hash", F.xxhash64("own_text")
    )
    joined = rows.join(drops, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_hash") == F.col("of_hash")), "left")
    n_lines = (F.char_length("own_text") - F.char_length(F.replace("own_text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.aggregate("drops", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    return joined.select(
        "row",
        F.when(F.col("drops").isNull(), F.col("own_text")).otherwise(_without(F.col("own_text"), F.col("drops"))).alias("kept"),
        n_lines.alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0).cast("long")).alias("n_dropped"),
    )
