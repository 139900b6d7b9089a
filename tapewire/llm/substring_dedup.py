"""Exact repeats of word passages across documents, found by fixed-block anchors."""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.utf8 import Words, raw, slices, words
from tapewire.session import store

#: Words of the shortest repeat that is removed.
WINDOW = 13
#: Text for each bucket; a bucket is held by one task, at some ten times what it was sent.
BUCKET_BYTES = 16 << 20

_LEAST = -(1 << 63)
_MOST = (1 << 63) - 1

# Entries: what a chunk, some documents of a task, sends to a bucket, and what the bucket answers.
_ENTRIES = "bucket int, chunk long, kind string, packed binary"
_HITS = "doc_id long, text_hash int, hashes binary, places binary"


def _entries(buckets: list[int], chunk: int, kinds: list[str], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array([chunk] * len(buckets), pa.int64()), pa.array(kinds, pa.string()), pa.array(packed, pa.binary())],
        names=["bucket", "chunk", "kind", "packed"],
    )


def _chunk_id(ids: np.ndarray, rows: np.ndarray) -> int:
    """The same for the same documents, so that a task that runs again sends the same."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(ids.tobytes() + rows.tobytes()), np.int64)[0])


def _narrow(numbers: np.ndarray) -> bytes:
    """The numbers above the least, in the fewest bytes that hold them all; before them that width and the least."""
    values = numbers.astype(np.int64)
    least = values.min() if len(values) else np.int64(0)
    above = values.view(np.uint64) - least.view(np.uint64)  # modulo 2^64
    kind = np.min_scalar_type(int(above.max()) if len(above) else 0)
    return struct.pack("<Bq", kind.itemsize, least) + above.astype(kind).tobytes()


def _widen(packed: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """``n`` numbers that ``_narrow`` packed at ``at``, and where they end."""
    width, least = struct.unpack_from("<Bq", packed, at)
    above = np.frombuffer(packed, f"<u{width}", n, at + 9).astype(np.uint64)
    return (above + np.int64(least).view(np.uint64)).view(np.int64), at + 9 + width * n


def _pack(numbers: np.ndarray, counts: np.ndarray, *rest: bytes) -> bytes:
    return b"".join((struct.pack("<II", len(numbers), int(counts.sum())), _narrow(numbers), _narrow(counts), *rest))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Document numbers within the chunk, entries of each, all entries, and where these begin."""
    n, m = struct.unpack_from("<II", packed)
    numbers, at = _widen(packed, n, 8)
    counts, at = _widen(packed, n, at)
    return numbers, counts, m, at


def _requests(ids: np.ndarray, chunk: int, doc: np.ndarray, hashes: np.ndarray, flags: np.ndarray, buckets: int, second: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries dealt to buckets by one half of a hash; the other half stays with the entry, or all of it and a ``second`` hash.

    ``doc`` rises. Packed are the documents, their ids, and hash and flag of each entry.
    """
    wide = second is not None
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    full, starts = np.unique(bucket[order], return_index=True)
    cuts, full = np.append(starts, len(order)), full.tolist()
    short = hashes if wide else (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    packed = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        at = order[lo:hi]
        own, counts = np.unique(doc[at], return_counts=True)
        packed.append(_pack(own, counts, _narrow(ids[own]), short[at].tobytes(), second[at].tobytes() if wide else b"", np.packbits(flags[at]).tobytes()))
    return _entries(full, chunk, ["ask"] * len(full), packed)


def _local(ids: np.ndarray, rows: np.ndarray, chunk: int, places: dict[int, bytes], buckets: int) -> pa.RecordBatch:
    """The documents of the chunk, with the windows already known within it; any bucket passes them on."""
    sizes = np.array([len(places.get(i, b"")) for i in range(len(ids))])
    packed = _pack(np.arange(len(ids)), sizes, ids.tobytes(), rows.tobytes(), *(places[i] for i in sorted(places)))
    return _entries([chunk % buckets], chunk, ["known"], [packed])


def _answers(table: pa.Table, wide: bool, judge) -> pa.Table:
    """One bucket: its answer to each chunk names the hits of the chunk's documents by their hashes."""
    known = table.filter(pc.equal(table.column("kind"), "known"))
    asks = table.filter(pc.equal(table.column("kind"), "ask"))
    out = [known]
    if asks.num_rows:
        kind = np.uint64 if wide else np.uint32
        number, of, source, hashes, seconds, flags = [], [], [], [], [], []
        for i, p in enumerate(asks.column("packed").to_pylist()):
            own, counts, m, at = _unpack(p)
            own_ids, at = _widen(p, len(own), at)
            number.append(np.repeat(own, counts).astype(np.uint32))
            of.append(np.repeat(own_ids, counts))
            source.append(np.full(m, i, np.int32))
            hashes.append(np.frombuffer(p, kind, m, at))
            at += hashes[-1].nbytes
            if wide:
                seconds.append(np.frombuffer(p, np.uint64, m, at))
                at += seconds[-1].nbytes
            flags.append(np.unpackbits(np.frombuffer(p, np.uint8, -(-m // 8), at), count=m).astype(bool))
        number, of, source, hashes, flags = (np.concatenate(x) for x in (number, of, source, hashes, flags))
        order, heads, group = _by_hash(hashes, np.concatenate(seconds) if wide else None)
        hit = np.sort(order[judge(of[order], flags[order], heads, group)])  # back by chunk and document
        bucket, chunks, packed = table.column("bucket")[0].as_py(), asks.column("chunk").to_pylist(), []
        starts = np.searchsorted(source[hit], np.arange(asks.num_rows + 1))
        full = np.flatnonzero(starts[1:] > starts[:-1]).tolist()
        for i in full:
            at = hit[starts[i] : starts[i + 1]]
            own, counts = np.unique(number[at], return_counts=True)
            values = hashes[at].astype(np.uint64)
            packed.append(_pack(own, counts, (values if wide else values | np.uint64(bucket) << np.uint64(32)).tobytes()))
        out += [_entries([bucket], chunks[i], ["hits"], [p]) for i, p in zip(full, packed, strict=True)]
    return pa.concat_tables([x if isinstance(x, pa.Table) else pa.Table.from_batches([x]) for x in out])


def _by_document(table: pa.Table) -> pa.Table:
    """The answers to one chunk, dealt out to its documents."""
    ids, rows, numbers, values, places = None, None, [], [], {}
    for kind, p in zip(table.column("kind").to_pylist(), table.column("packed").to_pylist(), strict=True):
        own, counts, m, at = _unpack(p)
        if kind == "known":
            n = len(own)
            ids, rows = np.frombuffer(p, np.int64, n, at), np.frombuffer(p, np.int32, n, at + 8 * n)
            ends = at + 12 * n + np.cumsum(counts)
            places = {i: p[ends[i] - counts[i] : ends[i]] for i in np.flatnonzero(counts)}
        else:
            numbers.append(np.repeat(own, counts).astype(np.uint32))
            values.append(np.frombuffer(p, np.uint64, m, at))
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
    value = np.concatenate(values) if values else np.zeros(0, np.uint64)
    order = np.argsort(number, kind="stable")
    number, value = number[order], value[order]
    own = sorted({*np.unique(number).tolist(), *places})
    lo, hi = np.searchsorted(number, own), np.searchsorted(number, own, "right")
    return pa.table(
        {
            "doc_id": pa.array(ids[own], pa.int64()),
            "text_hash": pa.array(rows[own], pa.int32()),
            "hashes": pa.array([value[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
            "places": pa.array([places.get(i) for i in own], pa.binary()),
        }
    )


def _bits(w: Words, marked: np.ndarray) -> dict[int, bytes]:
    """By document the marked words as bits, for documents that have any."""
    hit = np.unique(w.doc[marked])
    return {int(d): np.packbits(marked[w.first[d] : w.first[d + 1]]).tobytes() for d in hit}


def _by_hash(hashes: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, heads and group number of entries sorted by hash, or by both hashes."""
    order = np.argsort(hashes, kind="stable") if second is None else np.lexsort((second, hashes))
    h = hashes[order]
    new = h[1:] != h[:-1]
    if second is not None:
        g = second[order]
        new |= g[1:] != g[:-1]
    heads = np.flatnonzero(np.concatenate([[True], new])) if len(h) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(h))))
    return order, heads, group


def _anchor_hashes(w: Words, hashes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    at = w.windows(block)
    return at, w.window_hashes(block, at, hashes)


def _probe(window: int, buckets: int):
    """Reference blocks and rolling windows of every document.

    Values that several documents of the run hold are sent once, with the smallest id that has them
    as a block and the largest id at all, and are taken as hits here.
    """
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(*raw(batch.column("text")))
            long_enough = np.flatnonzero(w.count() >= window)
            if not len(long_enough):
                continue
            ids, rows = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            at, h = _anchor_hashes(w, w.hashes(), block)
            use = np.isin(w.doc[at], long_enough)
            at, h = at[use], h[use]
            doc = w.doc[at]
            aligned = (at - w.first[doc]) % block == 0
            order, heads, group = _by_hash(h)
            of = ids[doc[order]]
            low, high = np.minimum.reduceat(of, heads), np.maximum.reduceat(of, heads)
            shared = (low < high)[group]
            marked = np.zeros(len(w.start), bool)
            marked[at[order[shared]]] = True
            chunk = _chunk_id(ids, rows)
            yield _local(ids, rows, chunk, _bits(w, marked), buckets)
            # of shared values: the block of the smallest id, and any occurrence of the largest
            block_low = np.minimum.reduceat(np.where(aligned[order], of, _MOST), heads)[group]
            send = ~shared | (aligned[order] & (of == block_low)) | (of == high[group])
            at_send = np.sort(order[send])
            yield _requests(ids, chunk, doc[at_send], h[at_send], aligned[at_send], buckets)

    return run


def _anchored(table: pa.Table) -> pa.Table:
    """Rolling windows equal to a block of a smaller id, and blocks equal to a window of a larger id."""

    def judge(of, aligned, heads, group):
        low = np.minimum.reduceat(np.where(aligned, of, _MOST), heads)
        return (low[group] < of) | (aligned & (np.maximum.reduceat(of, heads)[group] > of))

    return _answers(table, False, judge)


def _repeated(table: pa.Table) -> pa.Table:
    """Windows that also begin in a document with a smaller id."""
    return _answers(table, True, lambda of, _, heads, group: np.minimum.reduceat(of, heads)[group] < of)


def _marked(w: Words, at: np.ndarray, h: np.ndarray, hits: list) -> np.ndarray:
    """The windows ``at``, with values ``h``, that the hits of their documents name, as a mask over words."""
    marked = np.zeros(len(w.start), bool)
    values, docs = [], []
    for d, own in enumerate(hits):
        for hit in own or ():
            if hit["places"]:
                lo, hi = w.first[d], w.first[d + 1]
                marked[lo:hi] |= np.unpackbits(np.frombuffer(hit["places"], np.uint8), count=hi - lo).astype(bool)
            values.append(np.frombuffer(hit["hashes"], np.uint64))
            docs.append(np.full(len(values[-1]), d))
    if values:
        named = np.concatenate(values) ^ _tag(np.concatenate(docs))
        marked[at[np.isin(h ^ _tag(w.doc[at]), named)]] = True
    return marked


def _selecting(h: np.ndarray, buckets: int) -> np.ndarray:
    """What of a hash the first step keeps: the bucket and 32 bits."""
    return (h & np.uint64(0xFFFFFFFF)) | ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)


def _tag(doc: np.ndarray) -> np.ndarray:
    """Sets the values of one document apart from those of the others of its batch."""
    return doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _extend(window: int, buckets: int):
    """Grow each anchor hit to the windows around it, and ask which of these repeat.

    Within a run of documents only the smallest id asks about a window; all others repeat it for certain.
    """
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(*raw(batch.column("text")))
            hashes = w.hashes()
            anchors, h = _anchor_hashes(w, hashes, block)
            hit = _marked(w, anchors, _selecting(h, buckets), batch.column("hits").to_pylist())
            near = np.concatenate([[0], np.cumsum(hit)])
            at = w.windows(window)
            at = at[near[at + window - block + 1] > near[at]]
            if not len(at):
                continue
            ids, rows = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            h, doc = w.window_hashes(window, at, hashes, seed=1), w.doc[at]
            second = w.window_hashes(window, at, w.hashes(seed=1), seed=2)
            order, heads, group = _by_hash(h, second)
            of = ids[doc[order]]
            low = np.minimum.reduceat(of, heads)[group]
            marked = np.zeros(len(w.start), bool)
            marked[at[order[of > low]]] = True
            chunk = _chunk_id(ids, rows)
            yield _local(ids, rows, chunk, _bits(w, marked), buckets)
            asks = np.sort(order[of == low])
            yield _requests(ids, chunk, doc[asks], h[asks], np.zeros(len(asks), bool), buckets, second[asks])

    return run


def _cut(window: int, names: list[str]):
    """The texts without the words that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(*raw(batch.column("text")))
            hits = batch.column("hits").to_pylist()
            gone = np.zeros(len(w.start), bool)
            if any(hits):
                at = w.windows(window)
                start = _marked(w, at, w.window_hashes(window, at, w.hashes(), seed=1), hits)
                cover = np.zeros(len(w.start) + window, np.int64)
                np.add.at(cover, np.flatnonzero(start), 1)
                np.add.at(cover, np.flatnonzero(start) + window, -1)
                gone = np.cumsum(cover)[: len(gone)] > 0
            data, kept = w.data.tobytes(), []
            starts, ends, first = w.start.tolist(), w.end.tolist(), w.first.tolist()
            for lo, hi in zip(first, first[1:], strict=False):
                stay = np.flatnonzero(~gone[lo:hi]) + lo
                kept.append(b" ".join([data[starts[i] : ends[i]] for i in stay.tolist()]))
            n = w.count()
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (n > 0)
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(removed), texts], names=names
            )

    return run


def _met(entries: DataFrame, bucket) -> DataFrame:
    """The answers of all buckets, by chunk and then by document."""
    answers = entries.groupBy("bucket").applyInArrow(bucket, _ENTRIES)
    hits = answers.groupBy("chunk").applyInArrow(_by_document, _HITS)
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("hashes", "places")).alias("hits"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in ``window`` consecutive words which also begin in a document with a smaller id.

    Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, unchanged, and windows are judged on the input.

    1. Anchors: the non-overlapping blocks of (window + 1) / 2 words of every document are reference
       blocks; any window holds one whole. Every rolling window of that length probes them. Blocks and
       probes meet in buckets by one half of a hash and carry the other half, packed for many documents.
    2. Extension: each hit grows to the windows of full length around it, which meet in buckets by two
       whole hashes, 128 bits of independent seeds: a window repeats if a smaller id has it. Runs of such windows are the maximal exact
       repeats, and what they cover goes.

    Values that several documents of a task hold are sent once per task, so that a passage of any
    frequency is an entry per chunk of documents in its bucket. Buckets answer chunk by chunk, and the
    answers are dealt out to documents there.
    Buckets are as many as ``spark.sql.shuffle.partitions``, and at least one for ``BUCKET_BYTES`` of text, so that
    none outgrows a task. The second step decides by 128 bits, at which
    10^13 windows make a false pair with a chance of some 10^-13; the first, by 32 bits and the bucket, only selects.

    Null texts have no words. Rows with the same id are one document, whose windows do not count against
    each other. A null id lies below all others. Returns doc_id, n_words, n_removed, kept (the words left,
    joined by one space) for every row.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("doc_id"), F.hash(text).alias("text_hash"), text.alias("text")
    )
    probes = slim.mapInArrow(_probe(window, buckets), _ENTRIES)
    anchored = store(_met(probes, _anchored))
    asking = slim.join(anchored.rows, ["doc_id", "text_hash"]).mapInArrow(_extend(window, buckets), _ENTRIES)
    repeated = store(_met(asking, _repeated))
    anchored.drop()
    found = slim.join(repeated.rows, ["doc_id", "text_hash"], "left")
    names = ["doc_id", "n_words", "n_removed", "kept"]
    cut = found.mapInArrow(_cut(window, names), "doc_id long, n_words long, n_removed long, kept string")
    return cut.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(_LEAST)))
