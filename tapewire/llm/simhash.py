"""Near duplicates by SimHash: fingerprints, links within a few bits, and groups."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.components import components
from tapewire.llm.utf8 import slices
from tapewire.session import store

WORDS = 4
MAX_BITS = 4
SEED = 42

#: First bit and width of each segment. Four differing bits cannot give each of three segments two.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Runs of fingerprints beyond this are cut again by the bits outside their segment.
DENSE = 4096
#: Runs up to this are compared pair by pair, all at once.
SMALL = 48


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text, in order, repeats included."""
    if not text:
        return np.zeros(0, np.uint64)
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[: -words]]).tolist()
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bits set in more than half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints(words), "doc_id long, fp long")


# --- links -------------------------------------------------------------------


def _segment_of(bit: int) -> tuple[int, int]:
    return next((first, width) for first, width in SEGMENTS if first <= bit < first + width)


def _segment_masks() -> np.ndarray:
    """For each bit the mask of its segment."""
    return np.array([((1 << w) - 1) << f for f, w in (_segment_of(b) for b in range(64))], np.uint64)


def variants(fps: DataFrame) -> DataFrame:
    """For each fingerprint one row per bit: its segment around that bit, with the bit left out.

    Two fingerprints within the limit differ in at most one bit of some segment, and so share the
    variant without that bit.
    """
    masks = [int(m) for m in _segment_masks()]
    first = [_segment_of(b)[0] for b in range(64)]
    kept = F.array(*[F.lit(np.uint64(m & ~(1 << b)).view(np.int64).item()) for b, m in enumerate(masks)])
    down = F.array(*[F.lit(f) for f in first])
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    low = F.expr("shiftrightunsigned(fp & kept[bit], down[bit])")
    return rows.withColumns({"kept": kept, "down": down}).select((low * 64 + F.col("bit")).alias("key"), "fp")


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of a run as all its links would: each one met is searched from once."""
    left, found = np.sort(fps), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = _close(left, here, most)
            reached, left = left[near], left[~near]
            found += [(here, x) for x in reached]
            queue += list(reached)
    return found


def _small_runs(fps: np.ndarray, run: np.ndarray, most: int) -> list[np.ndarray]:
    """All links within short runs: each fingerprint against the next, the one after it, and so on."""
    found = [np.zeros((0, 2), np.uint64)]
    for step in range(1, SMALL):
        same = run[step:] == run[:-step]
        if not same.any():
            break
        at = np.flatnonzero(same & _close(fps[step:], fps[:-step], most))
        found.append(np.stack([fps[at], fps[at + step]], axis=1))
    return found


def _links(most: int, dense: int | None):
    """Links within each run of rows with equal keys, from sorted rows.

    A run beyond ``dense`` is not compared here: its rows go on (as key, fp) with a longer key, for
    each bit of the segments of the remaining bits, by the same argument as in ``variants``.
    """

    def refined(key: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = _segment_masks()[key & 63]
        bits = [b for b in range(64) if not int(own) >> b & 1]
        third = -(-len(bits) // 3)
        for part in (bits[:third], bits[third : 2 * third], bits[2 * third :]):
            mask = sum(1 << b for b in part)
            for b in part:
                kept = np.uint64(mask & ~(1 << b))
                # Unequal parts may share a key by chance; that adds comparisons, never links.
                mixed = (fps & kept) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((key * 0xD1342543DE82EF95 + b) & (2**64 - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mixed.view(np.int64)), pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], names=["key", "a", "b"]
                )

    def links(pairs: np.ndarray) -> pa.RecordBatch:
        a, b = pairs[:, 0].copy().view(np.int64), pairs[:, 1].copy().view(np.int64)
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"])

    def judged(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of whole runs."""
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(heads, len(keys)))
        run = np.repeat(np.arange(len(heads)), sizes)
        short = (sizes > 1) & (sizes <= SMALL)
        at = short[run]
        pairs = _small_runs(fps[at], run[at], most)
        for j in np.flatnonzero(sizes > SMALL):
            part = fps[heads[j] : heads[j] + sizes[j]]
            if dense and sizes[j] > dense:
                yield from refined(int(keys[heads[j]]), part)
            elif found := _spanning(part, most):
                pairs.append(np.array(found, np.uint64))
        whole = np.unique(np.concatenate(pairs), axis=0)
        if len(whole):
            yield links(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, n, hot = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if hot is not None:  # the run that is being sent on may continue
                cut = int(np.searchsorted(keys != hot, True)) if keys[0] == hot else 0
                if cut:
                    yield from refined(hot, fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
                if not len(keys):
                    continue
                hot = None
            held_k.append(keys)
            held_f.append(fps)
            n += len(keys)
            if n < 1 << 16 and not (dense and n > 2 * dense):
                continue
            keys, fps = np.concatenate(held_k), np.concatenate(held_f)
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield from judged(keys[:cut], fps[:cut])
            held_k, held_f, n = [keys[cut:]], [fps[cut:]], len(keys) - cut
            if dense and n > dense:
                hot = int(keys[-1])
                yield from refined(hot, held_f[0])
                held_k, held_f, n = [], [], 0
        if n:
            yield from judged(np.concatenate(held_k), np.concatenate(held_f))

    return run


def near_links(fps: DataFrame, most: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that join distinct fingerprints ``fp`` as all pairs within ``most`` bits would.

    Rows meet by the variants of ``variants``, in sorted partitions that are streamed, and every
    candidate is verified by its differing bits. Short runs give all their pairs, longer ones a
    spanning forest, so that no run gives more links than it could have rows times ``SMALL``. A run
    with more than ``dense`` fingerprints is dealt out again by further bits, in full.
    """
    if most > 5:
        raise ValueError("three segments with one free bit find at most five differing bits")
    schema = "key long, a long, b long"
    met = variants(fps).repartition("key").sortWithinPartitions("key")
    first = store(met.mapInArrow(_links(most, dense), schema))
    again = first.rows.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    more = again.repartition("key").sortWithinPartitions("key").mapInArrow(_links(most, None), schema)
    return first.rows.where("key IS NULL").select("a", "b").union(more.select("a", "b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MAX_BITS) -> DataFrame:
    """The near-duplicate group of every document.

    A fingerprint bit is 1 if set in over half of the XXH64 values of the text's word shingles,
    A-Z lower-cased. Fingerprints at ``most`` or fewer differing bits are linked; groups are what
    links reach. Equal fingerprints are one node, so copies never make pairs.

    A text with fewer words than a shingle has one, of all its words; a text without any, empty or
    null has fingerprint zero and is linked like any other. Rows with the same id each get a result.
    A null id gets one too, but names no group unless all ids of the group are null. Other columns
    are not read.

    Returns doc_id, fingerprint (16 hex digits), component_id (the smallest id of the group).
    """
    prints = store(fingerprints(docs, id_col, text_col, words)).rows
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("fp"), most)).rows.select(F.col("b").alias("fp"), F.col("a").alias("root"))
    grouped = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of their group.

    Of rows with that same id all stay; rows without an id stay only if their group has no id at all.
    """
    groups = near_groups(docs, id_col, text_col, words, most)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"))
    return rows.join(stay, F.col("own_id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")
