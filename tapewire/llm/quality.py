"""Text quality: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.calibrate import folds, isotonic, labels_of
from tapewire.llm.utf8 import mix, raw, slices, words
from tapewire.session import store

#: Random features, width of the kernel in units of its usual value, and the penalty per labelled row.
FEATURES = 256
WIDTH = 1.0
PENALTY = 1e-4
SEED = 7
#: Groups in which the sums of tasks are added up before they meet.
BRANCHES = 64
CUT = 0.3

NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "stops", "symbols", "other_bytes", "short_words",
    "ends_in_sign", "bare_signs", "distinct_words", "top_word", "repeated_pairs", "repeated_tens", "log_line_words", "distinct_lines", "capitals", "longest_word", "doubled",
)

_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:'\"()-?", 3), (b"!#$%&*+/<=>@[\\]^_`{|}~", 4)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 5


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By document the number of distinct values and the count of the most frequent."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
    top = np.zeros(n)
    np.maximum.at(top, d[heads], np.diff(np.append(heads, len(d))))
    return np.bincount(d[heads], minlength=n).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text; all shares are 0 for a text without words."""
    data, bounds = raw(texts)
    n = len(bounds) - 1
    w = words(data, bounds)
    size, count = np.diff(bounds).astype(float), w.count().astype(float)
    length = (w.end - w.start).astype(float)
    some, held = np.maximum(count, 1), np.maximum(size, 1)

    def by_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=values, minlength=n)

    kind = _CLASS[data]
    shares = []
    for k in range(1, 6):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        shares.append((total[bounds[1:]] - total[bounds[:-1]]) / held)
    letters = np.concatenate([[0], np.cumsum((kind == 0) | (kind == 1) | (kind == 5))])
    bare = (letters[w.end] - letters[w.start]) == 0
    last, first = kind[w.end - 1] if len(w.end) else np.zeros(0), kind[w.start] if len(w.start) else np.zeros(0)
    mean = by_doc(length) / some
    spread = np.sqrt(np.maximum(by_doc(length**2) / some - mean**2, 0))
    hashes = w.hashes()
    distinct, top = _distinct(w.doc, hashes, n)
    repeated = []
    for width in (2, 10):
        at = w.windows(width)
        own, _ = _distinct(w.doc[at], w.window_hashes(width, at, hashes), n)
        total = np.bincount(w.doc[at], minlength=n)
        repeated.append(1 - own / np.maximum(total, 1) * (total > 0) - (total == 0))
    # Lines: a word begins a line if a line feed lies between it and the word before it.
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(w.start), bool)
    opens[1:] = (feeds[w.start[1:]] > feeds[w.start[:-1]]) | (w.doc[1:] != w.doc[:-1])
    heads = np.flatnonzero(opens)
    if len(heads):
        place = np.arange(len(hashes)) - np.repeat(heads, np.diff(np.append(heads, len(hashes))))
        line = np.add.reduceat(mix(hashes + place.astype(np.uint64)), heads)
        lines = np.bincount(w.doc[heads], minlength=n)
        own_lines, _ = _distinct(w.doc[heads], line, n)
    else:
        lines, own_lines = np.zeros(n), np.zeros(n)
    doubled = np.zeros(len(w.start), bool)
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    return np.stack(
        [
            np.log1p(size), np.log1p(count), mean, spread, *shares, by_doc(length <= 3) / some, by_doc((last == 3) | (last == 4)) / some,
            by_doc(bare) / some, distinct / some, top / some, *repeated, np.log1p(count / np.maximum(lines, 1)), own_lines / np.maximum(lines, 1),
            by_doc(first == 1) / some, np.log1p(longest), by_doc(doubled) / some,
        ],
        axis=1,
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fold and stats (array of double, in the order of ``NAMES``) of every whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = statistics(batch.column("text"))
            bounds = np.arange(len(stats) + 1, dtype=np.int32) * stats.shape[1]
            rows = pa.ListArray.from_arrays(pa.array(bounds), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), rows], names=["doc_id", "fold", "stats"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), folds(F.col(id_col)).alias("fold"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fold int, stats array<double>")


class Kernel:
    """Random Fourier features: cosines whose products approximate a Gaussian kernel of scaled statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.direction = rng.standard_normal((len(mean), features)) / (width * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = ((stats - self.mean) / self.scale).clip(-6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(scaled @ self.direction + self.phase)
        return np.concatenate([np.ones((len(stats), 1)), waves], axis=1)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, -1)


def _scaling(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over all documents."""
    moments = [f(F.element_at("stats", i + 1)) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    row = [0.0 if v is None else float(v) for v in stats.agg(*moments).first()]
    scale = np.array(row[1::2])
    return np.array(row[::2]), np.where(scale > 1e-9, scale, 1.0)


def _normal_equations(kernel: Kernel):
    """Per task the sums of z z' and z y, one row for each row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = kernel(_stats(part))
                y = np.asarray(part.column("label"), float)[:, None]
                own = z.T @ np.concatenate([z, y, np.ones_like(y)], axis=1)
                total = own if total is None else total + own
        if total is not None:
            bounds = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
            rows = pa.ListArray.from_arrays(pa.array(bounds), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), rows], names=["row", "sums"])

    return run


def _sum_rows(keys: list[str]):
    """One row for each group: its keys and the sum of its arrays."""

    def run(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks()
        rows = np.asarray(sums.flatten()).reshape(table.num_rows, -1)
        rows = rows[np.lexsort(rows.T)]  # the same order of addition, whichever task came first
        total = pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "sums": total})

    return run


def _ridge(labelled: DataFrame, kernel: Kernel, penalty: float) -> np.ndarray | None:
    """Weights from the normal equations; their (features + 1) rows are summed on the executors, in two levels.

    No group holds more than one row for each ``BRANCHES``-th task, or for each branch.
    """
    schema = "row int, sums array<double>"
    of_tasks = labelled.select("stats", "label").mapInArrow(_normal_equations(kernel), schema)
    branches = of_tasks.withColumn("branch", F.spark_partition_id() % BRANCHES).groupBy("row", "branch")
    partial = branches.applyInArrow(_sum_rows(["row", "branch"]), "row int, branch int, sums array<double>")
    sums = partial.groupBy("row").applyInArrow(_sum_rows(["row"]), schema)
    rows = sorted(sums.collect(), key=lambda r: r["row"])
    if not rows:
        return None
    whole = np.array([r["sums"] for r in rows])
    n = len(rows)
    gram, target, count = whole[:, :n], whole[:, n], whole[0, n + 1]
    ridge = penalty * count * np.eye(n)
    ridge[0, 0] = 0
    return np.linalg.solve(gram + ridge + 1e-9 * np.eye(n), target)


def _predict(kernel: Kernel, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                others = [c for c in batch.schema.names if c != "stats"]
                scored = pa.array(kernel(_stats(batch)) @ weights)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), scored], names=[*others, "raw"])

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    features: int = FEATURES,
    width: float = WIDTH,
    penalty: float = PENALTY,
    cut: float = CUT,
) -> DataFrame:
    """Probability of label 1 for every whole text, from what its letters, words and lines look like.

    Statistics of all documents are computed once and written to the shared folder; everything else
    reads these. They are scaled by mean and deviation over all documents, turned into random Fourier
    features, and ridge weights solve the normal equations, which each task sums for its rows. Labels of
    folds 1 to 3 (crc32 of the id as text modulo 5) give the weights and those of fold 4 the isotonic
    curve; fold 0 is held out. All labelled rows are used.

    A null text is empty. A null id can't have a label and gets a score like any other; rows with the same
    id share its label; an id with several labels has their mean. Without labels to learn from every score
    is 0.5. Returns doc_id, held_out, score, predicted (1 if score >= ``cut``).
    """
    stats = store(document_statistics(docs, id_col, text_col)).rows
    kernel = Kernel(*_scaling(stats), features, width)
    known = stats.where("fold > 0").join(labels_of(labels, label_col), F.col("doc_id") == F.col("label_id"))
    weights = _ridge(known.where("fold < 4"), kernel, penalty)
    if weights is None:
        weights = np.zeros(features + 1)
    fit = known.where("fold = 4").select("label", "stats").mapInArrow(_predict(kernel, weights), "label double, raw double")
    x, p = isotonic(fit, -1.0, 2.0)

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _predict(kernel, weights)(batches):
            score = np.interp(batch.column("raw").to_numpy(), x, p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    slim = stats.select("doc_id", (F.col("fold") == 0).alias("held_out"), "stats")
    return slim.mapInArrow(calibrated, "doc_id long, held_out boolean, score double, predicted int")
