"""Toxicity by compression distance: which of two kinds of zstandard dictionaries makes a text's windows shorter.

Toxic texts are ordinary but for some words, and a dictionary of either class also holds some rare words by
chance. The fitted texts of each class are therefore dealt out to several dictionaries: a window is nearer to toxic
text only by the bytes that nearly all toxic dictionaries save against nearly all ordinary ones.
"""

from bisect import insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.calibrate import folds, isotonic, labels_of
from tapewire.llm.utf8 import slices
from tapewire.session import store

#: The bounded sample the dictionaries are trained on: labelled documents of each class, and bytes of each text.
FIT_DOCS = 3000
FIT_BYTES = 1 << 16
#: Dictionaries of each class at most, fitted documents of the rarer class for each, and bytes of one.
PAIRS, DOCS_PER_PAIR = 9, 40
DICTIONARY_BYTES = 112640
#: One dictionary of a class is passed over for so many of them, so that a single text can't settle a window.
SPARE = 5
LEVEL = 19
CUT = 0.5

#: Signs that are cut from both ends of a window, and what follows each window so that none is too short to be compressed.
_SIGNS = b".,;:!?*$%&#|\"()'"
_PADDING = b" " * 48
#: A window's margin, the bytes that the toxic dictionaries save, is counted from 0, for none, to this.
HIGH = 8
#: Words that a task remembers the margins of, and as many older ones.
REMEMBERED = 1 << 19


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _window(word: bytes) -> bytes:
    return b" " + word.strip(_SIGNS) + b" "


def windows(text: str | None) -> list[bytes]:
    """The words of a text in lower case, signs cut off, each between spaces."""
    return list(map(_window, _words(text)))


def dictionary(texts: list[str]) -> bytes:
    """Trained on all windows of the texts, each once a text; of samples too few to train on, the samples themselves."""
    samples = [w for t in texts for w in sorted(set(windows(t)))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-DICTIONARY_BYTES:]


class Distance:
    """Compressed lengths of windows under the dictionaries of toxic and those of ordinary text."""

    def __init__(self, toxic: list[bytes], plain: list[bytes]):
        self.toxic, self.plain = toxic, plain
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def __reduce__(self):
        return Distance, (self.toxic, self.plain)

    @cached_property
    def coders(self):
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )

        def coder(content: bytes):
            trained = zstandard.ZstdCompressionDict(content)
            trained.precompute_compress(compression_params=options)
            return zstandard.ZstdCompressor(dict_data=trained, compression_params=options).compress

        return [(coder(p), coder(t)) for p, t in zip(self.plain, self.toxic, strict=False)]

    def _measure(self, window: bytes) -> int:
        padded, plain, toxic, found = window + _PADDING, [], [], 0
        spare = len(self.coders) // SPARE
        for by_plain, by_toxic in self.coders:
            # Further dictionaries can only lower what is found, whichever side they are of.
            insort(plain, len(by_plain(padded)))
            if len(toxic) > spare and plain[spare] <= toxic[-1 - spare]:
                return 0
            insort(toxic, len(by_toxic(padded)))
            if len(toxic) > spare:
                found = plain[spare] - toxic[-1 - spare]
                if found <= 0:
                    return 0
        return min(found, HIGH)

    def _found(self, word: bytes) -> int:
        """The margin of the window of a word without signs at its ends."""
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = self._measure(_window(word))
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def margin(self, window: bytes) -> int:
        """Bytes by which the longest of the toxic dictionaries' lengths is below the shortest of the ordinary ones'.

        A part of either side, one in ``SPARE`` rounded down, is passed over. From 0 to ``HIGH``. The window is one
        that ``windows`` makes.
        """
        return self._found(window[1:-1])

    def counts(self, text: str | None) -> np.ndarray:
        """How many windows of the text have each margin."""
        words = _words(text)
        # Only words without signs are remembered, once each. A word that is not found as it stands is looked up without them.
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._found(w.strip(_SIGNS)) if m is None else m for w, m in zip(words, found, strict=True)]
        return np.bincount(np.array(found, np.int64), minlength=HIGH + 1)


def _sample(docs: DataFrame, known: DataFrame, toxic: bool, most: int) -> DataFrame:
    """Labelled documents of a class, those whose ids hash lowest. The ids come from the labels alone and are few."""
    wanted = F.col("label") > 0.5 if toxic else F.col("label") <= 0.5
    ids = known.where(wanted).select("label_id").orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    found = docs.where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    return found.select("doc_id", "text", F.lit(toxic).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)


def _train(table: pa.Table) -> pa.Table:
    made = dictionary(sorted(table.column("text").to_pylist()))
    return pa.table({"toxic": table.column("toxic").slice(0, 1), "part": table.column("part").slice(0, 1), "content": pa.array([made], pa.binary())})


def train(docs: DataFrame, known: DataFrame, fit_docs: int = FIT_DOCS) -> Distance:
    """Dictionaries from a bounded sample (doc_id, text) with labels (label_id, label).

    The sample is dealt out by a hash of its rows, and each dictionary is trained in a task of its own; only
    these reach the driver. A class without documents has one empty dictionary.
    """
    sample = store(_sample(docs, known, True, fit_docs).unionByName(_sample(docs, known, False, fit_docs)))
    sizes = {r["toxic"]: r["count"] for r in sample.rows.groupBy("toxic").count().collect()}
    pairs = min(max(min(sizes.get(c, 0) for c in (True, False)) // DOCS_PER_PAIR, 1), PAIRS)
    parts = sample.rows.select("toxic", F.pmod(F.hash("doc_id", "text"), F.lit(pairs)).alias("part"), "text")
    trained = parts.groupBy("toxic", "part").applyInArrow(_train, "toxic boolean, part int, content binary").collect()
    sample.drop()
    toxic, plain = ([bytes(r["content"]) for r in sorted(trained, key=lambda r: r["part"]) if r["toxic"] is c] or [b""] for c in (True, False))
    return Distance(toxic, plain)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS, cut: float = CUT
) -> DataFrame:
    """Probability of label 1 for every whole text.

    1. Dictionaries of toxic and of ordinary text are trained on all windows of a bounded sample: at most
       ``fit_docs`` labelled documents of each class from folds 1 to 3 (crc32 of the id as text modulo 5) of up
       to ``FIT_BYTES`` bytes. Either class is dealt out to up to ``PAIRS`` dictionaries.
    2. Every window (a word between spaces, padded) of every document is compressed with them; a document
       is the counts of its windows by margin. These are written to the shared folder.
    3. Calibration: the labelled documents of fold 4 give each margin its weight, the logarithm of its share in
       toxic over that in ordinary text, and an isotonic curve from a document's summed weights to a
       probability. Fold 0 is held out.

    A null or empty text has no windows and a sum of 0. Without labels of both classes every score is 0.5.
    A null id has no label; rows with the same id share its label; an id with several labels has their
    mean. Returns doc_id, held_out, score, predicted (1 if score >= ``cut``).
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), folds(F.col(id_col)).alias("fold"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels_of(labels, label_col)
    fitting = known.where(folds(F.col("label_id")).between(1, 3))
    distance = spark.sparkContext.broadcast(train(slim, fitting, fit_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = distance.value.counts
        for batch in slices(batches):
            counts = np.array([measure(t) for t in batch.column("text").to_pylist()])
            bounds = np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1]
            rows = pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), rows], names=["doc_id", "fold", "counts"])

    measured = store(slim.mapInArrow(count, "doc_id long, fold int, counts array<long>")).rows
    fit = measured.where("fold = 4").join(known, F.col("doc_id") == F.col("label_id"))
    bins = range(HIGH + 1)
    sums = fit.groupBy((F.col("label") > 0.5).alias("toxic")).agg(*(F.sum(F.element_at("counts", i + 1)).alias(f"n{i}") for i in bins))
    totals = {r["toxic"]: np.array([r[f"n{i}"] for i in bins], float) + 1 for r in sums.collect()}
    weights = np.zeros(len(bins))
    if len(totals) == 2:
        weights = np.log(totals[True] / totals[True].sum()) - np.log(totals[False] / totals[False].sum())
    raw = F.aggregate(F.zip_with("counts", F.array(*map(F.lit, weights.tolist())), lambda n, w: n * w), F.lit(0.0), lambda a, b: a + b)
    # Sums have no bound; their sign and order are kept between -1 and 1.
    squashed = (raw / (F.lit(8.0) + F.abs(raw))).alias("raw")
    x, p = isotonic(fit.select("label", squashed), -1.0, 1.0)
    if len(totals) < 2:
        p = np.full(len(x), 0.5)

    @F.pandas_udf("double")
    def calibrated(sums: pd.Series) -> pd.Series:
        return pd.Series(np.interp(sums.to_numpy(), x, p))

    scored = measured.select("doc_id", (F.col("fold") == 0).alias("held_out"), squashed).select("doc_id", "held_out", calibrated("raw").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
