"""Language identification by hyperdimensional n-gram profiles."""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.utf8 import slices

DIMENSIONS = 1024
SEED = 10
#: How sharply cosines are told apart in the score.
SHARPNESS = 30.0
UNKNOWN = "und"
#: Cells of the matrix of counts that is multiplied at once.
CELLS = 1 << 21
#: Bytes of text whose letters are looked at together; arrays over these take some hundred times as much.
TEXT_BYTES = 1 << 19

_letters: tuple[np.ndarray, np.ndarray] | None = None
_vectors: dict[tuple[int, int], np.ndarray] = {}


def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point up to U+FFFF whether it is a letter or a mark on one, and whether it is a letter."""
    global _letters
    if _letters is None:
        kinds = [unicodedata.category(chr(c))[0] for c in range(1 << 16)]
        _letters = np.array([k in "LM" for k in kinds]), np.array([k == "L" for k in kinds])
    return _letters


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, the same everywhere; 0 stands for a gap between words."""
    if (code, dimensions) not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[code, dimensions] = np.random.default_rng([SEED, code]).integers(0, 2, dimensions).astype(np.float32) * 2 - 1
    return _vectors[code, dimensions]


@dataclass
class Trigrams:
    """Distinct letter trigrams of some documents, and how often each document has each of them."""

    codes: np.ndarray  # (distinct, 3) code points
    doc: np.ndarray
    gram: np.ndarray
    letters: np.ndarray  # per document


def trigrams(texts: list[str | None]) -> Trigrams:
    """Lower case, other characters than letters and marks as one gap, and a gap at both ends.

    Marks belong to the letters beside them; a text with marks alone has no letter, and counts as one without trigrams.
    """
    joined = "\n".join([(t or "").lower().replace("\n", " ") for t in texts]) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, counted = (table[np.minimum(points, 0xFFFF)] for table in letter_table())
    for i in np.flatnonzero(points > 0xFFFF):
        kind = unicodedata.category(chr(points[i]))[0]
        letter[i], counted[i] = kind in "LM", kind == "L"
    end = points == 10
    doc = np.concatenate([[0], np.cumsum(end)[:-1]])
    # Letters, a gap after each run of them, and a gap before the first of a document.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code, of = np.where(letter, points, 0)[keep], doc[keep]
    letters = np.bincount(doc, weights=counted, minlength=len(texts))
    keep_doc = letters[of] > 0
    code, of = code[keep_doc], of[keep_doc]
    some = np.flatnonzero(letters)
    at = np.searchsorted(of, some)
    code, of = np.insert(code, at, 0), np.insert(of, at, some)
    symbols, index = np.unique(code, return_inverse=True)
    k = len(symbols)
    inside = np.flatnonzero((of[2:] == of[:-2])) if len(of) > 2 else np.zeros(0, np.int64)
    value = (index[inside] * k + index[inside + 1]) * k + index[inside + 2]
    if k**3 <= 1 << 24:
        there = np.zeros(k**3, bool)
        there[value] = True
        distinct = np.flatnonzero(there)
        place = np.zeros(k**3, np.int32)
        place[distinct] = np.arange(len(distinct))
        gram = place[value]
    else:
        distinct, gram = np.unique(value, return_inverse=True)
    codes = np.stack([symbols[distinct // (k * k)], symbols[distinct // k % k], symbols[distinct % k]], axis=1) if len(distinct) else np.zeros((0, 3), np.uint32)
    return Trigrams(codes, of[inside], gram, letters)


def gram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """The trigram's letters, each permuted by its place, bound by multiplication."""
    symbols, index = np.unique(codes, return_inverse=True)
    index = index.reshape(codes.shape)
    base = np.stack([letter_vector(int(c), dimensions) for c in symbols]) if len(symbols) else np.zeros((0, dimensions), np.float32)
    return np.roll(base, 2, axis=1)[index[:, 0]] * np.roll(base, 1, axis=1)[index[:, 1]] * base[index[:, 2]]


def bundles(grams: Trigrams, rows: np.ndarray, weights: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """Sums of trigram vectors: ``rows`` gives the row of each occurrence and ``weights`` what it adds."""
    out = np.zeros((n, dimensions), np.float32)
    step = max(1, min(4096, CELLS // max(n, 1)))
    order = np.argsort(grams.gram, kind="stable")
    gram, rows, weights = grams.gram[order], rows[order], weights[order]
    for first in range(0, len(grams.codes), step):
        last = min(first + step, len(grams.codes))
        lo, hi = np.searchsorted(gram, (first, last))
        cells = rows[lo:hi].astype(np.int64) * (last - first) + (gram[lo:hi] - first)
        counts = np.bincount(cells, weights=weights[lo:hi], minlength=n * (last - first)).astype(np.float32)
        out += counts.reshape(n, last - first) @ gram_vectors(grams.codes[first:last], dimensions)
    return out


def held_out(id_: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _profiles(dimensions: int):
    """Per task and language one bundle, each document weighing the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, limit=TEXT_BYTES):
            langs = batch.column("lang").to_pylist()
            names = list(dict.fromkeys(langs))
            of = np.array([names.index(x) for x in langs])
            grams = trigrams(batch.column("text").to_pylist())
            if not len(grams.gram):
                continue
            n = np.bincount(grams.doc, minlength=len(langs))
            found = bundles(grams, of[grams.doc], 1.0 / n[grams.doc], len(names), dimensions)
            for i, name in enumerate(names):
                sums[name] = sums.get(name, 0) + found[i].astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "bundle"]
        )

    return run


def language_prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A unit vector for each language of the documents that are not held out.

    Each task bundles what it reads, and the bundles are summed by place on the executors; one
    vector per language reaches the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    parts = known.mapInArrow(_profiles(dimensions), "lang string, bundle array<double>")
    # Rounded to whole units, so that the sum does not hang on the order of the tasks.
    places = parts.select("lang", F.posexplode("bundle").alias("place", "v")).withColumn("v", F.round(F.col("v") * 1e6).cast("decimal(38,0)"))
    sums = places.groupBy("lang", "place").agg(F.sum("v").cast("double").alias("v")).groupBy("lang").agg(F.collect_list(F.struct("place", "v")).alias("vs"))
    found = {}
    for row in sums.collect():
        vector = np.zeros(dimensions)
        for place, v in row["vs"]:
            vector[place] = v
        if (length := np.linalg.norm(vector)) > 0:
            found[row["lang"]] = vector / length
    return dict(sorted(found.items()))


def classify(texts: list[str | None], prototypes: dict[str, np.ndarray], sharpness: float = SHARPNESS) -> tuple[np.ndarray, ...]:
    """Language, score and cosine of each text."""
    n, names = len(texts), list(prototypes)
    pred, score, cosine = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
    grams = trigrams(texts)
    if names and len(grams.gram):
        matrix = np.stack(list(prototypes.values())).astype(np.float32)
        vectors = bundles(grams, grams.doc, np.ones(len(grams.doc)), n, matrix.shape[1])
        length = np.linalg.norm(vectors, axis=1)
        known = (grams.letters > 0) & (length > 0)
        cos = (vectors[known] / length[known, None]) @ matrix.T
        soft = np.exp(sharpness * (cos - cos.max(axis=1, keepdims=True)))
        pred[known] = np.array(names, object)[cos.argmax(axis=1)]
        score[known] = (1 / soft.sum(axis=1)).clip(0, 1)
        cosine[known] = cos.max(axis=1)
    return pred, score, cosine


def _classify(prototypes: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            pred, score, cosine = classify(batch.column("text").to_pylist(), prototypes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(cosine)],
                names=["doc_id", "held_out", "lang_pred", "score", "cosine"],
            )

    return run


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, prototypes: dict[str, np.ndarray] | None = None
) -> DataFrame:
    """The language of every whole text, learned from the documents themselves unless prototypes are given.

    A letter has a random vector of +1 and -1. A trigram is its three letters' vectors, shifted by
    place and multiplied; a document or language is the sum of its trigrams. The language whose sum has
    the largest cosine with the document's is predicted; score is its share when cosines are sharpened
    to weights.

    Only text and language of rows with crc32(id as text) mod 4 other than 2 and a language are learned
    from. Texts without a letter, null ones too, are ``und`` with score 0; so is everything if there is
    no language to learn. Rows with a null id are learned from and not held out. Repeated rows each
    count and each get a row. Returns doc_id, held_out, lang_pred, score, cosine.
    """
    if prototypes is None:
        prototypes = language_prototypes(docs, id_col, text_col, lang_col, dimensions)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double, cosine double"
    return slim.mapInArrow(_classify(prototypes), schema)


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: those predicted ``und`` go.

    The rows are judged where they are read; nothing is shuffled.
    """
    prototypes = language_prototypes(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, TEXT_BYTES):
            pred, _, _ = classify(batch.column(text_col).to_pylist(), prototypes)
            yield batch.filter(pa.array(pred != UNKNOWN))

    return docs.mapInArrow(run, docs.schema)
