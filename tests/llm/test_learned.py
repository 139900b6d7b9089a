"""Language, quality and toxicity: held-out accuracy on the test tables, and odd rows."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import zstandard
from llm_cases import ODD, odd  # noqa: F401

from tapewire.llm import toxicity
from tapewire.llm.calibrate import pool
from tapewire.llm.language import classify, gram_vectors, identify_languages, language_prototypes, letter_vector, trigrams, with_language
from tapewire.llm.quality import NAMES, score_quality, statistics
from tapewire.llm.toxicity import score_toxicity

BIG = "/root/testdata/sf0.01"


def _fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = identify_languages(docs).collect()
    assert all(r.held_out == (_fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.98
    # Labels of held-out rows change nothing.
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    assert sorted(map(tuple, identify_languages(other).collect())) == sorted(map(tuple, got))


def test_trigram_vectors_by_hand():
    grams = trigrams(["Ab", None, "", "1 2", "x-Y", "Ωß", "\u0301\u0302", "x\u0301", "𝔞", "\U000e0101"])
    assert [bool(x) for x in grams.letters] == [True, False, False, False, True, True, False, True, True, False]
    spelled = {d: ["".join(chr(c) if c else "_" for c in grams.codes[g]) for g in grams.gram[grams.doc == d]] for d in range(10)}
    assert spelled == {0: ["_ab", "ab_"], 1: [], 2: [], 3: [], 4: ["_x_", "x_y", "_y_"], 5: ["_ωß", "ωß_"], 6: [], 7: ["_x\u0301", "x\u0301_"], 8: ["_𝔞_"], 9: []}
    a, b, gap = (letter_vector(c, 64) for c in (97, 98, 0))
    assert (gram_vectors(np.array([[0, 97, 98]]), 64)[0] == np.roll(gap, 2) * np.roll(a, 1) * b).all()


def _profile(text, dimensions):
    """One letter at a time."""
    spelled, out = [0], np.zeros(dimensions)
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            spelled.append(ord(c))
        elif spelled[-1]:
            spelled.append(0)
    spelled += [0] if spelled[-1] else []
    if any(c and unicodedata.category(chr(c))[0] == "L" for c in spelled):
        for k in range(len(spelled) - 2):
            a, b, c = (letter_vector(x, dimensions).astype(float) for x in spelled[k : k + 3])
            out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_language_against_a_plain_version(spark):
    """Profiles letter by letter, prototypes as their sums by language, and cosines, on rows of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    rows = docs.collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs).collect()}
    protos = language_prototypes(docs)
    grams = trigrams([r.text for r in rows[:25]])
    for d, r in enumerate(rows[:25]):
        own = grams.gram[grams.doc == d]
        assert np.allclose(gram_vectors(grams.codes[own], 64).sum(axis=0), _profile(r.text, 64))
    pred, score, _ = classify([r.text for r in rows], protos)
    assert {r.doc_id: p for r, p in zip(rows, pred, strict=True)} == {i: p for i, (p, _) in found.items()}
    assert np.allclose(score, [found[r.doc_id][1] for r in rows])


def test_language_odd_rows(odd):
    found = identify_languages(odd)  # no language to learn from
    assert {r.lang_pred for r in found.collect()} == {"und"} and found.count() == len(ODD)
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "1 AS held_out")
    by_id = {r.doc_id: r.lang_pred for r in identify_languages(docs).collect()}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[-9] == "und" and by_id[5] == by_id[11] == "en"
    assert identify_languages(docs.limit(0)).count() == 0
    kept = with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 5
    pred, score, _ = classify(["abc", None], language_prototypes(docs))
    assert pred.tolist() == ["en", "und"] and score[0] == 1 and score[1] == 0


@pytest.mark.parametrize(
    ("score", "column", "cut", "least"), [(score_quality, "quality", 0.3, 0.95), (score_toxicity, "toxic", 0.5, 0.85)]
)
def test_held_out_accuracy(spark, score, column, cut, least):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    truth = {r.doc_id: r[column] for r in labels.collect()}
    got = score(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (_fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > least
    # Labels of held-out rows change nothing.
    other = labels.selectExpr("doc_id", f"CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - {column} ELSE {column} END AS {column}")
    assert [abs(a.score - b.score) < 1e-9 for a, b in zip(sorted(got), sorted(score(docs, other).collect()), strict=True)] == [True] * len(got)


@pytest.mark.parametrize(("score", "column"), [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_odd_rows(spark, odd, score, column):
    none = spark.createDataFrame([(None, 1), (5, None)], f"doc_id long, {column} int")
    got = score(odd, none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in (*range(1, 15), *range(5, 9))], f"doc_id long, {column} int")
    got = score(odd, some).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert score(odd.limit(0), some).count() == 0


def test_statistics_by_hand():
    import pyarrow as pa

    names = dict(zip(NAMES, statistics(pa.array(["Ab ab ab, 12!\nAb ab $", None, ""]))[0], strict=True))
    assert names["word_length"] == pytest.approx((2 + 2 + 3 + 3 + 2 + 2 + 1) / 7)
    assert names["distinct_words"] == pytest.approx(5 / 7) and names["top_word"] == pytest.approx(2 / 7)
    assert names["digits"] == pytest.approx(2 / 21) and names["bare_signs"] == pytest.approx(2 / 7)
    assert names["log_line_words"] == pytest.approx(np.log1p(3.5)) and names["capitals"] == pytest.approx(2 / 7)
    assert statistics(pa.array(["", None], pa.string())).tolist() == [[0.0] * len(NAMES)] * 2


def test_pool():
    assert pool(np.array([1.0, 0.0, 2.0, 2.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0, 2.0])).tolist() == [0.5, 0.5, 1.5, 1.5, 1.5]


def test_margins_prefer_their_dictionary(spark):
    rows = [(k, f"plain words number {k} you scoundrel and villain") for k in range(60)]
    rows += [(k, f"plain words number {k} with nothing else in it") for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = docs.selectExpr("doc_id AS label_id", "doc_id < 100 AS toxic").selectExpr("label_id", "cast(toxic AS double) AS label")
    distance = toxicity.train(docs, known)
    assert distance.margin(b" scoundrel ") > 2 > distance.margin(b" number ")
    assert distance.counts("").sum() == 0 and distance.counts("You SCOUNDREL!").sum() == 2


def test_toxic_words_of_many_beginnings(spark):
    """400 toxic words without common beginnings, six of them in a toxic text of otherwise ordinary words."""
    rng = random.Random(4)

    def word(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    vicious, usual = [word(9) for _ in range(400)], [word(rng.randint(3, 9)) for _ in range(3000)]
    assert len({w[:4] for w in vicious}) > 350
    rows = []
    for i in range(5000):
        own = rng.choices(usual, k=40) + (rng.choices(vicious, k=6) if i % 2 else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own), i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect() if r.held_out}
    assert np.mean([p for i, p in got.items() if i % 2]) > 0.95 and np.mean([p for i, p in got.items() if not i % 2]) < 0.02


def _curve(raw, label, low, high, bins=2000):
    """The isotonic curve by its definition: at each bin the largest mean to the left of the smallest mean to the right."""
    cells = {}
    for r, y in zip(raw, label, strict=True):
        cells.setdefault(min(max(int(np.floor((r - low) / (high - low) * bins)), 0), bins - 1), []).append((r, y))
    cells = [cells[k] for k in sorted(cells)]
    n, y = np.array([len(c) for c in cells], float), np.array([sum(y for _, y in c) for c in cells], float)
    x = [np.mean([r for r, _ in c]) for c in cells]
    level = []
    for i in range(len(cells)):
        level.append(max(min(y[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(cells))) for j in range(i + 1)))
    level, knots, values = np.array(level).round(12), [], []
    for v in sorted(set(level)):
        own = np.flatnonzero(level == v)
        knots += [x[own[0]], x[own[-1]]]
        values += 2 * [(y[own].sum() + 0.5) / (n[own].sum() + 1)]
    return lambda r: np.interp(r, knots, np.maximum.accumulate(values))


def _labelled(spark, column):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    truth = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    return docs, labels, docs.collect(), truth


def test_toxicity_against_a_plain_version(spark):
    """Every window compressed with every dictionary, nothing remembered or cut short, and scores from counts in plain Python."""
    docs, labels, rows, truth = _labelled(spark, "toxic")
    known = toxicity.labels_of(labels, "toxic").where("pmod(crc32(cast(label_id AS string)), 5) BETWEEN 1 AND 3")
    fitted = toxicity.train(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), known)

    def coder(content):
        d = zstandard.ZstdCompressionDict(content)
        options = zstandard.ZstdCompressionParameters.from_level(
            19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        d.precompute_compress(compression_params=options)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress

    sides, spare = [[coder(c) for c in side] for side in (fitted.plain, fitted.toxic)], len(fitted.plain) // 5
    cache = {}
    counts = []
    for r in rows:
        own = [0] * 9
        for w in (r.text or "").lower().encode().split():
            w = b" " + w.strip(b".,;:!?*$%&#|\"()'") + b" "
            if w not in cache:
                plain, toxic = (sorted(len(c(w + b" " * 48)) for c in side) for side in sides)
                cache[w] = min(max(plain[spare] - toxic[-1 - spare], 0), 8)
            own[cache[w]] += 1
        counts.append(own)
    counts = np.array(counts, float)
    fold = np.array([_fold(r.doc_id, 5) for r in rows])
    label = np.array([truth.get(r.doc_id, -1) for r in rows], float)
    a, b = (counts[(fold == 4) & (label == k)].sum(axis=0) + 1 for k in (1, 0))
    sums = counts @ (np.log(a / a.sum()) - np.log(b / b.sum()))
    raw, fit = sums / (8 + np.abs(sums)), (fold == 4) & (label >= 0)
    want = dict(zip([r.doc_id for r in rows], _curve(raw[fit], label[fit], -1, 1)(raw), strict=True))
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-9


def test_toxic_lengths_of_several_dictionaries():
    """The early end of a measurement changes no margin."""
    rng = random.Random(2)
    texts = [[" ".join("".join(rng.choices("abcd", k=5)) for _ in range(300)) for _ in range(11)] for _ in range(2)]
    d = toxicity.Distance(*([toxicity.dictionary([t]) for t in side] for side in texts))
    for w in toxicity.windows(" ".join("".join(rng.choices("abcd", k=5)) for _ in range(400))):
        plain, toxic = (sorted(len(c[k](w + b" " * 48)) for c in d.coders) for k in (0, 1))
        assert d.margin(w) == min(max(plain[2] - toxic[-3], 0), 8)


def test_words_are_measured_once(monkeypatch):
    """A word takes one place of those remembered, whatever signs it comes with."""
    monkeypatch.setattr(toxicity, "REMEMBERED", 100)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(100)]
    assert len(set(words)) == 100
    sides = [[toxicity.dictionary([" ".join(words[k::2])])] for k in (0, 1)]
    d, measured = toxicity.Distance(*sides), []
    monkeypatch.setattr(toxicity.Distance, "_measure", lambda self, w, plain=toxicity.Distance._measure: measured.append(w) or plain(self, w))
    texts = [" ".join(words), " ".join(f"{w}," for w in words), " ".join(f'"{w}!' for w in words)]
    counts = [d.counts(t).tolist() for t in texts]
    assert sorted(measured) == sorted(toxicity.windows(texts[0]))
    assert counts == [[sum(min(d.margin(w), 8) == k for w in toxicity.windows(texts[0])) for k in range(9)]] * 3


def _plain_statistics(text):
    """The statistics of ``NAMES`` from words and lines as Python objects."""
    data = (text or "").encode()
    lines = [own for own in (re.findall(rb"[^ \t-\r]+", part) for part in data.split(b"\n")) if own]
    ws = [w for own in lines for w in own]
    n, size = len(ws), len(data)
    some = max(n, 1)
    upper, digits = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    stops, symbols = b".,;:'\"()-?", b"!#$%&*+/<=>@[\\]^_`{|}~"
    share = [sum(c in k for c in data) / max(size, 1) for k in (upper, digits, stops, symbols)]
    share.append(sum(c >= 128 for c in data) / max(size, 1))
    lengths = [len(w) for w in ws]
    mean = sum(lengths) / some
    spread = max(sum(k * k for k in lengths) / some - mean**2, 0) ** 0.5
    no_letter = digits + stops + symbols

    def repeated(k):
        grams = [tuple(ws[i : i + k]) for i in range(n - k + 1)]
        return 1 - len(set(grams)) / len(grams) if grams else 0

    m = len(lines)
    return [
        np.log1p(size), np.log1p(n), mean, spread, *share, sum(k <= 3 for k in lengths) / some, sum(w[-1] in stops + symbols for w in ws) / some,
        sum(all(c in no_letter for c in w) for w in ws) / some, len(set(ws)) / some, max((ws.count(w) for w in set(ws)), default=0) / some,
        repeated(2), repeated(10), np.log1p(n / max(m, 1)), len({tuple(own) for own in lines}) / max(m, 1),
        sum(w[0] in upper for w in ws) / some, np.log1p(max(lengths, default=0)), sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / some,
    ]


def test_quality_against_a_plain_version(spark):
    """Statistics word by word, the kernel's features, ridge regression and curve over all rows in one matrix."""
    docs, labels, rows, truth = _labelled(spark, "quality")
    stats = np.array([_plain_statistics(r.text) for r in rows])
    scale = stats.std(axis=0)
    scaled = ((stats - stats.mean(axis=0)) / np.where(scale > 1e-9, scale, 1)).clip(-6, 6)
    rng = np.random.default_rng(7)
    direction, phase = rng.standard_normal((21, 256)) / np.sqrt(21), rng.uniform(0, 2 * np.pi, 256)
    z = np.hstack([np.ones((len(rows), 1)), np.sqrt(2 / 256) * np.cos(scaled @ direction + phase)])
    fold = np.array([_fold(r.doc_id, 5) for r in rows])
    label = np.array([truth.get(r.doc_id, -1) for r in rows], float)
    fit, tune = np.isin(fold, (1, 2, 3)) & (label >= 0), (fold == 4) & (label >= 0)
    # The penalty as further rows of a least-squares problem.
    more = np.sqrt(1e-4 * fit.sum() + 1e-9) * np.eye(257)
    more[0, 0] = 1e-9**0.5
    weights = np.linalg.lstsq(np.vstack([z[fit], more]), np.append(label[fit], np.zeros(257)), rcond=None)[0]
    raw = z @ weights
    want = dict(zip([r.doc_id for r in rows], _curve(raw[tune], label[tune], -1, 2)(raw), strict=True))
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6
