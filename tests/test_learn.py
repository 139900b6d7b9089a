import math
import re
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tapewire.operators import linear, terms
from tapewire.operators.report import classification_report, format_report
from tapewire.operators.split import class_sizes, stratified_split, time_split
from tapewire.operators.terms import (
    explode_terms,
    fit_tfidf,
    term_counts,
    terms_transformer,
    vocabulary,
    weights_by_term,
)
from tapewire.plans.train_baseline import fit_classifier, predict, train_baseline

TEXTS = ["Oil oil GAS x", "gas élan_1 oil", "", "one", "oil gas gas oil"]


def grams(text, high=2):
    t = re.findall(r"\b\w\w+\b", text.lower())
    return t + [" ".join(t[i : i + n]) for n in range(2, high + 1) for i in range(len(t) - n + 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")


@pytest.mark.parametrize("high", [1, 2, 3])
def test_terms(docs, high):
    out = terms_transformer(ngram_range=(1, high)).transform(docs)
    got = {r.doc: Counter(r.terms) for r in out.collect()}
    assert got == {i: Counter(grams(t, high)) for i, t in enumerate(TEXTS)}
    assert explode_terms(out, "doc").count() == sum(len(grams(t, high)) for t in TEXTS)


def test_counts_and_vocabulary(docs):
    out = terms_transformer().transform(docs)
    tf = Counter(g for t in TEXTS for g in grams(t))
    df = Counter(g for t in TEXTS for g in set(grams(t)))
    assert {r.term: (r.tf, r["df"]) for r in term_counts(out).collect()} == {g: (tf[g], df[g]) for g in tf}
    best = [r.term for r in vocabulary(out, min_df=2, max_features=2).collect()]
    assert best == sorted((g for g in tf if df[g] >= 2), key=lambda g: (-tf[g], g))[:2]


def test_weights(docs):
    got = {(r.doc, r.term): r.weight for r in weights_by_term(fit_tfidf(docs), docs, "doc").collect()}
    df = Counter(g for t in TEXTS for g in set(grams(t)))
    want = {}
    for i, t in enumerate(TEXTS):
        raw = {
            g: n * (math.log((1 + len(TEXTS)) / (1 + df[g])) + 1)
            for g, n in Counter(grams(t)).items()
            if df[g] >= 2
        }
        norm = math.sqrt(sum(w * w for w in raw.values()))
        want.update({(i, g): w / norm for g, w in raw.items()})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_terms_are_counted_in_parts_of_bounded_text(spark, monkeypatch):
    """However large the parts of the input, a task counts the terms of about PART_BYTES of text."""
    monkeypatch.setattr(terms, "PART_BYTES", 1 << 12, raising=False)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("w"), (F.col("id") * 7 + k) % 90)))
    whole = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc"), text.alias("text"))
    sizes = terms.dealt(whole).groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert sum(r.n for r in sizes) > 10 * terms.PART_BYTES and max(r.n for r in sizes) < 2 * terms.PART_BYTES
    weights = terms.fit_tfidf(whole)
    got = terms.weights_by_term(weights, whole, "doc")
    assert f"RoundRobinPartitioning({len(sizes)})" in plan_of(got)
    monkeypatch.setattr(terms, "PART_BYTES", 1 << 30)
    want = {(r.doc, r.term): r.weight for r in terms.weights_by_term(weights, whole, "doc").collect()}
    assert {(r.doc, r.term): r.weight for r in got.collect()} == pytest.approx(want, abs=1e-12)


def test_no_terms(docs):
    with pytest.raises(ValueError):
        fit_tfidf(docs, min_df=100)


def test_class_sizes():
    assert class_sizes({"a": 50, "b": 50}, 0.2) == {"a": 10, "b": 10}
    sizes = class_sizes({"a": 7, "b": 11, "c": 3}, 0.2)
    assert sum(sizes.values()) == math.ceil(21 * 0.2)
    with pytest.raises(ValueError):
        class_sizes({"a": 1, "b": 9}, 0.2)


def rows(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("url"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label")
    )


def test_split_is_exact_and_repeatable(spark):
    data = rows(spark)
    train, test = stratified_split(data)
    assert {r.label: r["count"] for r in test.groupBy("label").count().collect()} == {"a": 20, "b": 40}
    assert train.count() == 240 and train.join(test, "url").count() == 0
    again = stratified_split(data.repartition(7))[1]
    assert {r.url for r in again.collect()} == {r.url for r in test.collect()}
    other = stratified_split(data, seed=7)[1]
    assert {r.url for r in other.collect()} != {r.url for r in test.collect()}


def test_split_between_copies(spark):
    """Nearly all rows share one key, yet the sizes are exact and no row is lost."""
    data = rows(spark).withColumn("n", F.col("url") % 11).withColumn("url", F.when(F.col("url") < 290, F.lit(0)).otherwise(F.col("url")))
    tests = []
    for parts in (2, 7):
        train, test = stratified_split(data.repartition(parts, "n"))
        assert {r.label: r["count"] for r in test.groupBy("label").count().collect()} == {"a": 20, "b": 40}
        assert train.count() == 240
        tests.append(sorted(tuple(r) for r in test.collect()))
    assert tests[0] == tests[1]


def test_split_between_rows_that_differ_in_the_place_of_nulls(spark):
    kinds = [(None, "x", {"a": None, "b": "y"}), ("x", None, {"a": None, "b": "y"}), (None, "x", {"a": "y", "b": None})]
    data = spark.createDataFrame([("a", 0, *k) for k in kinds for _ in range(20)], "label string, url int, title string, description string, more struct<a: string, b: string>")
    train, test = stratified_split(data)
    assert test.count() == 12
    counts = train.union(test).groupBy("title", "description", "more").count().collect()
    assert sorted(r["count"] for r in counts) == [20, 20, 20]


def test_report(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] * 1 + [("b", "b")] * 2 + [("b", "c")] * 2 + [("d", "a")]
    df = spark.createDataFrame(pairs + [(None, "a")], "label string, prediction string")
    got = {r.name: r for r in classification_report(df).collect()}
    assert set(got) == {"a", "b", "c", "d", "accuracy", "macro avg", "weighted avg"}
    want = {"a": (3 / 4, 3 / 4, 4), "b": (2 / 3, 1 / 2, 4), "c": (0, 0, 0), "d": (0, 0, 1)}
    for name, (precision, recall, support) in want.items():
        f1 = 0 if precision + recall == 0 else 2 * precision * recall / (precision + recall)
        r = got[name]
        assert (r.precision, r.recall, r.f1_score, r.support) == (
            pytest.approx(precision), pytest.approx(recall), pytest.approx(f1), support,
        )
    assert got["accuracy"].f1_score == pytest.approx(5 / 9)
    assert got["macro avg"].recall == pytest.approx((3 / 4 + 1 / 2) / 4)
    assert got["weighted avg"].precision == pytest.approx((4 * 3 / 4 + 4 * 2 / 3) / 9)
    text = format_report(got.values())
    assert "0.750" in text and text.splitlines()[0].split() == ["precision", "recall", "f1-score", "support"]


def test_baseline(spark, tmp_path):
    from pyspark.ml import PipelineModel

    words = {"causal": "rain caused floods", "correlational": "umbrellas linked to floods"}
    data = spark.createDataFrame(
        [(f"u{i}", f"{words[label]} number{i % 5}", label) for i in range(30) for label in words],
        "url string, text string, label string",
    ).withColumn("url", F.concat("url", "label"))
    result = train_baseline(data, max_iter=20)
    assert result.predictions.columns == ["url", "label", "prediction"]
    assert result.predictions.where("label = prediction").count() == 12
    assert "accuracy" in result.text()
    result.model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert predict(loaded, data).where("label = prediction").count() == 60


def _parts(data, **how):
    train, test = time_split(data, "at", ["n"], **how)
    return Counter(train.collect()), Counter(test.collect())


@pytest.mark.parametrize("gap", [0, 1, 7])
def test_time_split_is_exact_and_repeatable(spark, gap):
    """Microseconds apart, many at one instant, before 1970, and without a time."""
    data = spark.range(500).selectExpr(
        "id AS n", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN timestamp_micros(1700000000000000) ELSE timestamp_micros((id * 7919 % 500 - 250) * 6800000000001) END AS at"
    )
    train, test = _parts(data, gap=gap)
    assert (sum(test.values()), sum(train.values())) == (98, 490 - 98 - gap)
    assert max(r["at"] for r in train) <= min(r["at"] for r in test)
    assert _parts(data.repartition(7, "at"), gap=gap) == (train, test)


@pytest.mark.parametrize("gap", [0, 3, 40])
def test_time_split_between_copies(spark, gap):
    """All rows at one time, of four keys; rows that are equal in every column are dealt out by number."""
    data = spark.range(100).selectExpr("id % 4 AS n", "timestamp'2024-01-01' AS at", "CASE WHEN id < 60 THEN 'same' ELSE cast(id AS string) END AS text")
    train, test = _parts(data, gap=gap)
    assert (sum(train.values()), sum(test.values())) == (80 - gap, 20)
    assert not (train + test) - Counter(data.collect())
    assert _parts(data.repartition(5, "text"), gap=gap) == (train, test)


def test_time_split_refusals(spark):
    data = spark.range(10).selectExpr("id AS n", "timestamp'2024-01-01' AS at")
    for rows, gap in ((data, 8), (data.limit(0), 0), (data, -1), (data.withColumn("at", F.lit(None).cast("timestamp")), 0)):
        with pytest.raises(ValueError):
            time_split(rows, "at", ["n"], gap=gap)


def test_baseline_by_time(spark):
    """The test articles are the last ones, and what is learned from the others holds for them."""
    data = spark.range(200).selectExpr(
        "concat('u', id) AS url", "timestamp_seconds(id * 3600) AS published_at", "CASE WHEN id % 2 = 0 THEN 'prices rose because of oil' ELSE 'prices linked to gas' END AS text", "CASE WHEN id % 2 = 0 THEN 'causal' ELSE 'other' END AS label"
    )
    found = train_baseline(data, by_time="published_at", gap=10).predictions
    assert {r.url for r in found.collect()} == {f"u{i}" for i in range(160, 200)}
    assert found.where("prediction <> label").count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    """Rows, features, and models of two and of three classes."""
    words = "oil gas coal price rose fell because linked demand supply".split()
    data = [(i, " ".join(words[(i * k + k) % 10] for k in range(1, 6)), "abc"[i % 3 if i % 5 else 0]) for i in range(60)]
    rows = spark.createDataFrame(data, "key int, text string, label string")
    two = rows.withColumn("label", F.when(F.col("label") == "c", "b").otherwise(F.col("label")))
    weights = fit_tfidf(rows)
    return rows, two, weights_by_term(weights, rows, "key").cache(), weights.documents


def test_table_predicts_as_the_pipeline_does(spark, fitted):
    rows, two, features, _ = fitted
    for data in (rows, two):
        model = fit_classifier(data)
        scores = linear.margins(data, features, linear.model_table(model, spark), "key")
        want = {r.key: (r.prediction, list(r.probability)) for r in model.transform(data).collect()}
        assert {r.key: r.prediction for r in linear.predicted(scores, "key").collect()} == {k: p for k, (p, _) in want.items()}
        got = {}
        for r in linear.probabilities(scores, "key").collect():
            got.setdefault(r.key, {})[r["class"]] = r.probability
        for k, (_, p) in want.items():
            assert [got[k][c] for c in sorted(got[k])] == pytest.approx(p, abs=1e-9)


def test_ties_and_texts_without_known_terms(spark):
    model = spark.createDataFrame([("b", "", 1.0), ("a", "", 1.0), ("c", "", 0.5), ("b", "x", 2.0)], "class string, term string, weight double")
    keys = spark.createDataFrame([(1,), (2,)], "key int")
    features = spark.createDataFrame([(2, "x", 0.5), (2, "unknown", 9.0)], "key int, term string, weight double")
    scores = linear.margins(keys, features, model, "key")
    assert {(r.key, r["class"]): r.margin for r in scores.collect()} == {(1, "a"): 1.0, (1, "b"): 1.0, (1, "c"): 0.5, (2, "a"): 1.0, (2, "b"): 2.0, (2, "c"): 0.5}
    assert {r.key: r.prediction for r in linear.predicted(scores, "key").collect()} == {1: "a", 2: "b"}


def test_slopes_vanish_for_the_fitted_model_only(spark, fitted):
    """Also against differences of the loss, taken one weight at a time."""
    _, two, features, n = fitted
    steep = F.max(F.abs("slope"))
    best = linear.model_table(fit_classifier(two, tolerance=1e-6), spark)
    assert linear.slopes(two, features, best, "key", 1 / n).agg(steep).first()[0] < 1e-3
    # only the intercepts fitted, and one weight moved
    flat = linear.model_table(fit_classifier(two, max_iter=0), spark)
    assert linear.slopes(two, features, flat, "key", 1 / n).agg(steep).first()[0] > 1e-2
    moved = best.withColumn("weight", F.col("weight") + F.when((F.col("term") == "oil") & (F.col("class") == "b"), 1.0).otherwise(0.0))
    assert linear.slopes(two, features, moved, "key", 1 / n).agg(steep).first()[0] > 5e-3

    weights = {(r["class"], r.term): r.weight for r in flat.collect()}
    held = {}
    for r in features.collect():
        held.setdefault(r.key, {"": 1.0})[r.term] = r.weight
    label = {r.key: r.label for r in two.collect()}

    def loss(w):
        total = 0.0
        for k, own in label.items():
            m = {c: sum(x * w.get((c, t), 0.0) for t, x in held.get(k, {"": 1.0}).items()) for c in "ab"}
            total += math.log(sum(math.exp(v) for v in m.values())) - m[own]
        return total / len(label) + sum(v * v for (_, t), v in w.items() if t) / (2 * n)

    got = {(r["class"], r.term): r.slope for r in linear.slopes(two, features, flat, "key", 1 / n).collect()}
    for at in [("b", ""), ("b", "oil"), ("b", "because")]:
        up, down = (loss({**weights, at: weights[at] + h}) for h in (1e-5, -1e-5))
        assert got[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
