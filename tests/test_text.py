import pytest
from pyspark.sql import functions as F

from tapewire.functions.text import (
    CAUSAL,
    CORRELATIONAL,
    compose_text,
    keyword_match,
    path_key,
    with_weak_label,
)


def labels(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = {r.i: r.label for r in with_weak_label(df, **kw).collect()}
    return [found.get(i) for i in range(len(texts))]


def test_every_phrase(spark):
    texts = [f"Prices {p.upper()} demand" for p in (*CAUSAL, *CORRELATIONAL)]
    assert labels(spark, texts) == ["causal"] * 34 + ["correlational"] * 18


def test_priority_substrings_and_gaps(spark):
    texts = ["tied to X because", "whence", "correlated to", "nothing here", "", None]
    assert labels(spark, texts) == ["causal", "causal", "correlational", None, None, None]


def test_word_boundary(spark):
    texts = ["whence", "hence", "Hence!", "reproduced"]
    assert labels(spark, texts, word_boundary=True) == [None, "causal", "causal", None]


def test_text_is_lowered_and_searched_once(spark):
    df = spark.createDataFrame([(1, "x")], "i int, text string")
    plan = with_weak_label(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1
    assert plan.count("Contains") <= 2 * 52 and plan.count("Filter") == 0


def test_composed_text_keeps_gaps(spark):
    df = spark.createDataFrame(
        [("a", None, "b"), (None, None, None), (" \xa0t", "d", "\n")],
        "title string, description string, body string",
    )
    assert [r.t for r in df.select(compose_text(df.columns).alias("t")).collect()] == ["a  b", "", "t d"]
    assert df.select(compose_text(["body"]).alias("t")).first().t == "b"


def test_phrase_across_parts(spark):
    df = spark.createDataFrame([("led", "to", None)], "title string, description string, body string")
    df = df.select(compose_text(df.columns).alias("text"))
    assert with_weak_label(df).first().label == "causal"


@pytest.mark.parametrize("text, hit", [("Oil rises", True), ("soil", False), ("the FED.", True), ("a.b", False), ("x a+b y", True)])
def test_keywords(spark, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(keyword_match(F.col("t"), "oil OR fed OR a+b")).first()[0] is hit


def test_path_key(spark):
    df = spark.createDataFrame([("^VIX",), ("CL=F",), ("A/B ",)], "t string")
    assert [r[0] for r in df.select(path_key(F.col("t"))).collect()] == ["IDX_VIX", "CL_F", "A_B"]
