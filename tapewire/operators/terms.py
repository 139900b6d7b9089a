"""Word n-grams, vocabulary and TF-IDF weights."""

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# A token is a run of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
NGRAM_RANGE = (1, 2)
MIN_DF = 2
MAX_FEATURES = 100_000
#: Text whose terms one task counts. A row for each text and term takes some 50 times its bytes in memory.
PART_BYTES = 4 << 20


def terms_transformer(
    text: str = "text", output: str = "terms", ngram_range: tuple[int, int] = NGRAM_RANGE
) -> SQLTransformer:
    """Adds the n-grams of the lower-cased text, in built-in expressions."""
    low, high = ngram_range
    grams = [_grams(n) for n in range(low, high + 1)]
    joined = grams[0] if len(grams) == 1 else f"concat({', '.join(grams)})"
    return SQLTransformer(
        statement=f"SELECT * EXCEPT (_tokens), {joined} AS {output} FROM ("
        f"SELECT *, regexp_extract_all(lower({text}), r'{TOKEN}', 0) AS _tokens FROM __THIS__)"
    )


def _grams(n: int) -> str:
    """The n-grams as SQL: those of one word less, each joined with its next token."""
    if n == 1:
        return "_tokens"
    count = f"greatest(size(_tokens) - {n - 1}, 0)"
    return (
        f"zip_with(slice({_grams(n - 1)}, 1, {count}), slice(_tokens, {n}, {count}), "
        "(g, t) -> concat(g, ' ', t))"
    )


def dealt(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents in parts of about ``PART_BYTES`` of text each.

    Terms of a text hardly repeat, so that counting them by text holds nearly all terms of a
    task's part in memory. Parts of files follow the files' size, these do not.
    """
    size = documents.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    return documents.repartition(parts) if parts > 1 else documents


def explode_terms(documents: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """One row ``key, term`` per occurrence.

    The outer form keeps Spark from inferring a filter on the size of the list,
    for which it would build every list twice.
    """
    return documents.select(key, F.explode_outer(terms).alias("term")).where("term is not null")


def term_counts(documents: DataFrame, terms: str = "terms") -> DataFrame:
    """``term``, ``tf`` (occurrences) and ``df`` (documents) over all documents.

    The terms of a document are sorted in place, so that the first of each run
    of equal terms counts the document. One aggregation gives both numbers, and
    frequent terms are summed before the shuffle.
    """
    in_order = documents.select(F.sort_array(terms).alias("_terms"))
    marked = F.transform(
        "_terms",
        lambda term, i: F.struct(
            term.alias("term"),
            ((i == 0) | (F.get("_terms", i - 1) != term)).alias("first"),
        ),
    )
    return (
        in_order.select(F.inline_outer(marked))
        .where("term is not null")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"), F.count_if("first").alias("df"))
    )


def vocabulary(
    documents: DataFrame,
    terms: str = "terms",
    min_df: int = MIN_DF,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """The most frequent terms found in at least ``min_df`` documents."""
    return (
        term_counts(documents, terms)
        .where(F.col("df") >= min_df)
        .orderBy(F.col("tf").desc(), F.col("term"))
        .limit(max_features)
    )


def smooth_idf(documents: int, df: int) -> float:
    return math.log((1 + documents) / (1 + df)) + 1.0


@dataclass(frozen=True)
class TfidfWeights:
    """Fitted vocabulary and the transformers from text to weights."""

    terms: Sequence[str]
    idf: Sequence[float]
    documents: int
    stages: Sequence[Transformer]

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df


def _counter(spark: SparkSession, terms: Sequence[str]) -> CountVectorizerModel:
    """The model that counts ``terms``, handed to the JVM as one text. No token has a line feed in it."""
    words = spark._jvm.org.apache.commons.lang3.StringUtils.split("\n".join(terms), "\n")
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", words)
    return model.setInputCol("terms").setOutputCol("_tf")


def fit_tfidf(
    documents: DataFrame,
    text: str = "text",
    output: str = "features",
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    min_df: int = MIN_DF,
    max_features: int = MAX_FEATURES,
) -> TfidfWeights:
    """Vocabulary and idf of the documents.

    The driver holds the vocabulary, at most ``max_features`` terms, as the model
    itself must.
    """
    to_terms = terms_transformer(text, "terms", ngram_range)
    seen = Observation("documents")
    counted = to_terms.transform(documents.select(text).observe(seen, F.count(F.lit(1)).alias("n")))
    rows = vocabulary(counted, "terms", min_df, max_features).collect()
    if not rows:
        raise ValueError("no terms remain: every term is in fewer documents than min_df.")
    n = seen.get["n"]
    terms = [r["term"] for r in rows]
    idf = [smooth_idf(n, r["df"]) for r in rows]
    stages = [
        to_terms,
        _counter(documents.sparkSession, terms),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol=output),
    ]
    return TfidfWeights(terms, idf, n, stages)


def weights_by_term(
    weights: TfidfWeights, documents: DataFrame, key: str, text: str = "text", ngram_range: tuple[int, int] = NGRAM_RANGE
) -> DataFrame:
    """The weights of each document as rows ``key, term, weight``, by joining its terms with the vocabulary.

    As the vectors of ``weights.transform`` hold them, without building these.
    """
    spark = documents.sparkSession
    frame = pd.DataFrame({"term": list(weights.terms), "idf": list(weights.idf)})
    # as many rows as the vocabulary, which has a fixed upper limit
    known = F.broadcast(spark.createDataFrame(frame, "term string, idf double"))
    terms = terms_transformer(text, "terms", ngram_range).transform(dealt(documents.select(key, text), text))
    rows = terms.select(F.monotonically_increasing_id().alias("_row"), key, "terms")
    met = rows.select("_row", key, F.explode_outer("terms").alias("term")).join(known, "term")
    counted = met.groupBy("_row", key, "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    own = counted.withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("_row")))
    return own.select(key, "term", (F.col("raw") / length).alias("weight"))
