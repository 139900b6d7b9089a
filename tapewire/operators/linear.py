"""A linear text classifier as a table: weights by term, scores by join and sum, slopes of its loss.

``features`` are rows (key, term, weight) as of ``terms.weights_by_term``. A model is rows (class, term,
weight), with the intercept of a class under the empty term, which no text has.
"""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, IndexToString
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERCEPT = ""
_MODEL = "class string, term string, weight double"


def model_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """The weights of a pipeline of ``fit_classifier``: one row per class and term, as many as the model itself holds.

    Of two classes the first has no weights but an intercept of 0.
    """
    stages = {type(s): s for s in model.stages}
    terms = stages[CountVectorizerModel].vocabulary
    classes = stages[IndexToString].getLabels()
    fitted = stages[LogisticRegressionModel]
    if fitted.numClasses == 2:
        weights, intercepts = {classes[1]: fitted.coefficients.toArray()}, {classes[0]: 0.0, classes[1]: fitted.intercept}
    else:
        weights = dict(zip(classes, fitted.coefficientMatrix.toArray(), strict=True))
        intercepts = dict(zip(classes, fitted.interceptVector.toArray(), strict=True))
    rows = [(c, INTERCEPT, float(b)) for c, b in intercepts.items()]
    rows += [(c, t, float(w)) for c, own in weights.items() for t, w in zip(terms, own, strict=True)]
    return spark.createDataFrame(rows, _MODEL)


def margins(keys: DataFrame, features: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """``key``, class and margin, for every key and class.

    A margin is the intercept and the weights of the key's terms; a key with no term that the model knows has the intercept.
    """
    # as many rows as classes
    intercepts = model.where(F.col("term") == INTERCEPT).select("class", F.col("weight").alias("intercept"))
    classes = [(r["class"], r["intercept"]) for r in intercepts.collect()]
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(b).alias("intercept")) for c, b in classes])
    every = keys.select(key, F.inline(each))
    known = model.where(F.col("term") != INTERCEPT).withColumnRenamed("weight", "slope")
    sums = features.join(known, "term").groupBy(key, "class").agg(F.sum(F.col("weight") * F.col("slope")).alias("sum"))
    return every.join(sums, [key, "class"], "left").select(key, "class", (F.col("intercept") + F.coalesce("sum", F.lit(0.0))).alias("margin"))


def predicted(scores: DataFrame, key: str) -> DataFrame:
    """``key`` and prediction: the class with the largest margin, of equal ones the first by name."""
    # a list of as many as there are classes
    ranked = scores.groupBy(key).agg(F.max("margin").alias("top"), F.collect_list(F.struct("class", "margin")).alias("all"))
    best = F.transform(F.filter("all", lambda s: s["margin"] == F.col("top")), lambda s: s["class"])
    return ranked.select(key, F.array_min(best).alias("prediction"))


def probabilities(scores: DataFrame, key: str) -> DataFrame:
    """``key``, class and probability: the softmax of the margins."""
    top = scores.groupBy(key).agg(F.max("margin").alias("top"))
    raised = scores.join(top, key).select(key, "class", F.exp(F.col("margin") - F.col("top")).alias("e"))
    total = raised.groupBy(key).agg(F.sum("e").alias("total"))
    return raised.join(total, key).select(key, "class", (F.col("e") / F.col("total")).alias("probability"))


def slopes(rows: DataFrame, features: DataFrame, model: DataFrame, key: str, penalty: float, label: str = "label") -> DataFrame:
    """The slope of the mean penalised log-loss at every weight of the model, and the two sums that it comes from.

    ``rows``: key and label. Per class and term: expected (sum of probability times feature), observed (sum of the feature
    over the rows of the class), and slope = (expected - observed) / rows + penalty * weight; the intercepts are not penalised.
    At the minimum all slopes vanish, and no other weights have that.
    """
    n = rows.count()
    of_class = probabilities(margins(rows, features, model, key), key)
    judged = of_class.join(rows.select(key, F.col(label).alias("own")), key).select(
        key, "class", "probability", (F.col("class") == F.col("own")).cast("double").alias("is_own")
    )
    # the intercept is a feature of 1 in every row
    ones = rows.select(key, F.lit(INTERCEPT).alias("term"), F.lit(1.0).alias("weight"))
    spread = features.select(key, "term", "weight").union(ones).join(judged, key)

    def total(c: str) -> Column:
        return F.sum(F.col(c) * F.col("weight"))

    sums = spread.groupBy("class", "term").agg(total("probability").alias("expected"), total("is_own").alias("observed"))
    penalised = F.when(F.col("term") == INTERCEPT, 0.0).otherwise(F.lit(penalty) * F.col("weight"))
    return model.join(sums, ["class", "term"], "left").select(
        "class",
        "term",
        F.coalesce("expected", F.lit(0.0)).alias("expected"),
        F.coalesce("observed", F.lit(0.0)).alias("observed"),
        ((F.coalesce("expected", F.lit(0.0)) - F.coalesce("observed", F.lit(0.0))) / F.lit(n) + penalised).alias("slope"),
    )
