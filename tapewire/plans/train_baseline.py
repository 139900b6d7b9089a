"""TF-IDF and logistic regression on a training set, scored on a hold-out."""

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.operators.report import classification_report, format_report
from tapewire.operators.split import stratified_split, time_split
from tapewire.operators.terms import MAX_FEATURES, MIN_DF, NGRAM_RANGE, fit_tfidf
from tapewire.session import Stored, remove, shared_dir, store
from tapewire.sources.tables import read_training_set

MAX_ITERATIONS = 1000
TOLERANCE = 1e-4
#: Rows of a part that the fit goes over in one task.
ROWS_PER_PART = 20_000


@dataclass(frozen=True)
class Baseline:
    model: PipelineModel
    predictions: DataFrame  # of the test rows: label, prediction and the key
    report: DataFrame
    stored: tuple[Stored, ...] = ()

    def drop(self) -> None:
        """Remove the stored predictions, which ``predictions`` and ``report`` read."""
        for rows in self.stored:
            rows.drop()

    def text(self, digits: int = 3) -> str:
        return format_report(self.report.collect(), digits)


def fit_classifier(
    train: DataFrame,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    min_df: int = MIN_DF,
    max_features: int = MAX_FEATURES,
    max_iter: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    inverse_penalty: float = 1.0,
) -> PipelineModel:
    """Fitted pipeline from ``text`` to ``prediction`` (a label).

    The penalty is given as for a summed loss; Spark averages the loss, hence the
    division by the number of rows. Features are not standardised.
    """
    weights = fit_tfidf(train, "text", "features", ngram_range, min_df, max_features)
    labels = StringIndexer(
        inputCol="label", outputCol="_class", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(train)
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="_class",
        predictionCol="_predicted",
        maxIter=max_iter,
        tol=tolerance,
        regParam=1.0 / (inverse_penalty * weights.documents),
        elasticNetParam=0.0,
        standardization=False,
    )
    ready = labels.transform(weights.transform(train)).select("features", "_class")
    # each step of the fit is a job over all parts, and small ones cost more to start than to run
    ready = ready.coalesce(math.ceil(weights.documents / ROWS_PER_PART))
    fitted = without_summary(regression.fit(ready))
    names = IndexToString(
        inputCol="_predicted", outputCol="prediction", labels=labels.labels
    )
    return PipelineModel([*weights.stages, fitted, names])


def without_summary(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model as a saved and reloaded copy.

    A freshly fitted model carries its training summary, and with it the session,
    into every task that predicts.
    """
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    loaded = LogisticRegressionModel.load(path)
    remove(spark, path)
    return loaded


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with the predicted label in ``prediction``."""
    return model.transform(rows).select(*rows.columns, "prediction")


def usable_rows(data: DataFrame) -> DataFrame:
    return data.where("text is not null and label is not null").withColumns(
        {"text": F.col("text").cast("string"), "label": F.col("label").cast("string")}
    )


def train_baseline(
    data: DataFrame,
    key: Sequence[str] = ("url",),
    test_fraction: float = 0.2,
    seed: int = 42,
    by_time: str | None = None,
    gap: int = 0,
    **settings,
) -> Baseline:
    """Split, fit, predict and report. ``settings`` are those of fit_classifier.

    The split is stratified by label; with ``by_time``, the column of a time, the test rows are the last in time,
    ``gap`` rows after the train rows.
    """
    # Written once: the split, the vocabulary, the fit and the prediction each read them.
    kept = store(usable_rows(data))
    rows = kept.rows
    if by_time is None:
        train, test = stratified_split(rows, "label", key, test_fraction, seed)
    else:
        train, test = time_split(rows, by_time, key, test_fraction, gap, seed)
    model = fit_classifier(train, **settings)
    # Written out: the report reads them too, and a filter on the prediction
    # would otherwise be pushed through the model and evaluate it again.
    scored = store(predict(model, test).drop("text"))
    kept.drop()
    return Baseline(model, scored.rows, classification_report(scored.rows), (scored,))


def train_from_path(spark: SparkSession, path: str, **settings) -> Baseline:
    return train_baseline(read_training_set(spark, path), **settings)
