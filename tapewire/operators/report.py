"""Ingest reports and the classification report."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


_AVERAGES = ("accuracy", "macro avg", "weighted avg")


def usable_count(prices: DataFrame) -> DataFrame:
    """Number of rows with an adjusted close."""
    return prices.agg(F.count("adj_close").alias("usable_rows"))


def ingest_report(prices: DataFrame) -> DataFrame:
    """Rows, usable rows and date range of each ticker."""
    return prices.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("adj_close").alias("usable_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def classification_report(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, and their averages.

    Rows: one per class seen on either side, then ``accuracy``, ``macro avg`` and
    ``weighted avg``. A ratio with denominator 0 counts as 0. The data are
    aggregated once, to the counts of each pair of classes.
    """
    pairs = (
        predictions.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(label).cast("string").alias("t"), F.col(prediction).cast("string").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # each pair counts for its true class and for its predicted class
    sides = pairs.select(
        "n",
        (F.col("t") == F.col("p")).alias("hit"),
        F.explode(
            F.array(
                F.struct(F.col("t").alias("name"), F.lit(True).alias("is_true")),
                F.struct(F.col("p").alias("name"), F.lit(False).alias("is_true")),
            )
        ).alias("side"),
    )
    zero = F.lit(0)
    counts = sides.groupBy(F.col("side.name").alias("name")).agg(
        F.sum(F.when(F.col("side.is_true"), F.col("n")).otherwise(zero)).alias("support"),
        F.sum(F.when(~F.col("side.is_true"), F.col("n")).otherwise(zero)).alias("predicted"),
        F.sum(F.when(F.col("side.is_true") & F.col("hit"), F.col("n")).otherwise(zero)).alias("hits"),
    )

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    precision, recall = ratio(hits, predicted), ratio(hits, support)
    # harmonic mean of the two, written over the counts
    f1 = ratio(2 * hits, support + predicted)

    # each class also goes into the three averages, so that one pass gives all rows
    targets = F.array(
        F.struct(F.lit("class").alias("kind"), F.col("name").alias("to")),
        *[F.struct(F.lit(a).alias("kind"), F.lit(a).alias("to")) for a in _AVERAGES],
    )
    sums = (
        counts.select("support", "hits", precision.alias("p"), recall.alias("r"), f1.alias("f"), F.inline(targets))
        .groupBy("kind", F.col("to").alias("name"))
        .agg(
            F.sum("support").alias("support"),
            F.sum("hits").alias("hits"),
            *[F.avg(c).alias(c) for c in "prf"],
            *[F.sum(F.col(c) * support).alias(f"weighted_{c}") for c in "prf"],
        )
    )

    def value(c):
        return (
            F.when(F.col("kind") == "accuracy", hits / support)
            .when(F.col("kind") == "weighted avg", F.col(f"weighted_{c}") / support)
            .otherwise(F.col(c))
        )

    return sums.select(
        "name",
        value("p").alias("precision"),
        value("r").alias("recall"),
        value("f").alias("f1_score"),
        "support",
    )


def format_report(rows: Iterable[Row], digits: int = 3) -> str:
    """The report as aligned text, classes in name order before the averages."""
    rows = list(rows)
    by_name = {r["name"]: r for r in rows}
    order = sorted(n for n in by_name if n not in _AVERAGES) + [a for a in _AVERAGES if a in by_name]
    width = max(map(len, order), default=0)
    head = f"{'':>{width}}  " + " ".join(f"{h:>9}" for h in ("precision", "recall", "f1-score", "support"))
    lines = [head, ""]
    for name in order:
        r = by_name[name]
        if name == _AVERAGES[0]:
            lines.append("")
            cells = [" " * 9, " " * 9, f"{r['f1_score']:>9.{digits}f}"]
        else:
            cells = [f"{r[c]:>9.{digits}f}" for c in ("precision", "recall", "f1_score")]
        lines.append(f"{name:>{width}}  " + " ".join([*cells, f"{r['support']:>9}"]))
    return "\n".join(lines) + "\n"
