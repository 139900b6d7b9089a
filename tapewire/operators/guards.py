"""Refusals as rows: what became of inputs that lack something."""

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: What the library raises for inputs it cannot use; anything else is a fault and goes on.
REFUSALS = (ValueError, RuntimeError)


def guarded(spark: SparkSession, cases: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """A row for each case: input, outcome ("used" or "refused"), rows and message.

    A case makes a frame; it is refused where making it or counting its rows raises one of ``REFUSALS``. Each is a job or
    more of its own, so cases are few: one for each kind of input, not one for each row.
    """
    found = []
    for name, make in cases.items():
        try:
            found.append((name, "used", make().count(), None))
        except REFUSALS as e:
            found.append((name, "refused", None, str(e)))
    return spark.createDataFrame(found, "input string, outcome string, rows long, message string")
