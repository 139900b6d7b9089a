import pytest

SF_DIR = "/root/testdata/sf0.001"

#: Nulls, empty texts, ties, repeats, and columns whose names the operators use for their own.
ODD = [
    (1, None), (2, ""), (3, " \t\x0b\r\n"), (None, "Alpha beta gamma delta"), (5, "alpha  beta gamma delta"), (6, "alpha beta gamma\ndelta"),
    (7, "alpha beta gamma\ndelta"), (7, "alpha beta gamma\ndelta"), (8, "x " * 60000), (9, "é" * 20 + "\nshort\n" + "É" * 20), (10, "\n\n"),
    (11, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (12, "zero one two three four five six seven eight nine ten eleven twelve thirteen more"),
    (13, "  The same long line of text here \nother"), (14, "the SAME long line of text here\t\nother"), (15, "The same long line of text here"),
    (None, "The same long line of text here"), (-9, "12 34 $$"),
]

CLASHING = ["'x' AS kept", "1 AS rank", "2 AS digest", "3 AS bucket", "4 AS fold", "5 AS key", "6 AS row", "7 AS stats", "8 AS shard", "9 AS hits", "10 AS label", "11 AS __stays", "12 AS stays", "13 AS __gone", "14 AS gone", "15 AS __id", "16 AS __sha", "17 AS __shard", "18 AS own_id"]


@pytest.fixture
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.repartition(3).selectExpr("doc_id", "text", "cast(NULL AS string) AS lang", *CLASHING)


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
