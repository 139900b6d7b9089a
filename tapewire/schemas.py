"""Column layouts shared by every job."""

from pyspark.sql import types as T

PRICE_VALUES = ("open", "high", "low", "close", "adj_close", "volume")

PRICES = T.StructType(
    [T.StructField("date", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_VALUES]
    + [T.StructField("ticker", T.StringType())]
)

NEWS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

# One article as the news service delivers it; field names are fixed values.
ARTICLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("webUrl", T.StringType()),
        T.StructField("sectionName", T.StringType()),
        T.StructField("webPublicationDate", T.StringType()),
        T.StructField(
            "fields",
            T.StructType(
                [
                    T.StructField("headline", T.StringType()),
                    T.StructField("trailText", T.StringType()),
                    T.StructField("bodyText", T.StringType()),
                ]
            ),
        ),
    ]
)

# One landed response page.
PAYLOAD = T.StructType(
    [
        T.StructField(
            "response",
            T.StructType([T.StructField("results", T.ArrayType(ARTICLE))]),
        )
    ]
)

TEXT_PARTS = ("title", "description", "body")
