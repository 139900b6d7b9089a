
import pytest
from pyspark.sql import functions as F

from tapewire.functions.parse import WHITESPACE, iso_or_null, strip, to_number, to_utc


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = df.select("i", fn(F.col("v"), df.schema["v"].dataType).alias("x"))
    return [r.x for r in out.orderBy("i").collect()]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip(spark):
    values = ["  a b ", "\t\n\xa0x　\x1f", "", None]
    assert one(spark, values, lambda c, _: strip(c)) == ["a b", "x", "", None]


def test_numbers_from_text(spark):
    values = ["1,234", " 1.5 ", "1e3", "1d", "1f", "0x1p3", "None", "none", "null", "", "nan", "abc", "-.5", "5.", "1.2.3", "e", ",", None]
    want = [1234.0, 1.5, 1000.0] + [None] * 9 + [-0.5, 5.0, None, None, None, None]
    assert one(spark, values, to_number) == want


def test_infinity_is_kept(spark):
    assert one(spark, ["inf", "-Infinity"], to_number) == [float("inf"), float("-inf")]


def test_nan_becomes_null(spark):
    assert one(spark, [float("nan"), 2.0], to_number, "double") == [None, 2.0]


def test_timestamps_do_not_depend_on_row_order(spark):
    values = ["2024-01-05T10:00:00Z", "2024-01-05 20:00:00-05:00", "2024-01-05", "Jan 5 2024", "x", "12:30", None]
    got = one(spark, values, lambda c, t: to_utc(c, t).cast("string"))
    want = ["2024-01-05 10:00:00", "2024-01-06 01:00:00", "2024-01-05 00:00:00", None, None, None, None]
    assert got == want
    assert one(spark, values[::-1], lambda c, t: to_utc(c, t).cast("string")) == want[::-1]


def test_epoch_nanoseconds(spark):
    values = [1704067200123456789, -1, None]
    got = one(spark, values, lambda c, t: to_utc(c, t).cast("string"), "bigint")
    assert got == ["2024-01-01 00:00:00.123456", "1969-12-31 23:59:59.999999", None]


@pytest.mark.parametrize(
    "text, iso",
    [
        ("2024-01-01T12:00:00Z", "2024-01-01T12:00:00+00:00"),
        ("2024-01-01T12:00:00", "2024-01-01T12:00:00+00:00"),
        ("2024-01-01T12:00:00+02:00", "2024-01-01T10:00:00+00:00"),
        ("2024-01-01 12:00:00.25", "2024-01-01T12:00:00.250000+00:00"),
        ("Jan 5, 2024", "2024-01-05T00:00:00+00:00"),
        ("January 5 2024 08:30:00", "2024-01-05T08:30:00+00:00"),
        ("Fri, 05 Jan 2024 08:30:00 +0200", "2024-01-05T06:30:00+00:00"),
        ("Fri, 5 Jan 2024 08:30:00 GMT", "2024-01-05T08:30:00+00:00"),
        ("2024/01/05", "2024-01-05T00:00:00+00:00"),
        ("1/5/2024", "2024-01-05T00:00:00+00:00"),
        ("garbage", None),
        ("", None),
    ],
)
def test_iso(spark, text, iso):
    assert one(spark, [text], lambda c, _: iso_or_null(c)) == [iso]
