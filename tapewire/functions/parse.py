"""Lenient parsing: bad input becomes NULL, whatever the ANSI setting."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# With these characters alone, Spark's own parser takes exactly the decimal
# numbers; the many words for a missing value fall through.
_NUMBER = r"^(?:[\s0-9.,+\-eE]+|\s*[+-]?(?i:inf|infinity)\s*)$"
# A year has four digits: what follows is its end or a hyphen, or month and day without one.
_STARTS_WITH_YEAR = r"^\s*\d{4}(?:\s*$|-)"
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2}):?(\d{2})(?::?(\d{2})(\.\d+)?)?\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"

# Free-format dates, tried in this order after the ISO forms, each with or without a time.
_TIMES = "[ h:mm:ss a][ h:mm a][ HH:mm:ss]"
_DATE_FORMATS = (
    f"yyyy/M/d{_TIMES}",
    f"M/d/yyyy{_TIMES}",
    f"MMM d yyyy{_TIMES}",
    f"MMMM d yyyy{_TIMES}",
    f"d MMM yyyy{_TIMES}[ z][ Z]",
    f"d MMMM yyyy{_TIMES}",
)


def strip(c: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def missing_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Double from a number or from text such as ``" 1,234.5"``; else NULL.

    Text is checked before the cast, because Spark also takes Java suffixes
    ("1d") for numbers. Commas are dropped, infinity is kept, NaN is NULL, and so
    are ``None``, ``none``, ``null`` and the empty text.
    """
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(_NUMBER), F.replace(c, F.lit(","), F.lit("")).try_cast("double"))
    if isinstance(dtype, T.NumericType):
        return missing_if_nan(c.cast("double"))
    if isinstance(dtype, T.NullType):
        return c.cast("double")
    # dates, booleans and nested values are no numbers
    return F.lit(None).cast("double")


def to_utc(c: Column, dtype: T.DataType) -> Column:
    """Timestamp in UTC from a date, timestamp, epoch nanoseconds or ISO text.

    Every text value is read for itself, so the outcome does not depend on the
    order of rows. Text without an offset counts as UTC; text that does not
    start with a year (a bare time would mean "today") is NULL.
    """
    if isinstance(dtype, T.StringType):
        return iso_instant(c)
    if isinstance(dtype, T.LongType):
        return _from_nanos(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType, T.NullType)):
        return c.cast("timestamp")
    return F.lit(None).cast("timestamp")


def iso_instant(c: Column) -> Column:
    """Timestamp from ISO text with hyphens, or in the compact form (``20240105T120000Z``)."""
    spelled = F.regexp_replace(c, _COMPACT, "$1-$2-$3 $4:$5:$6$7$8")
    # parts that are not there leave their colons behind
    spelled = F.regexp_replace(F.regexp_replace(spelled, r" ::$", ""), r":(Z|[+-]\d{2}(?::?\d{2})?)?$", ":00$1")
    spelled = F.regexp_replace(spelled, r"([+-]\d{2})(\d{2})$", "$1:$2")
    compact = F.when(c.rlike(_COMPACT), F.try_to_timestamp(spelled))
    return F.coalesce(F.when(c.rlike(_STARTS_WITH_YEAR), F.try_to_timestamp(c)), compact)


def _from_nanos(c: Column) -> Column:
    return F.timestamp_micros(F.floor(c.cast("decimal(20,0)") / F.lit(1000)).cast("long"))


def parse_instant(c: Column) -> Column:
    """UTC timestamp from free-format text: ISO first, then common date styles."""
    text = strip(c)
    # a leading weekday carries no information, commas only punctuate
    plain = F.regexp_replace(
        F.replace(text, F.lit(","), F.lit("")), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?\s+", ""
    )
    # "3:05PM" and "3:05 pm" alike
    plain = F.regexp_replace(plain, r"(?i)(\d)\s*([ap])\.?m\.?$", "$1 $2M")
    plain = F.when(plain.rlike(r"(?i) [ap]m$"), F.upper(plain)).otherwise(plain)
    return F.coalesce(iso_instant(text), *[F.try_to_timestamp(plain, F.lit(f)) for f in _DATE_FORMATS])


def iso_utc(ts: Column) -> Column:
    """``2024-01-01T12:00:00+00:00``; microseconds only where they are not zero."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(seconds, F.coalesce(fraction, F.lit("")), F.lit("+00:00"))


def iso_or_null(c: Column) -> Column:
    """Free-format time text to UTC ISO 8601 text, NULL where it cannot be read."""
    return iso_utc(parse_instant(c))
