"""Text composition, phrase labels and keyword matching as column expressions."""

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.functions.parse import missing_if_nan, strip
from tapewire.schemas import TEXT_PARTS

# The default phrase lists.
CAUSAL = (
    "caused", "causes", "causing", "leads to", "led to", "due to", "as a result",
    "because", "results in", "drives", "triggered", "brought about", "produced",
    "gave rise to", "responsible for", "resulted in", "therefore", "consequently",
    "hence", "provoked", "sparked", "induced", "generated", "stimulated",
    "contributed to", "plays a role in", "a factor in", "influences", "underlies",
    "underpinned", "prompted", "shaped", "sets off", "fuels",
)
CORRELATIONAL = (
    "associated with", "linked to", "correlates with", "coincided with", "related to",
    "connected to", "in connection with", "tied to", "in conjunction with",
    "in parallel with", "goes along with", "matches with", "aligned with",
    "accompanies", "found alongside", "occurs with", "occurring with", "coupled with",
)


def compose_text(
    columns: Iterable[str], parts: Sequence[str] = TEXT_PARTS, types: Mapping[str, T.DataType] | None = None
) -> Column:
    """Join the text parts with one space, a missing part counting as empty.

    ``columns`` are the columns at hand; parts that are not among them are empty
    too, and so is NaN in a part that ``types`` says is a floating number. Empty
    parts keep their separator, outer whitespace goes.
    """
    have, empty = set(columns), F.lit("")

    def value(part: str) -> Column:
        if part not in have:
            return empty
        floating = isinstance((types or {}).get(part), (T.DoubleType, T.FloatType))
        c = missing_if_nan(F.col(part)) if floating else F.col(part)
        return F.coalesce(c.cast("string"), empty)

    values = [value(p) for p in parts]
    return strip(F.concat_ws(" ", *values))


def contains_any(c: Column, phrases: Sequence[str], word_boundary: bool = False) -> Column:
    """Whether any of the phrases occurs, as a substring or as whole words."""
    if not phrases:
        return F.lit(False)
    if word_boundary:
        return c.rlike(word_pattern(phrases))
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def word_pattern(phrases: Sequence[str]) -> str:
    return r"(?iU)(?<!\w)(?:" + "|".join(re.escape(p) for p in phrases) + r")(?!\w)"


def weak_label(
    lowered: Column,
    causal: Sequence[str] = CAUSAL,
    correlational: Sequence[str] = CORRELATIONAL,
    word_boundary: bool = False,
) -> Column:
    """``causal``, else ``correlational``, else NULL, for text already in lower case."""
    return F.when(contains_any(lowered, causal, word_boundary), "causal").when(
        contains_any(lowered, correlational, word_boundary), "correlational"
    )


def with_weak_label(
    df: DataFrame,
    text: str = "text",
    causal: Sequence[str] = CAUSAL,
    correlational: Sequence[str] = CORRELATIONAL,
    word_boundary: bool = False,
) -> DataFrame:
    """Add ``label`` and keep only the labelled rows.

    The label is generated as a list of no or one element and exploded. A plain
    filter on it would be pushed below the lower-casing, which then runs once
    per phrase, and the whole list of phrases would be searched once for the
    filter and again for the column.
    """
    label = weak_label(F.col("_lowered"), causal, correlational, word_boundary)
    return (
        df.withColumn("_lowered", F.lower(text))
        .withColumn("label", F.explode(F.array_compact(F.array(label))))
        .drop("_lowered")
    )


def keyword_match(c: Column, query: str) -> Column:
    """Any-of word match for a query ``"a OR b OR c"``, ignoring case."""
    terms = [t.strip() for t in query.split(" OR ") if t.strip()]
    return c.rlike(word_pattern(terms)) if terms else F.lit(True)


def path_key(ticker: Column) -> Column:
    """Ticker as a path-safe name: ``^VIX`` is ``IDX_VIX``, ``CL=F`` is ``CL_F``."""
    out = F.replace(ticker, F.lit("^"), F.lit("IDX_"))
    for sign in ("=", "/"):
        out = F.replace(out, F.lit(sign), F.lit("_"))
    return strip(out)
