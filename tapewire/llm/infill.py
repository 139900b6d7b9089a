"""Fill-in-the-middle: each text cut twice between tokens by one regular expression of its own, and put together again."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Of a hundred documents so many are rearranged, and of a hundred rearranged ones so many begin with their suffix.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ANY = "<[PSM]>"

#: A token: white space before a word belongs to it, and white space after the last word is one by itself. A word can't
#: begin with white space, so the possessive form matches what the greedy one does, and keeps no way back.
TOKEN = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"


def _draws(id_: Column, seed: int) -> Column:
    """Four integers from 0 to 2^32 - 1 that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _cut(text: Column, prefix: Column, middle: Column) -> Column:
    """Prefix, middle and suffix, the first two of so many tokens, captured in one match.

    A possessive group that is counted out runs in a loop, so that no text is too long for the stack.
    """
    pattern = F.concat(F.lit(rf"(?s)\A({TOKEN}{{"), prefix, F.lit(rf"}}+)({TOKEN}{{"), middle, F.lit(r"}+)(.*)\z"))
    return F.split(F.regexp_replace(text, pattern, F.lit(f"$1{MIDDLE}$2{MIDDLE}$3")), MIDDLE, -1)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """Every text as it is ("plain") or as prefix, suffix, middle ("psm") or suffix, prefix, middle ("spm").

    The id decides form and cuts. A text stays plain if it is empty or null, holds one of the markers, or by its draw;
    a text of one token is cut before or after it. Rows are independent of each other, so repeats come out
    alike; a null id draws as an empty one. Columns other than id and text are not read. All work is in built-in
    functions; counting holds the tokens of one text at a time.

    Returns doc_id, n (tokens), form, prefix, middle, suffix (null if plain) and output.
    """
    h = F.col("draws")
    n = F.col("n")
    drawn = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        _draws(F.col(id_col).cast("long"), seed).alias("draws"),
    )
    counted = drawn.withColumn("n", F.regexp_count("text", F.lit(TOKEN)).cast("long"))
    plain = (F.col("text") == "") | F.col("text").rlike(_ANY) | (h[2] % 100 >= rate)
    formed = counted.select(
        "doc_id",
        "text",
        "n",
        F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("first"),
        F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("second"),
    )
    part = F.when(F.col("form") != "plain", _cut(F.col("text"), F.col("first"), F.col("second") - F.col("first")))
    parted = formed.withColumn("part", part).select(
        "doc_id", "text", "n", "form", *[F.col("part")[i].alias(c) for i, c in enumerate(("prefix", "middle", "suffix"))]
    )
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    return parted.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from."""
    part = F.split(output, _ANY, -1)  # nothing before the first marker, then the three parts
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part[1], part[3], part[2]))
        .otherwise(F.concat(part[2], part[3], part[1]))
    )


def infill_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``fill_in_middle`` makes, and what is rebuilt from that, as sizes and digests."""
    return fill_in_middle(docs, id_col, text_col).select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
