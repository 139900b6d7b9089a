"""The corpus pipeline: training tokens from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's rows to the
shared folder and reads them back for the next.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm.bpe import token_digests
from tapewire.llm.contamination import decontaminate
from tapewire.llm.language import with_language
from tapewire.llm.line_dedup import dedup_lines
from tapewire.llm.simhash import one_per_group
from tapewire.session import store

TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, for which no language can be told, go; null and empty texts are such.

    Rows are judged one by one, so repeated and null ids are kept or rejected each for itself.
    """
    return with_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go; ``n_chars`` follows the text. A document may end up empty, and stays.

    A null text becomes empty. Of the holders of a line the largest id keeps it. Rows with the same id are one
    holder, and null ids are one below all others.
    """
    found = dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[new.get(c, F.col("row")[c]).cast(t).alias(c) for c, t in docs.dtypes])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, as ``op6`` finds them, the document with the smallest id stays.

    Linked are fingerprints of four-word shingles within 4 bits. Texts without words share fingerprint
    zero. Rows with the id that stays all stay; a null id stays only if its group has no other.
    """
    return one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of an item's five-word shingles go.

    Null and empty texts hold nothing and stay. Of rows with the same id all go if one does.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the ids and of the text they decode to, a row for a row."""
    return token_digests(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: Hyperdimensional profiles, XXH64 fingerprints and BPE merges can't be written in SQL; the tests compare
#: ``run`` with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        stored = store(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = stored.rows, stored
    return STAGES[-1][1](spark, docs, sf_dir)
