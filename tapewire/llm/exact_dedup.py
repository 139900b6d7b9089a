"""Exact duplicates of whole texts, safe against groups of any size."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.session import store

#: What is deleted before texts are compared: ``[\x20\x09-\x0D]``.
WHITE_SPACE = "[ \\t-\\r]+"
SALTS = 16


def normal_text(text: Column) -> Column:
    """The text as it is compared: null is empty, white space is deleted."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """For every row the row of its group that stays: the longest original text, then the smallest id.

    Copies are combined three times, each time by digest *and* content: within a task
    (the map side of the first aggregation), among the tasks that share a salt, and
    across salts. A group with a third of all rows so reaches the shuffle as one row
    per task, and the last step as one row per salt. Rows then learn their group's
    outcome by the digest alone, without their text; a digest under which two
    different contents were found stops the job.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null texts count as empty.
    A null id loses every tie. Of rows with the same id and text exactly one is kept.
    Other columns are not read.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normal_text(text).alias("content"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("length"),
    ).withColumn("digest", F.sha2("content", 256))
    # One number orders rows by length and then by falling id, so that the aggregation stays hash-based.
    rank = F.expr(
        "cast(length as decimal(12,0)) * cast('100000000000000000000' as decimal(21,0))"
        " - coalesce(cast(doc_id as decimal(20,0)), cast('10000000000000000000' as decimal(20,0)))"
    ).cast("decimal(38,0)")
    local = rows.withColumns({"rank": rank, "salt": F.pmod(F.spark_partition_id(), F.lit(salts))})

    salted = local.groupBy("digest", "salt", "content").agg(
        F.max_by("doc_id", "rank").alias("doc_id"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n")
    )
    merged = salted.groupBy("digest", "content").agg(
        F.max_by("doc_id", "rank").alias("keep_id"), F.max("rank").alias("rank"), F.sum("n").alias("group_size")
    )
    outcome = merged.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("rank").alias("best"),
        F.max("group_size").alias("group_size"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two contents under one digest")).cast("long")).alias("clash"),
    )
    # Written, so that the join has a plain shuffle on both sides and Spark can split a group with very many rows.
    outcome = store(outcome).rows
    members = local.groupBy("digest", "doc_id", "rank").agg(F.count(F.lit(1)).alias("copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return (
        members.join(outcome, "digest")
        .select("doc_id", "keep_id", "group_size", "digest", "rank", "best", copy)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("rank") == F.col("best")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that share id and text the first of each is returned once.
    """
    stay = (
        duplicate_groups(docs, id_col, text_col)
        .where("kept")
        .select(F.col("doc_id").alias("stays"), F.col("text_sha256").alias("sha"))
    )
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("long").alias("own_id"),
        F.sha2(normal_text(F.col(text_col)), 256).alias("own_sha"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("length"),
    )
    found = rows.join(stay, F.col("own_id").eqNullSafe(F.col("stays")) & (F.col("own_sha") == F.col("sha")), "left_semi")
    first = Window.partitionBy("own_id", "own_sha").orderBy(F.col("length").desc())
    return found.withColumn("no", F.row_number().over(first)).where("no = 1").select("row.*")
