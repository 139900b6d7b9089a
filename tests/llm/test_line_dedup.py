import re

import pytest
from llm_cases import documents, odd, rows  # noqa: F401

from tapewire.llm import line_dedup
from tapewire.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def _want(pairs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))

    least = -(2**70)
    holders = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(least if i is None else i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != (least if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def _got(docs):
    return rows(dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept"))


def test_odd_rows(odd):
    assert _got(odd) == _want([(r.doc_id, r.text) for r in odd.collect()])
    assert dedup_lines(odd.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_lines_across_ranges(spark, parts):
    """A line that most documents share, so that it fills whole ranges, among others in two to four documents."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.range(600).selectExpr(
            "CASE WHEN id = 599 THEN NULL ELSE id % 590 END AS doc_id",
            "concat('a line that most documents share\\nline of a few documents ', id % 180, '\\nA line that most DOCUMENTS share ',"
            " CASE WHEN id % 4 = 0 THEN '\\n' ELSE concat('\\nown ', id, ' and nothing else but this') END) AS text",
        )
        pairs = [(r.doc_id, r.text) for r in docs.collect()]
        assert _got(docs.repartition(5)) == _want(pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_batches(spark, documents):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = documents.limit(120)
        assert _got(docs) == _want([(r.doc_id, r.text) for r in docs.collect()])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert line_dedup.MIN_DOCS == 3
