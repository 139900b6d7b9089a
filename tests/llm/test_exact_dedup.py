import re

from llm_cases import documents, odd, rows  # noqa: F401

from tapewire.llm import exact_dedup
from tapewire.llm.exact_dedup import deduplicate, duplicate_groups


def _want(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub("[ \t-\r]+", "", t or ""), []).append((i, t or ""))
    out = []
    for members in groups.values():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        first = True
        for m in members:
            kept = first and m[0] == keep[0] and len(m[1]) == len(keep[1])
            first = first and not kept
            out.append((m[0], keep[0], len(members), kept))
    return sorted(out, key=str)


def test_odd_rows(odd):
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in duplicate_groups(odd).collect()), key=str)
    assert got == _want(pairs)
    assert duplicate_groups(odd.limit(0)).count() == 0
    kept = deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(w[3] for w in _want(pairs))


def test_group_over_many_tasks(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('same ', repeat(' ', cast(id % 7 AS int))) ELSE concat('t', id) END AS text")
    got = duplicate_groups(docs.repartition(37)).where("group_size > 1").collect()
    assert len(got) == 1667 and {r.keep_id for r in got} == {6} and sum(r.kept for r in got) == 1


def test_two_contents_under_one_digest_stop_the_job(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.substring(c, 1, 1), n))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac")], "doc_id long, text string")
    try:
        rows(duplicate_groups(docs))
    except Exception as e:
        assert "two contents" in str(e)
    else:
        raise AssertionError
