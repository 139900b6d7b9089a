import hashlib
import zlib

import pytest
from llm_cases import CLASHING, documents  # noqa: F401
from pyspark.sql import functions as F

from tapewire.llm import manifest


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(*values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(leaves):
    """Root, and for each leaf the list of (siblings before, siblings after)."""
    level, paths = [(d, [i]) for i, d in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        up = []
        for k in range(0, len(level), 16):
            run = level[k : k + 16]
            for p, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(([d for d, _ in run[:p]], [d for d, _ in run[p + 1 :]]))
            up.append((_h("".join(d for d, _ in run)), [i for _, below in run for i in below]))
        level = up
    return level[0][0], paths


def _want(docs):
    by_source = {}
    for r in docs:
        values = (r.doc_id, r.source, r.lang, r.n_chars, r.text)
        by_source.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, _leaf(*values), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        by_source[s].sort(key=lambda x: x[:3])
        subs[s] = _tree([x[2] for x in by_source[s]])
    root, tops = _tree([subs[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, _, leaf, r), path in zip(by_source[s], subs[s][1], strict=True):
            path = path + tops[k]
            node = leaf
            if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0:
                low = r.text and "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
                node = _leaf(r.doc_id, r.source, r.lang, r.n_chars, low)
            for before, after in path:
                node = _h("".join([*before, node, *after]))
            out.append((r.doc_id, leaf, subs[s][0], root, _h("".join("".join(b + a) for b, a in path)), node, node == root))
    return sorted(out, key=str)


def _got(docs, levels=manifest.LEVELS):
    return sorted((tuple(r) for r in manifest.verified_manifest(docs, levels=levels).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_odd_rows(spark, levels):
    """Sizes on both sides of a run and of a block, one source with most rows, null and empty names, ids that repeat."""
    rows = [("big", i) for i in range(700)]
    for n in (1, 2, 15, 16, 17, 33, 256, 257):
        rows += [(f"s{n}", 1000 * n + i) for i in range(n)]
    rows += [(None, 1), (None, 2), ("", 3), ("é", 4), ("z", 5), ("Z", 6), ("-", 7), ("big", None), ("big", None), ("big", 5), ("big", 5)]
    docs = spark.createDataFrame([(i, s, f"Text {(i or 0) % 7} <{s}>" if i is None or i % 11 else None, None if s == "z" else "en", i) for s, i in rows], "doc_id long, source string, text string, lang string, n_chars long")
    same = docs.where("source = 's1'").withColumn("source", F.lit("same"))
    for _ in range(6):
        same = same.union(same)
    docs = docs.union(same).selectExpr("*", *CLASHING, "19 AS pos", "20 AS block", "21 AS digest", "22 AS id", "23 AS given").repartition(5)
    want = _want(docs.collect())
    assert _got(docs, levels) == want
    assert 0 < sum(r[-1] for r in want) < len(want)
    assert _got(docs.limit(0), levels) == []


def test_many_sources(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('s', id % 300) AS source", "'x' AS lang", "1L AS n_chars", "concat('T', id) AS text")
    assert _got(docs, 1) == _want(docs.collect())


def test_documents_and_other_partitions(documents):
    got = _got(documents)
    assert got == _want(documents.collect())
    assert got == _got(documents.repartition(9), 1)


def test_one_source_is_spread(spark):
    """No task gets more than a block or a range of a source that holds everything."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "'x' AS lang", "1L AS n_chars", "cast(id AS string) AS text")
    found = manifest.witnesses(docs, manifest.leaf_digest(F.col("doc_id")), levels=1).withColumn("part", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(r["count"] for r in found.groupBy("part").count().collect()) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.where(manifest.folded(F.col("leaf"), F.col("witness")) == F.col("root")).count() == 3000


def test_open_tree_extends_witnesses_as_it_grows():
    tree, leaves = manifest.OpenTree(3), [_h(str(i)) for i in range(300)]
    for k, d in enumerate(leaves):
        tree.append(d)
        assert [len(s) for s in tree.steps[: k + 1]] == [((k + 1) // 16 > i // 16) + ((k + 1) // 256 > i // 256) for i in range(k + 1)]
    root = tree.finish(whole=True)
    assert root == _tree(leaves)[0]
    for d, steps in zip(leaves, tree.steps, strict=True):
        for place, siblings in steps:
            d = _h(siblings[: 64 * place] + d + siblings[64 * place :])
        assert d == root
