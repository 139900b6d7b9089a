import math
import random
import re

import pytest
from llm_cases import SF_DIR, documents, odd, rows  # noqa: F401

from tapewire.llm.contamination import decontaminate, find_items


def _shingles(text):
    ws = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def _want(docs, items):
    found = []
    for i, t in {(i, t or "") for i, t in docs}:
        own = _shingles(t)
        for j, u in {(j, u or "") for j, u in items}:
            s = _shingles(u)
            if s and len(s & own) >= math.ceil(round(0.8 * len(s), 9)):
                found.append((i, j, len(s & own), len(s)))
    return sorted(found, key=str)


def _same(docs, items, **k):
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in find_items(docs, items, **k).collect()), key=str)
    assert got == _want([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    return got


def test_documents(spark, documents):
    assert _same(documents, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "One Two three four five six"), (3, "one two three four five six"), (4, "alpha beta gamma delta"), (None, "x x x x x x x"), (5, "no such words here at all")],
        "item_id long, text string",
    )
    assert _same(odd, items)
    assert find_items(odd.limit(0), items).count() == 0
    assert find_items(odd, items.limit(0)).count() == 0
    kept = decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() < odd.count()


@pytest.mark.parametrize("bits", [1 << 16, 1 << 25])
def test_items_that_are_partly_there(spark, bits):
    """Items of many sizes with words changed, in long documents; the small filter lets much through."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([5, 6, 9, 20, 60, 200])))) for j in range(80)]
    docs = []
    for i in range(150):
        ws = rng.choices(words, k=rng.randint(0, 800))
        for _, t in rng.sample(items, 3):
            part = t.split()
            for _ in range(rng.randint(0, max(1, len(part) // 18))):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(ws))
            ws[at:at] = part
        docs.append((i, " ".join(ws)))
    found = _same(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), filter_bits=bits)
    assert 50 < len(found) < 450
    assert rows(spark.createDataFrame([(1,)], "a int")) == [(1,)]
