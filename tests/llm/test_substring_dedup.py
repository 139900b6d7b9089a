import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from llm_cases import documents, odd, rows  # noqa: F401

from tapewire.llm import substring_dedup
from tapewire.llm.substring_dedup import remove_repeats


def _want(pairs, window):
    docs = [(i, re.findall("[^ \t-\r]+", t or "")) for i, t in pairs]
    least = -(2**70)
    low = {}
    for i, ws in docs:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            low[key] = min(low.get(key, 2**70), least if i is None else i)
    out = []
    for i, ws in docs:
        gone = set()
        for k in range(len(ws) - window + 1):
            if low[tuple(ws[k : k + window])] < (least if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def _same(docs, window=13):
    assert rows(remove_repeats(docs, window)) == _want([(r.doc_id, r.text) for r in docs.collect()], window)


def test_odd_rows(odd):
    _same(odd)
    assert remove_repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("window", [13, 6])
def test_documents(documents, window):
    _same(documents, window)


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_shifted_and_overlapping_passages(spark, batch):
    """Passages at every offset, of every length around the window, in few and in most documents."""
    rng = random.Random(5)
    passages = [[f"p{p}w{k}" for k in range(12 + p)] for p in range(6)]
    docs = []
    for i in range(150):
        ws = []
        for p in rng.sample(range(6), rng.randint(1, 4)):
            own = passages[p]
            a = rng.randint(0, 3)
            ws += [f"u{i}x{rng.random()}" for _ in range(rng.randint(0, 9))] + own[a : len(own) - rng.randint(0, 2)]
        docs.append((rng.choice([i, i % 40, None]), " ".join(ws)))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        _same(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    finally:
        spark.conf.set(name, before)


def test_buckets_by_size_of_text(documents, monkeypatch):
    """Many more buckets than shuffle partitions, most of them empty for a chunk, change nothing."""
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1 << 14)
    _same(documents)


def test_packed_numbers():
    for numbers in ([], [7], [3, 3], [-(1 << 63), (1 << 63) - 1], [10**15, 10**15 + 255], [0, 70000], [-5, 250]):
        packed = substring_dedup._narrow(np.array(numbers, np.int64))
        back, end = substring_dedup._widen(b"xy" + packed, len(numbers), 2)
        assert back.tolist() == numbers and end == len(packed) + 2
    assert len(substring_dedup._narrow(np.arange(10**15, 10**15 + 200))) == 9 + 200


def test_shuffles_of_stored_steps_are_removed(spark, documents):
    """Of the two steps only the stored tables are left, so that their shuffles don't add up on disk."""
    folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    held = lambda: {p for p in folder.rglob("shuffle_*") if p.suffix in (".data", ".index")}
    before = held()
    result = remove_repeats(documents)
    deadline = time.time() + 10
    while held() - before and time.time() < deadline:
        time.sleep(0.1)
    # what is left is the shuffle of the first sum, a few bytes of each part
    assert sum(p.stat().st_size for p in held() - before) < 10_000
    assert result.count() == documents.count()
