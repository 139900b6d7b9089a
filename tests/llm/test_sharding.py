import zlib
from collections import Counter

import numpy as np
from llm_cases import documents, odd, rows  # noqa: F401

from tapewire.llm.sharding import jump, shard_documents, write_shards


def _jump(key, n):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 500, dtype=np.int64)
    for n in (1, 2, 8, 9, 1000):
        assert jump(keys, n).tolist() == [_jump(int(k) & (2**64 - 1), n) for k in keys]


def _holds(docs):
    pairs = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    got = shard_documents(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == pairs
    slots, places = {}, {}
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
        assert places.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_documents(documents):
    got = _holds(documents)
    assert sum(r.grown_shard == 8 for r in got) < 50
    assert rows(shard_documents(documents)) == rows(shard_documents(documents.repartition(7)))


def test_odd_rows(odd, tmp_path):
    _holds(odd)
    assert shard_documents(odd.limit(0)).count() == 0
    write_shards(odd, str(tmp_path / "shards"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "shards")).count() == odd.count()
