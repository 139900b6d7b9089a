"""The pipeline against a plain version of each stage, over the smallest test tables."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _words(text):
    return [w for w in re.split(f"[{SPACE}]+", text) if w]


def _line_dedup(docs):
    holders = {}
    for i, text in docs.items():
        for line in text.split("\n"):
            key = _lower(line.strip(SPACE))
            if len(key) >= 20:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        keys = [_lower(line.strip(SPACE)) for line in lines]
        out[i] = "\n".join(ln for ln, k in zip(lines, keys, strict=True) if len(holders.get(k, ())) < 3 or max(holders[k]) == i)
    return out


def _near(docs):
    fps = {}
    for i, text in docs.items():
        words = _words(_lower(text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        fps[i] = sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(h))
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    seen, keep = set(), []
    for i in ids:
        if i in seen:
            continue
        keep.append(i)
        queue = [i]
        seen.add(i)
        while queue:
            here = queue.pop()
            for k in np.flatnonzero(np.bitwise_count(values ^ np.uint64(fps[here])) <= 4):
                if ids[k] not in seen:
                    seen.add(ids[k])
                    queue.append(ids[k])
    return {i: docs[i] for i in keep}


def _shingles(text):
    words = _words(_lower(text))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _decontaminated(docs, items):
    sets = [s for s in map(_shingles, items) if s]
    return {i: t for i, t in docs.items() if not any(5 * len(s & own) >= 4 * len(s) for own in [_shingles(t)] for s in sets)}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(-5, "12 + 34 !"), (-4, ""), (-3, None), (900001, "Only once, these words here."), (900002, "Only once, these words here.")]
    extra = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "cast(NULL AS string) AS lang", "'odd' AS source", "0L AS n_chars")
    (tmp_path / "in").mkdir()
    docs.unionByName(extra).write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(str(tmp_path / "in/benchmark.parquet"))

    want = {r.doc_id: r.text or "" for r in docs.collect()} | {i: t or "" for i, t in odd}
    want = {i: t for i, t in want.items() if any(c.isalpha() for c in t)}
    want = _near(_line_dedup(want))
    before = len(want)
    want = _decontaminated(want, [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    assert 0 < len(want) < before
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in want.items()}

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path / "in")).collect()}
    assert sorted(got) == sorted(want)
    for i, row in got.items():
        assert row.ids == ids[i] and row.n_tokens == len(ids[i])
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids[i], skip_special_tokens=False).encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name
