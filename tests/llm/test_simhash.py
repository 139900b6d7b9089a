import random

import numpy as np
import pytest
import xxhash

from tapewire.llm import simhash


def _fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, most=4):
    """Brute force: all pairs, then search."""
    found, fps = {}, list(prints)
    values = np.array([prints[d] for d in fps], np.uint64)
    root = {}
    for d in sorted(fps):
        if d in root:
            continue
        queue = [d]
        root[d] = d
        while queue:
            here = queue.pop()
            for i in np.flatnonzero(np.bitwise_count(values ^ np.uint64(prints[here])) <= most):
                if fps[i] not in root:
                    root[fps[i]] = d
                    queue.append(fps[i])
    found.update(root)
    return found


def test_groups_of_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    want = _groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e f"), (5, "a b c d e f"), (6, "one"), (6, "one"), (7, "x " * 70000)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, fp string, key int, __stays int")
    got = sorted(((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    by_id = {r[1]: r for r in got}
    assert len(got) == len(rows)
    assert {by_id[i][3] for i in (1, 2, 3)} == {1} and by_id[1][2] == "0" * 16
    assert by_id[None][3] == 5 and by_id[5][3] == 5
    assert sum(r[1] == 6 for r in got) == 2
    assert simhash.near_groups(docs.limit(0)).count() == 0
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 6, 7]


@pytest.mark.parametrize("dense", [4096, 60, 5])
def test_links_with_crowded_segments(spark, dense):
    """Many fingerprints within few bits of each other, so that runs are long and are cut again."""
    rng = random.Random(3)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    order = sorted(fps)
    want = _groups({i: x for i, x in enumerate(order)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in order], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df, dense=dense).collect()]
    back = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(order)}
    root = list(range(len(order)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert (order[back[a]] ^ order[back[b]]).bit_count() <= 4
        x, y = sorted((find(back[a]), find(back[b])))
        root[y] = x
    assert [find(i) for i in range(len(order))] == [want[i] for i in range(len(order))]
