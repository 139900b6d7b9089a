import pyarrow as pa
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tapewire.llm.utf8 import raw, slices, words


def _texts():
    return st.lists(st.one_of(st.none(), st.text("ab \n\t\x0b\x1c\xa0é", max_size=30)), max_size=8)


@given(_texts(), st.integers(0, 3))
def test_words_are_those_of_split(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    w = words(*raw(column))
    found = [[] for _ in range(len(column))]
    for a, b, d in zip(w.start, w.end, w.doc, strict=True):
        found[d].append(w.data[a:b].tobytes())
    assert found == [(t or "").encode().split() for t in column.to_pylist()]
    assert w.count().tolist() == [len(f) for f in found]


@given(_texts())
def test_equal_words_and_windows_hash_alike_and_others_do_not(texts):
    w = words(*raw(pa.array(texts, pa.string())))
    h = w.hashes()
    spelled = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    assert len(set(h.tolist())) == len(set(spelled))
    at = w.windows(2)
    assert at.tolist() == [i for i in range(len(spelled) - 1) if w.doc[i] == w.doc[i + 1]]
    pairs = {(spelled[i], spelled[i + 1]) for i in at}
    for seed in (0, 1):
        assert len(set(w.window_hashes(2, at, h, seed).tolist())) == len(pairs)


def test_long_words():
    w = words(*raw(pa.array(["x" * 5000 + " y", "x" * 5000])))
    assert w.hashes()[0] == w.hashes()[2] == xxhash.xxh3_64_intdigest(b"x" * 5000)


@given(_texts(), st.integers(1, 40))
def test_slices_keep_all_rows(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    parts = list(slices(iter([batch]), "text", limit))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(texts)))
    for p in parts:
        size = sum(len((t or "").encode()) for t in p.column("text").to_pylist())
        assert size <= limit or p.num_rows == 1
