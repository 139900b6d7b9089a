import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapewire.llm import bpe
from tapewire.llm.bpe import SHORT, Coder, Vocabulary, decode_documents, encode_documents, token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
CODER = Coder(Vocabulary(PATH))

ODD = [
    "<|startoftext|> Hello <|endoftext|><|endoftext|> it's WE'LL",
    "ΣΑΣ İstanbul ǅ é Å ẞ ﬁ",
    "ab" * 1500,
    "!?" * 900,
    "x\xa0y z\x85w\x1cq\x00r",
    "123 ４５ Ⅻ ½ 日本語テキスト 🎉👩‍👩‍👧",
    " \t\n",
    "a\x1cb \x1d\x1e c\x1f<|endoftext|>\x1c <|endoftext|",
    "word " * 3 + "w" * 70 + " " + "w" * 70 + " ́a e ́ \u2000́x",
    "​﻿ a",
]


def _same(text, coder=CODER):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got, decoded = coder.code(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert decoded == coder.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    _same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=80))
def test_any_text(text):
    _same(text)


@given(st.text("abcdeinorst", min_size=SHORT + 1, max_size=3 * SHORT))
def test_long_words(word):
    _same(word)


def test_what_is_remembered_does_not_matter(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 2)
    coder = Coder(Vocabulary(PATH))
    for text in [*ODD, "one two three four five, six. one two three! " * 5, *ODD]:
        _same(text, coder)
    assert len(coder.known.new) <= 3 and len(coder.known.old) <= 3


def test_what_a_worker_remembers_fits_in_64_mb():
    coder = Coder(Vocabulary(PATH))
    letters = np.random.default_rng(5).integers(97, 123, (20_000, 9)).astype(np.uint8)
    words = [w.tobytes().decode() for w in letters]
    tracemalloc.start()
    try:
        for first in range(0, len(words), 1000):
            coder.code(", ".join(words[first : first + 1000]))
        # Of each word the run that holds it and the word itself are remembered.
        held = tracemalloc.get_traced_memory()[0] / len(words)
    finally:
        tracemalloc.stop()
    assert len(coder.words.new) > len(words) * 0.9
    assert held / 2 * 2 * (bpe.REMEMBERED + bpe.REMEMBERED_WORDS) < 64e6


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, ODD[0]), (5, "again"), (5, "again")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True).selectExpr("*", "'x' AS ids", "0 AS n_tokens")
    want = sorted(
        (
            (r.doc_id is None, r.doc_id, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(LIBRARY.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
            for r, e in ((r, LIBRARY.encode(r.text or "", add_special_tokens=False)) for r in docs.collect())
        ),
        key=str,
    )
    got = sorted(((r.doc_id is None, *r) for r in token_digests(docs, PATH).collect()), key=str)
    assert got == want
    decoded = decode_documents(encode_documents(docs, PATH), PATH).collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in decoded) == sorted(w[-1] for w in want)
    assert token_digests(docs.limit(0), PATH).count() == 0
