import base64
import hashlib
import random
import re

import pyarrow as pa
from llm_cases import documents, odd  # noqa: F401

from tapewire.llm import secrets

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def _base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def _holds(docs):
    got = secrets.secret_digests(docs).collect()
    want = sorted(((r.doc_id, _base(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    digests = [(i, *[sum(x[0] == k for x in b) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()) for i, b in want]
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == sorted(digests, key=str)
    for r in got:
        listed = [x for x in r.spans.split(",") if x and not x.startswith("novel:")]
        assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256
    return got


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sum(r.n_assign for r in _holds(docs)) > 0


def test_odd_rows(odd):
    _holds(odd)
    assert secrets.find_secrets(odd.limit(0)).count() == 0


def test_formats_at_their_edges(spark):
    akia, deep = "AKIA" + "Z9" * 7, "0123456789abcdef"
    texts = [
        "token=abcdefghijkl", "token=abcdefghijk", "Token : 'ABCDEFGHIJKL'", "api_key=\"abc.def/ghi=jkl\"", "APIKEY:   a-b_c+d/e.f=g", "tokentoken=abcdefghijklmno",
        "token=secret:abcdefghijklmnop", "token=password=abcdefghijklmnop", "token=short token=abcdefghijklmnop", "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop", "toKen=abcdefghijklmnop",
        akia, akia[:-1], "AKIA" + akia, "AKIAAKIA" + "A" * 9, "é🙂 " + akia + " ü " + deep, deep[:-1], deep + "G" + deep, "ABCDEF" + deep.upper(), f"secret = {deep}", f"🙂🙂token='{deep}'🙂{deep}",
        "passwd='" + "x" * 300000 + "'", ("token = " + deep + "\n") * 3, "token=\nabcdefghijklmnop", "password\t=abcdefghijklmnop", deep, "a" * 16,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    _holds(docs)


def test_spans_do_not_cross_texts():
    """Texts that lie side by side in memory."""
    pieces = ["token", "=abcdefghijklmnop", "AKIAABCDEFG", "HIJKLMNOPQ", "01234567", "89abcdef", "secret", "", "xY7" * 9]
    texts = secrets._Texts(pa.RecordBatch.from_pydict({"text": pieces}))
    assert texts.base() == {} and texts.candidates({}) == {}


def _random(rng, n):
    return base64.b64encode(rng.randbytes(n)).decode().strip("=").replace("/", "_")


def test_novelty_tells_secrets_from_identifiers(spark):
    """Strings that no format describes, after a sensitive word, beside identifiers of words with numbers."""
    rng = random.Random(3)
    words = "account cache client connection customer default employee handler invoice manager network order parser product queue region session storage worker zone".split()
    secret = {i: f"if bearer({i}):\n    send(header, `{_random(rng, 24)}`)\n" for i in range(300)}
    named = {i: f"credential for {'_'.join(rng.choices(words, k=4))}_{rng.randrange(100)} in use\n" for i in range(300, 900)}
    shape = {900: "bearer " + "x1" * 30, 901: "the token of the long-established-company was lost", 902: "nothing here " + _random(rng, 24), 903: "bearer " + _random(rng, 9)}
    docs = spark.createDataFrame(list((secret | named | shape).items()), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    novel = {i for i, spans in found.items() if any(s.kind == "novel" for s in spans)}
    assert len(novel & set(secret)) >= 0.98 * len(secret)
    assert len(novel & set(named)) <= 0.02 * len(named)
    assert not novel & set(shape)
    for i in novel & set(secret):
        start, end = next((s.start, s.end) for s in found[i] if s.kind == "novel")
        assert secret[i][start - 1] == "`" == secret[i][end]


def test_copies_do_not_make_a_secret_known(spark):
    rng = random.Random(4)
    own = _random(rng, 30)
    docs = spark.createDataFrame([(i, f"copy {i}: bearer {own} and again bearer {own}") for i in range(200)], "doc_id long, text string")
    assert all(sum(s.kind == "novel" for s in r.spans) == 2 for r in secrets.find_secrets(docs).collect())


def test_dictionary_counts_all_documents(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('token for wholeCorpusWord', id, 'abc1 ok') AS text").repartition(7)
    assert b" corpus Corpus CORPUS " in b" " + secrets.identifier_dictionary(docs) + b" "
    assert b"corpus" not in secrets.identifier_dictionary(docs.where("doc_id < 5"))


def test_texts_are_searched_each_for_itself(documents):
    batch = pa.RecordBatch.from_pandas(documents.select("text").limit(60).toPandas(), preserve_index=False)
    whole = {i: len(spans) for i, spans in secrets._Texts(batch).base().items()}
    single = {i: len(found[0]) for i in range(batch.num_rows) if (found := secrets._Texts(batch.slice(i, 1)).base())}
    assert whole == single
