import hashlib
import re

from llm_cases import documents, odd  # noqa: F401

from tapewire.llm import infill

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def _plain(i, text, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(u) for u in (units[:a], units[a:b], units[b:])]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < suffix_first:
        return len(units), "spm", *parts, f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", *parts, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def _holds(docs, **how):
    made = infill.fill_in_middle(docs, **how)
    made = made.withColumn("again", infill.restored(made.output, made.form))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.again) for r in made.collect()), key=str)
    want = sorted(((r.doc_id, *_plain(r.doc_id, r.text, **how), r.text or "") for r in docs.select("doc_id", "text").collect()), key=str)
    assert got == want
    return got


def test_documents(documents):
    assert {r[2] for r in _holds(documents)} == {"plain", "psm", "spm"}


def test_odd_rows(odd):
    _holds(odd, rate=100)
    assert infill.fill_in_middle(odd.limit(0)).count() == 0


def test_markers_spaces_and_signs_of_patterns(spark):
    texts = [
        "one", " one", "one ", " \t one two\r\n", "$1 \\2 (a|b)* [x] {3} ^ . ", "<P", "a <P> b", "x<S>", "<M>", "<<P >S> <M <", "< <", "a b   c", "𝔘𝔫𝔦 𝔠𝔬𝔡𝔢 🙂 é",
        "\u0085 x   y\n\nz\n", "a\x00b c", "\x1c\x1f d",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 12)], "doc_id long, text string")
    got = _holds(docs, rate=100)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert {r[6] for r in got if r[2] == "plain"} == {"a <P> b", "x<S>", "<M>"}


def test_long_texts(spark):
    """Of a million words, of one word, and of white space only."""
    docs = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, kind int").selectExpr(
        "doc_id", "CASE kind WHEN 0 THEN repeat('word of text \n', 350000) WHEN 1 THEN repeat('x', 5000000) ELSE repeat(' ', 5000000) END AS text"
    )
    found = infill.infill_digests(docs).join(docs.selectExpr("doc_id", "sha2(text, 256) AS own"), "doc_id").collect()
    assert {r.doc_id: r.n for r in found} == {1: 1050001, 2: 1, 3: 1}
    assert all(r.restored_sha256 == r.own for r in found)
    long = infill.fill_in_middle(docs, rate=100).selectExpr("doc_id", "form", "n").collect()
    assert all(r.form != "plain" for r in long)


def test_all_work_is_built_in(spark, documents):
    plan = infill.infill_digests(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
