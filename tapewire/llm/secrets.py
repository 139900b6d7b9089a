"""Secrets in text: fixed formats, and strings in sensitive places that a primed compressor can't shorten."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.utf8 import raw, slices

# The base formats, in the order in which spans with the same start are listed, and the least length
# of a match (of its second group for "assign").
BASE = {
    "assign": (rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    "access": (rb"AKIA[A-Z0-9]+", 18),
    "hex": (rb"[0-9a-f]+", 16),
}
NOVEL = "novel"

#: Words, in lower case, after which a string is looked at.
SENSITIVE = (
    b"passw", b"passphrase", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"access_key", b"access-key",
    b"private_key", b"private-key", b"credential", b"bearer", b"authorization", b"signature",
)
#: Identifiers that any dictionary begins with.
COMMON = (
    "access account address application authorization bearer buffer callback client config connection content controller "
    "credential database default description document element environment example factory function handler header identifier "
    "index instance integer interface manager message method object option package parameter password private process property "
    "provider public registry request resource response return schema secret server service session signature source status "
    "string system template token update username value version"
)
#: Bytes after a sensitive word in which a candidate begins, and bytes on both sides that it is measured against.
REACH, AROUND = 64, 256
#: A candidate is a run of at least so many letters, digits and ``+/_=-`` with a letter and a digit.
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Share of a candidate's bytes that it must add to the compressed surroundings.
NOVELTY = 0.75
#: Different candidates that a part of an identifier must occur in to enter the dictionary, and the bytes it may fill.
LEAST, DICTIONARY_BYTES = 8, 64 << 10
_LEVEL = 9
_PART = re.compile(rb"[A-Z]?[a-z]{3,24}|[A-Z]{4,24}")
_LETTER, _DIGIT = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: The formats as they are searched for. A run that is too short can't hold a longer match, so these give the same spans
#: with the length inside; an assignment that is too short may hide another, so its length is looked at afterwards.
_ASSIGN, _ACCESS, _HEX = re.compile(BASE["assign"][0]), re.compile(rb"AKIA[A-Z0-9]{14,}"), re.compile(rb"[0-9a-f]{16,}")
_NAMES = (b"passw", b"secret", b"token", b"api")


def _all(low: bytes, word: bytes) -> Iterator[int]:
    at = low.find(word)
    while at >= 0:
        yield at
        at = low.find(word, at + 1)


class _Texts:
    """The bytes of several texts, searched all at once."""

    def __init__(self, batch: pa.RecordBatch):
        data, self.bounds = raw(batch.column("text"))
        self.array, self.data, self.low = data, data.tobytes(), _LOWER[data].tobytes()

    def doc(self, at: int) -> int:
        return int(np.searchsorted(self.bounds, at, "right")) - 1

    def base(self) -> dict[int, list[tuple[int, int, int, str]]]:
        """Spans of the fixed formats by text: start, place of the kind, end, kind."""
        found: dict[int, list] = {}
        ranges = list(zip(self.bounds.tolist(), self.bounds.tolist()[1:], strict=False))
        named = sorted({self.doc(at) for word in _NAMES for at in _all(self.low, word)})
        keyed = sorted({self.doc(at) for at in _all(self.data, b"AKIA")})
        for place, (kind, pattern, docs) in enumerate((("assign", _ASSIGN, named), ("access", _ACCESS, keyed), ("hex", _HEX, range(len(ranges))))):
            for i in docs:
                for m in pattern.finditer(self.data, *ranges[i]):
                    if kind != "assign" or m.end(2) - m.start(2) >= BASE[kind][1]:
                        found.setdefault(i, []).append((m.start(), place, m.end(), kind))
        return found

    def candidates(self, base: dict[int, list]) -> dict[int, list[tuple[int, int]]]:
        """Runs after a sensitive word, by text, that no base span touches."""
        found: dict[int, set] = {}
        for at, size in {(at, len(word)) for word in SENSITIVE for at in _all(self.low, word)}:
            i = self.doc(at)
            lo, hi = int(self.bounds[i]), int(self.bounds[i + 1])
            if at + size > hi:
                continue  # begins in one text and ends in the next
            for m in CANDIDATE.finditer(self.data, lo, hi) if hi - lo <= REACH else self._near(at + size, lo, hi):
                if m.start() >= at + size and m.start() < at + size + REACH and _LETTER.search(m[0]) and _DIGIT.search(m[0]):
                    found.setdefault(i, set()).add((m.start(), m.end()))
        out = {}
        for i, spans in found.items():
            taken = sorted((s, e) for s, _, e, _ in base.get(i, ()))
            own = [span for span in sorted(spans) if not _touches(span, taken)]
            if own:
                out[i] = own
        return out

    def _near(self, first: int, lo: int, hi: int) -> Iterator[re.Match]:
        at = max(lo, first)
        while (m := CANDIDATE.search(self.data, at, hi if at >= first + REACH else min(hi, first + REACH + 16))) and m.start() < first + REACH:
            # the run may go on beyond what was searched
            whole = CANDIDATE.match(self.data, m.start(), hi)
            yield whole
            at = whole.end()

    def code_points(self, i: int, spans: list[tuple[int, int]]) -> dict[int, int]:
        """Code points before each edge of the spans of a text, counted once from edge to edge."""
        out, at, n = {}, int(self.bounds[i]), 0
        for edge in sorted({e for span in spans for e in span}):
            n += int(np.count_nonzero((self.array[at:edge] & 0xC0) != 0x80))
            out[edge], at = n, edge
        return out


def _touches(span: tuple[int, int], taken: list[tuple[int, int]]) -> bool:
    return any(s < span[1] and span[0] < e for s, e in taken)


class _Meter:
    """What a string adds to its surroundings under a compressor that knows the identifiers."""

    def __init__(self, dictionary: bytes):
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=_LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)

    def novelty(self, data: bytes, start: int, end: int, lo: int, hi: int) -> float:
        """Compressed bytes for each byte of the string. Its own copies nearby don't count as surroundings."""
        own = data[start:end]
        before, after = data[max(lo, start - AROUND) : start].replace(own, b""), data[end : min(hi, end + AROUND)].replace(own, b"")
        added = len(self.zstd.compress(before + own + after)) - len(self.zstd.compress(before + after))
        return added / len(own)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = _Texts(batch)
        strings = {texts.data[s:e] for spans in texts.candidates(texts.base()).values() for s, e in spans}
        pairs = sorted({(c, p.lower()) for c in strings for p in _PART.findall(c)})
        yield pa.RecordBatch.from_pydict({"candidate": pa.array([c for c, _ in pairs], pa.binary()), "part": pa.array([p.decode() for _, p in pairs], pa.string())})


def identifier_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The parts of identifiers that stand in sensitive places all over the documents, the most frequent last.

    A part is a run of letters of one case, or one with a capital; it counts once for each different
    candidate, so that copies of a secret don't make it an identifier. At most ``DICTIONARY_BYTES`` reach the driver.
    """
    text = docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = text.mapInArrow(_parts, "candidate binary, part string").distinct()
    counted = seen.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    # a part has four letters in the least and is listed in three forms
    frequent = counted.orderBy(F.col("n").desc(), "part").limit(DICTIONARY_BYTES // 12).collect()
    forms = [f"{r.part} {r.part.title()} {r.part.upper()}" for r in frequent]
    common = COMMON.split()
    forms += [f"{w} {w.title()} {w.upper()}" for w in common]
    out: list[str] = []
    size = 0
    for form in [*forms[len(frequent) :], *forms[: len(frequent)]]:
        size += len(form) + 1
        if size > DICTIONARY_BYTES:
            break
        out.append(form)
    return " ".join(reversed(out)).encode()


_SPANS = "array<struct<kind: string, start: long, end: long, novelty: double>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """The spans of every whole text that look like secrets.

    Base spans have one of the formats of ``BASE``, leftmost and non-overlapping within each. Beside them
    every string in a sensitive place (``CANDIDATE``, within ``REACH`` bytes after a word of ``SENSITIVE``, apart from all
    base spans) is compressed with and without itself between the text on both sides, by zstandard
    primed with ``identifier_dictionary``; one that adds at least ``novelty`` of its bytes is reported as "novel". Base
    spans are measured in the same way, and stay whatever comes out.

    Null and empty texts have no spans. Rows are independent of each other but for the dictionary, so repeats
    and null ids each get their result. Texts are taken about 2 MB at a time, a longer one by itself, at some five bytes
    of memory for a byte of text. Returns doc_id and spans (kind, start and end in code points, novelty), by start.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(shared.value)
        for batch in slices(batches):
            texts = _Texts(batch)
            base = texts.base()
            more = texts.candidates(base)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i in {*base, *more}:
                lo, hi = int(texts.bounds[i]), int(texts.bounds[i + 1])
                own = [(s, p, e, k, meter.novelty(texts.data, s, e, lo, hi)) for s, p, e, k in base.get(i, ())]
                tried = [(s, len(BASE), e, NOVEL, meter.novelty(texts.data, s, e, lo, hi)) for s, e in more.get(i, ())]
                own += [x for x in tried if x[4] >= novelty]
                at = texts.code_points(i, [(s, e) for s, _, e, _, _ in own])
                spans[i] = [{"kind": k, "start": at[s], "end": at[e], "novelty": x} for s, _, e, k, x in sorted(own)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _KIND)], names=["doc_id", "spans"])

    return _slim(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of ``find_secrets`` as counts, a digest of the base spans, and a list of all as text."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find_secrets(docs, id_col, text_col)
    spans = F.col("spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter(spans, lambda s: s["kind"] != NOVEL)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
