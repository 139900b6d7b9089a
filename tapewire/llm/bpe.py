"""Byte pair encoding and decoding of whole documents with a given vocabulary file.

Letters, digits and case follow the Unicode data of ``regex`` and Python. Code points assigned since
Unicode 15.1 may be split or lower-cased otherwise by other implementations.
"""

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.utf8 import slices

#: Symbols beyond which a word goes by a heap, because scanning takes the square of its length.
SHORT = 64
#: Texts between white space, and words, whose ids a worker remembers; as many again are kept from before.
REMEMBERED, REMEMBERED_WORDS = 1 << 15, 1 << 17
#: Longer texts without white space are not remembered.
_LONGEST = 64
_SPACE = r"\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it has one, else the next free from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: ids, merges, the split pattern and the added tokens.

    Merges go by ids: ``pairs`` gives for two ids (as one integer) rank and id of what they become. Texts
    outside the vocabulary that merges mention have ids from ``size`` on.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids.update(self.special)
        self.suffix: str = model.get("end_of_word_suffix") or ""
        normal = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern: str = split["pattern"]["Regex"]
        kinds = [n["type"] for n in normal]
        # White space then only parts words: no need to replace it, and what lies between is read by itself.
        plain = kinds == ["NFC", "Replace", "Lowercase"] and (normal[1]["pattern"]["Regex"], normal[1]["content"]) == (_SPACE, " ")
        if not plain or not split["invert"] or split["behavior"] != "Removed" or "(?" in self.pattern or regex.search(self.pattern, " "):
            raise ValueError(f"{path}: only lower-casing word tokenizers are supported")
        self.size = max(self.ids.values()) + 1
        every, letters = dict(self.ids), byte_letters()

        def number(token: str) -> int:
            return every.setdefault(token, self.size + len(every) - len(self.ids))

        self.inner, self.last = [number(c) for c in letters], [number(c + self.suffix) for c in letters]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {number(a) << 32 | number(b): rank << 32 | number(a + b) for rank, (a, b) in enumerate(merges)}

    def tokens(self) -> list[str]:
        named = [""] * self.size
        for token, i in self.ids.items():
            named[i] = token
        return named


class _Memory:
    """Values of the keys met of late: when as many as ``most`` are held, those before them go."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key: str):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Coder:
    """Encodes and decodes with one vocabulary; remembers the ids, and only these, of what it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = regex.compile(vocabulary.pattern)
        self.gap = regex.compile(_SPACE)
        # what str.split takes for white space and the tokenizer doesn't
        odd = [c for c in map(chr, range(0x3001)) if c.isspace() and not self.gap.match(c)]
        self.odd = regex.compile("[" + "".join(map(regex.escape, odd)) + "]") if odd else None
        self.names = vocabulary.tokens()
        longest_first = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.known, self.words = _Memory(REMEMBERED), _Memory(REMEMBERED_WORDS)

    def pieces(self, text: str) -> list[str]:
        """The words of a text, normalised: composed and in lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case is taken letter by letter, so a final sigma stays an ordinary one.
        low = text.replace("Σ", "σ").lower()
        return [low] if low.isalpha() else self.word.findall(low)

    def parts(self, word: str) -> list[int]:
        """The tokens of a word: its parts in one array and the ranks of adjacent parts in another."""
        data, pairs = word.encode(), self.v.pairs
        part = [self.v.inner[b] for b in data[:-1]] + [self.v.last[data[-1]]]
        if len(part) > SHORT:
            return self._long(part)
        never = 1 << 62
        rank = [pairs.get(a << 32 | b, never) for a, b in zip(part, part[1:], strict=False)]
        while rank and (least := min(rank)) < never:
            i = rank.index(least)
            part[i] = least & 0xFFFFFFFF
            del part[i + 1], rank[i]
            if i < len(rank):
                rank[i] = pairs.get(part[i] << 32 | part[i + 1], never)
            if i:
                rank[i - 1] = pairs.get(part[i - 1] << 32 | part[i], never)
        return part

    def _long(self, part: list[int]) -> list[int]:
        """The same merges for a long word, smallest rank and then leftmost first, by a heap over linked parts."""
        pairs, n, gone = self.v.pairs, len(part), -1
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, part[i + 1]) for i in range(n - 1) if (r := pairs.get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, right = heapq.heappop(heap)
            j = after[i]
            if part[i] == gone or j < 0 or part[j] != right or pairs.get(part[i] << 32 | right) != r:
                continue
            part[i], part[j], after[i] = r & 0xFFFFFFFF, gone, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := pairs.get(part[a] << 32 | part[b])) is not None:
                    heapq.heappush(heap, (r, a, part[b]))
        return [p for p in part if p != gone]

    def _word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit integers; parts outside the vocabulary have none."""
        found = self.words.get(word)
        if found is None:
            own = [p for p in self.parts(word) if p < self.v.size]
            found = struct.pack(f"<{len(own)}I", *own)
            if len(word) <= _LONGEST:
                self.words.put(word, found)
        return found

    def _run(self, run: str) -> bytes:
        """Ids of a text without white space."""
        found = self.known.get(run)
        if found is None:
            known, own = self.words.new, self._word
            found = b"".join([known[w] if w in known else own(w) for w in self.pieces(run)])
            if len(run) <= _LONGEST:
                self.known.put(run, found)
        return found

    def _runs(self, text: str) -> list[bytes]:
        runs = text.split() if self.odd is None or not self.odd.search(text) else [r for r in self.gap.split(text) if r]
        known, own = self.known.new, self._run
        return [known[r] if r in known else own(r) for r in runs]

    def encode(self, text: str) -> bytes:
        """The ids of a text, the added tokens that it spells out included."""
        if self.special is None or not any(token in text for token in self.v.special):
            return b"".join(self._runs(text))
        found = []
        for k, piece in enumerate(self.special.split(text)):
            found += [self.v.special[piece].to_bytes(4, "little")] if k % 2 else self._runs(piece)
        return b"".join(found)

    def code(self, text: str) -> tuple[bytes, str]:
        """The ids of a text, and what they decode to."""
        ids = self.encode(text)
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, joined by one space, as the format has no rule to join them otherwise."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, Coder] = {}


def _coder(path: str, shared) -> Coder:
    """One coder for each worker and vocabulary."""
    if path not in _coders:
        _coders[path] = Coder(shared.value)
    return _coders[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _vocabulary(docs: DataFrame, path: str):
    """Sent once to each executor; as large as the tokenizer file, whatever the documents."""
    return docs.sparkSession.sparkContext.broadcast(Vocabulary(path))


def _lists(encoded: list[bytes]) -> pa.ListArray:
    bounds = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; ``path`` is the tokenizer file on the driver.

    A null or empty text has no ids. Added tokens spelled out in a text are encoded as such, and none
    are put around it. Rows are independent of each other, so repeats and null ids stay as they are.
    """
    shared = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, shared)
        for batch in slices(batches):
            found = [coder.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(found)], names=["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows from ``encode_documents``: tokens joined by a space. Null ids count as none."""
    shared = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, shared)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and return both as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    As ``encode_documents`` followed by ``decode_documents``, in one pass; ``with_ids`` adds the ids (array of int).
    """
    shared = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, shared)
        for batch in slices(batches):
            found, counts, of_ids, of_text = [], [], [], []
            for t in batch.column("text").to_pylist():
                ids, decoded = coder.code(t)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    found.append(ids)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()),
                "decoded_sha256": pa.array(of_text, pa.string()),
            }
            if with_ids:
                columns["ids"] = _lists(found)
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _texts(docs, id_col, text_col).mapInArrow(run, schema)
