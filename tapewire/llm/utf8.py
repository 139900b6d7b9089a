"""Whole texts as bytes: words and their hashes for a run of documents at once, with numpy.

Used inside tasks on Arrow batches. White space is the six characters
``[\\x20\\x09-\\x0D]``, and a word is a longest run of other bytes.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd factors of the polynomial hashes, and their inverses modulo 2^64.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
#: Words longer than this are hashed whole, because a polynomial modulo 2^64 is weak on long regular strings.
_LONG = 256

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which every output bit hangs on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(ends):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the end as last entry. Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """The words of several documents: byte ranges, the document of each, and each document's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word, others for each seed."""
        base = _BYTE + 4 * seed
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(base, len(self.data)), out=sums[1:])
        out = mix((sums[self.end] - sums[self.start]) * powers(pow(base, -1, _MASK + 1), len(self.data) + 1)[self.start])
        for i in np.flatnonzero(self.end - self.start > _LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), seed)
        return out

    def windows(self, width: int) -> np.ndarray:
        """Words that ``width`` consecutive words of one document begin with, as indices."""
        left = np.repeat(self.first[1:], self.count()) - np.arange(len(self.start))
        return np.flatnonzero(left >= width)

    def window_hashes(self, width: int, at: np.ndarray, hashes: np.ndarray, seed: int = 0) -> np.ndarray:
        """64 bits for each window of ``width`` words that begins at ``at``."""
        base = _WORD + 2 * seed
        h = mix(hashes + np.uint64(seed)) if seed else hashes
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(base, len(h)), out=sums[1:])
        return mix((sums[at + width] - sums[at]) * powers(pow(base, -1, _MASK + 1), len(h) + 1)[at])


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Cut the texts into words."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, start, end, doc, first)
