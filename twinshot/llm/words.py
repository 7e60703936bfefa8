"""Words and word n-grams of many texts at once, as flat numpy arrays.

A word is a longest run of characters other than space and \\x09-\\x0D, as in
``[^\\x20\\x09-\\x0D]+``. All of these separators are single bytes in UTF-8, so words are found on
the bytes of an Arrow column without decoding. Hashes are polynomials over bytes (words) or over
word hashes (n-grams), modulo 2**64 and mixed afterwards; they depend on content alone, so equal
words have equal hashes in every task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and doubled when a longer one is asked for."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1024, 0 if have is None else 2 * len(have))
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have


def _span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for ascending spans, in blocks of bounded memory."""
    out = np.empty(len(start), dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    i = 0
    while i < len(start):
        s0 = start[i]
        j = max(i + 1, int(np.searchsorted(end, s0 + _BLOCK, "right")))
        seg = values(s0, end[j - 1])
        sums = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(seg * _powers(base, len(seg))[: len(seg)], out=sums[1:])
        a, b = start[i:j] - s0, end[i:j] - s0
        out[i:j] = (sums[b] - sums[a]) * _powers(inverse, int(a[-1]))[a]
        i = j
    return out


class Words:
    """Words of the texts of an Arrow string column; a null text has none.

    ``start``/``end`` are byte positions in ``data``, ``first[i]:first[i + 1]`` the words of text i.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        lo, hi = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        body = texts.buffers()[2]
        raw = np.frombuffer(body, dtype=np.uint8)[lo:hi] if body is not None and hi > lo else np.zeros(0, np.uint8)
        self.data = _LOWER[raw] if lower else raw
        self.offsets = offsets - lo
        if texts.null_count:  # Arrow may leave bytes under a null
            null = texts.is_null().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(null & (np.diff(self.offsets) > 0)):
                self.data = self.data.copy()
                self.data[self.offsets[i] : self.offsets[i + 1]] = 0x20
        inside = ~_SPACE[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = self.offsets[1:-1]
        cuts = cuts[cuts < len(inside)]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        ends[before] = inside[before]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.n_docs = n

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def hashes(self) -> np.ndarray:
        return mix(_span_hashes(lambda a, b: _BYTE_VALUES[self.data[a:b]], self.start, self.end, _BYTE_BASE))

    def words_of(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text i joined by one space; ``keep`` flags words of the whole column."""
        a, b = self.first[i], self.first[i + 1]
        data, start, end = self.data, self.start[a:b], self.end[a:b]
        if keep is not None:
            start, end = start[keep[a:b]], end[keep[a:b]]
        body = data[start[0] : end[-1]].tobytes() if len(start) else b""
        s0 = start[0] if len(start) else 0
        return b" ".join([body[s - s0 : e - s0] for s, e in zip(start.tolist(), end.tolist())])


def span_hashes(word_hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash, not yet mixed, of the words start..end of each span; spans ascend."""
    return _span_hashes(lambda a, b: word_hashes[a:b], start, end, _WORD_BASE)


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, texts' ends disregarded."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    start = np.arange(count, dtype=np.int64)
    return mix(_span_hashes(lambda a, b: word_hashes[a:b], start, start + n, _WORD_BASE) + np.uint64(n))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-word shingles, ordered by text, then hash.

    A text with some but fewer than n words has one shingle, its whole word sequence.
    """
    w = words.hashes()
    counts = words.counts
    h = ngram_hashes(w, n)
    at = np.arange(len(h))
    doc = words.doc_of(at)
    fits = at + n <= words.first[doc + 1] if len(at) else np.zeros(0, bool)
    doc, h = doc[fits], h[fits]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        start, end = words.first[short], words.first[short + 1]
        whole = mix(_span_hashes(lambda a, b: w[a:b], start, end, _WORD_BASE) + (end - start).astype(np.uint64))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text; one text is never cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    block = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def packed(text: bytes) -> bytes:
    """A text made small for a shuffle; ``unpacked`` restores it."""
    return _compressor().compress(text)


def unpacked(blob: bytes) -> bytes:
    return _decompressor().decompress(blob)


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed) of a table (doc_id, text): joins on doc_id then move a third of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                text = part.column("text").cast(pa.large_binary())
                blobs = [None if t is None else packed(t) for t in text.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def unpack_texts(part: pa.Array) -> pa.Array:
    """The texts of a column made by ``pack_texts``."""
    return pa.array([None if b is None else unpacked(b) for b in part.to_pylist()], pa.large_binary()).cast(pa.large_string())
