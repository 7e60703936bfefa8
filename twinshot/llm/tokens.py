"""Token counts of texts of any length, by overlap resynchronisation.

A long text is encoded in chunks that overlap. The vocabulary's split pattern scans from left to
right and looks no further than one character beyond a match, so a scan that stands at the start of a
word continues in one way only, wherever it began. Hence a word start that two neighbouring chunks
share is a stable boundary, provided the left chunk's own scan is right up to there, which holds
except near its end where words and special strings may be cut. Words up to the boundary are counted
from the left chunk, the rest from the right one. Where the overlap holds no such boundary (one very
long word), it is widened, in the end to the whole rest of the text. Texts no longer than a chunk
are one chunk, whose distinct words are encoded once.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.bpe import KnownWords, Splitter, byte_level
from twinshot.llm.words import slices

CHUNK = 1 << 16
OVERLAP = 1 << 10
# Characters and words at a left chunk's end whose boundaries are not trusted: more than the longest
# special string and than any pair of words that the pattern would join with what follows.
TAIL_CHARS = 64
TAIL_WORDS = 3


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def _known(path: str) -> tuple[Splitter, KnownWords]:
    """The tokens of words; a word that the split pattern cuts out is encoded alike on its own."""
    byte_level(path)
    t = _tokenizer(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = [len(e) for e in t.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(counts, dtype=np.int64), np.ones(len(words), dtype=np.int64)

    special = [a.content for a in t.get_added_tokens_decoder().values()]
    return Splitter(special), KnownWords(encode)


def _boundaries(encoding) -> dict[int, int]:
    """Start of each word in the chunk, and the number of tokens before it.

    Offsets may leave out a word's leading space, so a word is placed at the end of the one before.
    A special string has no word number and is a word of its own.
    """
    out, last, end = {}, object(), 0
    for i, (word, (_, e), special) in enumerate(zip(encoding.word_ids, encoding.offsets, encoding.special_tokens_mask)):
        if word is None or word != last or special:
            out[end] = i
        last, end = word, max(end, e)
    return out


class Counter:
    """Counts tokens; ``chunk`` and ``overlap`` are in characters."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("overlap must be positive and smaller than chunk")
        self.path, self.chunk, self.overlap = path, chunk, overlap

    def short(self, texts: list[str]) -> list[int]:
        """Tokens of texts; words met before in this process are not encoded again."""
        splitter, known = _known(self.path)
        split = [splitter(t) for t in texts]
        counts = known.values(known.find([w for words in split for w in words]))
        ends = np.cumsum([len(words) for words in split])
        sums = np.r_[0, np.cumsum(counts)]
        return np.diff(np.r_[0, sums[ends]]).tolist() if len(ends) else []

    def long(self, text: str) -> int:
        """Tokens of one text, chunk by chunk."""
        tokenizer = _tokenizer(self.path)
        total, begin, sure = 0, 0, 0
        size, overlap = self.chunk, self.overlap
        left = tokenizer.encode(text[:size], add_special_tokens=False)
        left_stop = min(size, len(text))
        while left_stop < len(text):
            start = max(begin + 1, left_stop - overlap)
            stop = min(len(text), max(start + size, left_stop + overlap))
            right = tokenizer.encode(text[start:stop], add_special_tokens=False)
            places = _boundaries(left)
            trusted = sorted(places)[:-TAIL_WORDS]
            of_right = _boundaries(right)
            common = next(
                (
                    p
                    for p in trusted
                    if max(start, sure) <= begin + p <= left_stop - TAIL_CHARS and begin + p - start in of_right
                ),
                None,
            )
            if common is None:
                if start == begin + 1:
                    # The overlap spans the whole left chunk: take a longer chunk instead.
                    left_stop = min(len(text), begin + 2 * (left_stop - begin))
                    left = tokenizer.encode(text[begin:left_stop], add_special_tokens=False)
                    overlap = self.overlap
                else:
                    overlap *= 2
                continue
            # What the right chunk has before the boundary was counted from the left one.
            sure = begin + common
            total += places[common] - of_right[sure - start]
            begin, left, left_stop, overlap = start, right, stop, self.overlap
        return total + len(left)


def token_counts(
    docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``, as the tokenizer file counts them.

    No special tokens are added; special strings inside a text are tokens, as the library's default
    has it. Null and empty texts have no bytes and no tokens. Rows stay one to one, null ids and
    repeated rows included; other columns are not read. Texts of more than ``chunk`` characters are
    encoded in chunks.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, chunk, overlap)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [0] * len(texts)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                for i, c in zip(short, counter.short([texts[i] for i in short])):
                    n[i] = c
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        n[i] = counter.long(t)
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64())], schema=schema)

    return plain.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
