"""Byte-level BPE by batched numpy merge rounds.

A text is cut at special strings and then by the vocabulary's split pattern. The distinct words of a
batch that have not been met before are encoded together: their byte symbols lie in one flat array
with word boundaries beside it. In every round the keys of all neighbouring pairs are looked up by
binary search among the sorted keys of the mergeable pairs; each word merges all occurrences, from
the left, of its lowest-ranked pair. A token is always learned after its parts, so a merge can't make
a pair of lower rank and rounds give what merging one pair at a time gives. Words that have no
mergeable pair left the array.

In a very long word every merge of one rank would cost a round over the whole word. The symbols of words over
``LONG_BYTES`` are therefore linked to their neighbours and a round, over all such words, looks only at
the places of one rank and, after merging, at the pairs beside them.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.words import slices

CACHE_WORDS = 400_000
LONG_BYTES = 256
_NO_RANK = np.iinfo(np.int64).max

# Fixed value: the split pattern of byte-level vocabularies with the ByteLevel pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def byte_level(path: str) -> dict:
    """The content of a byte-level BPE file; fails if it asks for anything that this module doesn't do."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [
        name
        for name, fits in (
            ("model", model.get("type", "BPE") == "BPE"),
            ("pre_tokenizer", split.get("type") == "ByteLevel" and split.get("use_regex", True)),
            ("add_prefix_space", not split.get("add_prefix_space")),
            ("normalizer", spec.get("normalizer") is None),
            ("decoder", (spec.get("decoder") or {}).get("type") == "ByteLevel"),
            ("added_tokens", not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))),
            *((k, not model.get(k)) for k in ("dropout", "byte_fallback", "ignore_merges")),
            *((k, not model.get(k)) for k in ("continuing_subword_prefix", "end_of_word_suffix")),
        )
        if not fits
    ]
    if odd:
        raise ValueError(f"{path} is no plain byte-level BPE file: {', '.join(odd)}")
    return spec


class Splitter:
    """Cuts texts into words; special strings are words of their own."""

    def __init__(self, special: list[str]):
        self.special = sorted(special, key=len, reverse=True)
        self._words = regex.compile(PATTERN).findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self._words(text)
        out = []
        for i, piece in enumerate(self._special.split(text)):
            out += [piece] if i % 2 else self._words(piece)
        return out


class KnownWords:
    """Values of words met before: ``flat[start[i]:start[i] + size[i]]`` for word number i.

    ``encode`` gives (values in a row, size of each) of new words. The store is emptied when it
    holds ``CACHE_WORDS``, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode
        self._clear()

    def _clear(self) -> None:
        self._index: dict[str, int] = {}
        self.flat = self.start = self.size = np.zeros(0, dtype=np.int64)

    def find(self, words: list[str]) -> np.ndarray:
        """Number of each word; new ones are encoded first."""
        if len(self._index) > CACHE_WORDS:
            self._clear()
        new = list(set(words).difference(self._index))
        if new:
            flat, size = self._encode(new)
            self._index.update(zip(new, range(len(self._index), len(self._index) + len(new))))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
            self.size = np.r_[self.size, size]
            self.flat = np.r_[self.flat, flat]
        return np.fromiter(map(self._index.__getitem__, words), dtype=np.int64, count=len(words))

    def values(self, index: np.ndarray) -> np.ndarray:
        """The values of words, in a row."""
        size = self.size[index]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Bpe:
    def __init__(self, path: str):
        spec = byte_level(path)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        lengths = np.array([len(b) for b in self.token_bytes])
        self.byte_ends = np.cumsum(lengths)
        self.byte_lengths = lengths
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.first_ids = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.first_ids[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.key_of_rank, self.into_of_rank = keys, into
        order = np.argsort(keys)
        self.keys, self.ranks, self.into = keys[order], order, into[order]
        self.splitter = Splitter(list(self.special))
        self.known = KnownWords(self._encode_words)

    def words(self, text: str) -> list[str]:
        return self.splitter(text)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of each word's ids), by rounds over all words."""
        raw = [w.encode() for w in words]
        symbol = self.first_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        finished = []
        while len(symbol):
            same = word[1:] == word[:-1]
            pair = np.where(same, symbol[:-1] * self.size + symbol[1:], -1)
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            rank = np.r_[np.where(self.keys[at] == pair, self.ranks[at], _NO_RANK), _NO_RANK]
            begins = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[begins, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, begins), sizes)
            live = lowest != _NO_RANK
            if not live.all():
                finished.append((word[~live], symbol[~live]))
                symbol, word, rank, lowest, at = symbol[live], word[live], rank[live], lowest[live], np.r_[at, 0][live]
            hit = rank == lowest
            # In a chain of overlapping pairs (aaa) every second one merges, from the left.
            if (hit[1:] & hit[:-1]).any():
                index = np.arange(len(hit))
                head = hit & ~np.r_[False, hit[:-1]]
                hit &= (index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0
            places = np.flatnonzero(hit)
            symbol[places] = self.into[at[places]]
            stay = np.ones(len(symbol), bool)
            stay[places + 1] = False
            symbol, word = symbol[stay], word[stay]
        word = np.concatenate([w for w, _ in finished]) if finished else word
        ids = np.concatenate([s for _, s in finished]) if finished else symbol
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def merge_long(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by rounds over ranks, ascending; each touches only the places that its rank has."""
        raw = [w.encode() for w in words]
        symbol = self.first_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n, sizes = len(symbol), np.array([len(r) for r in raw])
        word = np.repeat(np.arange(len(raw)), sizes)
        ends = np.cumsum(sizes)
        # Neighbours of each symbol; -1 and n where there is none.
        before, after = np.arange(n) - 1, np.arange(n) + 1
        before[ends - sizes], after[ends - 1] = -1, n
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            """Note the pairs that begin at these places under their ranks."""
            places = places[after[places] < n]
            pair = symbol[places] * self.size + symbol[after[places]]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == pair
            places, rank = places[known], self.ranks[at[known]]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for a, b in zip(cuts, [*cuts[1:], len(rank)]):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places[a:b])

        wait(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places]]
            places = places[after[places] < n]
            places = places[symbol[places] * self.size + symbol[after[places]] == self.key_of_rank[r]]
            if not len(places):
                continue
            # In a chain of overlapping pairs (aaa) every second one merges, from the left.
            chained = np.r_[False, after[places[:-1]] == places[1:]]
            if chained.any():
                index = np.arange(len(places))
                head = np.maximum.accumulate(np.where(chained, 0, index))
                places = places[(index - head) % 2 == 0]
            right = after[places]
            following = after[right]
            symbol[places], alive[right], after[places] = self.into_of_rank[r], False, following
            inside = following < n
            before[following[inside]] = places[inside]
            left = before[places]
            wait(np.unique(np.r_[left[left >= 0], places]))
        return symbol[alive], np.bincount(word[alive], minlength=len(words))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        long = {w for w in words if len(w.encode()) > LONG_BYTES and w not in self.special}
        plain = [w for w in words if w not in self.special and w not in long]
        if len(plain) == len(words):
            return self.merge(words)
        parts = {w: np.array([self.special[w]]) for w in words if w in self.special}
        for own, merge in ((plain, self.merge), (sorted(long), self.merge_long)):
            if own:
                ids, size = merge(own)
                parts.update(zip(own, np.split(ids, np.cumsum(size)[:-1])))
        return np.concatenate([parts[w] for w in words]), np.array([len(parts[w]) for w in words])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; a null text has none."""
        split = [self.words(t) if t else [] for t in texts]
        index = self.known.find([w for words in split for w in words])
        ids = self.known.values(index)
        before = np.r_[0, np.cumsum(self.known.size[index])]
        cuts = before[np.cumsum([len(words) for words in split])]
        return np.split(ids, cuts[:-1]) if len(cuts) else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes in a row, read as UTF-8 with replacement of what isn't."""
        n = self.byte_lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.byte_ends[ids] - ends, n) + np.arange(total)
        return self.all_bytes[source].tobytes().decode("utf-8", "replace")


@functools.cache
def _bpe(path: str) -> Bpe:
    return Bpe(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.large_string())])
_OUT_SHA = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def encode_decode(
    docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", digest: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file, at the same place on every executor. ``ids``
    are little-endian unsigned 32-bit integers, ``decoded`` the text they stand for; with ``digest``
    the SHA-256 of both instead (``ids_sha256``, ``decoded_sha256``). Special strings inside a text
    become their ids. Null and empty texts have no ids. Rows stay one to one, null ids included;
    other columns are not read.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode(part.column("text").to_pylist())
                n = pa.array([len(i) for i in ids], pa.int64())
                blobs = [i.astype("<u4").tobytes() for i in ids]
                decoded = [bpe.decode(i) for i in ids]
                columns = [blobs, decoded]
                if digest:
                    columns = [[hashlib.sha256(v).hexdigest() for v in c] for c in (blobs, [d.encode() for d in decoded])]
                schema = _OUT_SHA if digest else _OUT
                arrays = [pa.array(c, schema.field(i + 2).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, *arrays], schema=schema)

    ddl = "doc_id long, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string"
    )
    return plain.mapInArrow(run, ddl)
