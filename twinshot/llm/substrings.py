"""Removal of passages that occur more than once, by seed and extend.

Seeds. In every window of ``length`` words the 8-word run with the smallest hash (the rightmost on
ties) is the window's anchor; the anchors of a text are its winnowed seeds, about one in fourteen
words. The choice depends on the window's words alone, so equal windows have equal anchors at equal
offsets, and only windows whose anchor occurs twice can be repeated.

Extension. The windows that share one anchor occurrence form a run, which reaches as far to both
sides as that anchor rules. Occurrences of an anchor are joined and first compared by their whole
run: where it is met again, all its windows are repeated and the match goes on into the next run.
Where it is not, because a match ends somewhere inside, the run is extended word by word: its windows
are compared with those of all other runs of the same anchor, one representative of each.
Overlapping repeated windows unite into maximal repeats.

Copies are never paired with each other: everything is counted by key with partial aggregation, and
hot keys meet in joins of stored tables that adaptive execution can split. Windows are identified by
128 bits (anchor hash and window hash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.store import stored
from twinshot.llm.words import Words, mix, ngram_hashes, pack_texts, signed, slices, span_hashes, unpack_texts

SEED_WORDS = 8


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest (rightmost on ties) of each ``width`` consecutive hashes."""
    at, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        left, right = h[:-step] if step else h, h[step:]
        take = right <= left
        h, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    return at


class Runs:
    """Windows of the texts of a column, grouped into runs that share an anchor occurrence.

    Run r holds windows ``begin[r] <= p < stop[r]`` of text ``doc[r]``; ``ordinal`` counts the runs
    of a text.
    """

    def __init__(self, texts: pa.Array, length: int):
        self.words = Words(texts)
        self.length = length
        self.hashes = self.words.hashes()
        seeds = ngram_hashes(self.hashes, SEED_WORDS)
        width = length - SEED_WORDS + 1
        anchor = _smallest(seeds, width) if len(seeds) >= width else np.zeros(0, np.int64)
        window = np.arange(len(anchor))
        doc = self.words.doc_of(window)
        fits = window + length <= self.words.first[doc + 1] if len(window) else np.zeros(0, bool)
        window, doc, anchor = window[fits], doc[fits], anchor[fits]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(window) else window
        self.begin, self.doc = window[new], doc[new]
        self.stop = window[np.r_[new[1:], len(window)] - 1] + 1 if len(window) else window
        self.anchor = seeds[anchor[new]]
        # A run is its words and the place of the anchor among them.
        whole = span_hashes(self.hashes, self.begin, self.stop + length - 1)
        self.whole = mix(whole + (anchor[new] - self.begin).astype(np.uint64))
        self.of_doc = np.searchsorted(self.doc, np.arange(self.words.n_docs + 1))
        self.ordinal = np.arange(len(self.doc)) - self.of_doc[self.doc]

    def window_hashes(self, windows: np.ndarray) -> np.ndarray:
        return mix(span_hashes(self.hashes, windows, windows + self.length))

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Flags of the words that the given windows cover."""
        steps = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(steps, windows, 1)
        np.add.at(steps, windows + self.length, -1)
        return np.cumsum(steps[:-1]) > 0


def _spread(begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges begin..stop."""
    size = stop - begin
    return np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else begin


_ANCHORS = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("ordinal", pa.int32())])


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                r = Runs(part.column("text"), length)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                columns = [signed(r.anchor), signed(r.whole), ids[r.doc], r.ordinal.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ANCHORS)

    return run


_RESULT = [
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("repeats", pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))),
    ("kept_text", pa.large_string()),
    ("kept_sha256", pa.string()),
]
_RESULT_DDL = (
    "doc_id long, n_words long, n_removed long, repeats array<struct<begin:int,stop:int>>, kept_text string, kept_sha256 string"
)
_DECIDED_DDL = _RESULT_DDL + ", packed binary, sure array<int>, anchors array<long>, windows array<long>, at array<int>"


def _row(doc_id: int, r: Runs, i: int, covered: np.ndarray, digest: bool) -> dict:
    a, b = r.words.first[i], r.words.first[i + 1]
    own = covered[a:b]
    edges = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0]))
    kept = r.words.words_of(i, ~covered)
    return {
        "doc_id": doc_id,
        "n_words": int(b - a),
        "n_removed": int(own.sum()),
        "repeats": [{"begin": x, "stop": y} for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())],
        "kept_text": None if digest else kept.decode(),
        "kept_sha256": hashlib.sha256(kept).hexdigest(),
    }


def _decide(length: int, digest: bool):
    """Finish texts whose runs are settled; of the others give the windows still to be compared."""
    schema = pa.schema(
        _RESULT
        + [("packed", pa.binary()), ("sure", pa.list_(pa.int32())), ("anchors", pa.list_(pa.int64()))]
        + [("windows", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", 1 << 19):
                r = Runs(unpack_texts(part.column("packed")), length)
                full, compare = np.zeros(len(r.doc), bool), np.zeros(len(r.doc), bool)
                for i, codes in enumerate(part.column("codes")):
                    if codes.is_valid:
                        c = codes.values.to_numpy()
                        own = r.of_doc[i] + (c >> 2)
                        full[own], compare[own] = c & 2 > 0, c & 1 > 0
                sure = _spread(r.begin[full], r.stop[full])
                covered = r.covered(sure)
                asked = _spread(r.begin[compare], r.stop[compare])
                anchors = np.repeat(r.anchor[compare], (r.stop - r.begin)[compare])
                windows = r.window_hashes(asked)
                of_sure, of_asked = (np.searchsorted(x, r.words.first) for x in (sure, asked))
                blobs = part.column("packed")
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    a, b = of_asked[i], of_asked[i + 1]
                    if a == b:
                        rows.append(_row(doc_id, r, i, covered, digest))
                    else:
                        first = r.words.first[i]
                        rows.append(
                            {
                                "doc_id": doc_id,
                                "packed": blobs[i].as_py(),
                                "sure": sure[of_sure[i] : of_sure[i + 1]] - first,
                                "anchors": signed(anchors[a:b]),
                                "windows": signed(windows[a:b]),
                                "at": asked[a:b] - first,
                            }
                        )
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _finish(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", 1 << 19):
                r = Runs(unpack_texts(part.column("packed")), length)
                found = []
                for name in ("sure", "found"):
                    for i, at in enumerate(part.column(name)):
                        if at.is_valid:
                            found.append(r.words.first[i] + at.values.to_numpy(zero_copy_only=False).astype(np.int64))
                covered = r.covered(np.concatenate(found) if found else np.zeros(0, np.int64))
                rows = [_row(d, r, i, covered, digest) for i, d in enumerate(part.column("doc_id").to_pylist())]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_RESULT))

    return run


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 35, digest: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept_text, kept_sha256) for every row of ``docs``.

    Words are runs of characters other than space and \\x09-\\x0D. A window of ``length`` words is
    repeated if its word sequence also starts elsewhere in any text, its own included; every word
    that a repeated window covers is removed. ``repeats`` are the maximal repeats as word ranges,
    ``kept_text`` the other words joined by one space (null with ``digest``, which leaves only its
    SHA-256). Null and empty texts, and texts shorter than a window, lose nothing. Ids must be
    unique and not null; rows without an id are left out. Other columns are not read.
    """
    if length < SEED_WORDS:
        raise ValueError(f"length must be at least {SEED_WORDS}")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(
        "doc_id is not null"
    )
    anchors = plain.mapInArrow(_anchors(length), "anchor long, whole long, doc_id long, ordinal int")
    again = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    seeds = stored(anchors.join(again, "anchor"))
    kinds = stored(seeds.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "ordinal")).alias("one")))
    varied = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("varied")))
    kinds = stored(kinds.join(varied, "anchor", "left"))
    # A run met again is full; a lone run, and one occurrence of each full run of an anchor that has
    # other runs as well, have their windows compared.
    mine = (F.col("one.doc_id") == F.col("doc_id")) & (F.col("one.ordinal") == F.col("ordinal"))
    code = (
        F.col("ordinal") * 4
        + F.when(F.col("n") > 1, 2).otherwise(0)
        + F.when(F.coalesce("varied", F.lit(False)) & mine, 1).otherwise(0)
    )
    codes = seeds.join(kinds, ["anchor", "whole"]).select("doc_id", code.alias("code")).groupBy("doc_id").agg(
        F.collect_list("code").alias("codes")
    )
    decided = stored(pack_texts(plain).join(codes, "doc_id", "left").mapInArrow(_decide(length, digest), _DECIDED_DDL))
    opened = decided.where("packed is not null")
    asked = opened.select("doc_id", F.explode(F.arrays_zip("anchors", "windows", "at")).alias("w")).select(
        "doc_id", "w.anchors", "w.windows", "w.at"
    )
    # A full run's windows are known to be repeated; its representative's count tells the others.
    met = stored(asked.groupBy("anchors", "windows").agg(F.count("*").alias("n")).where("n > 1").select("anchors", "windows"))
    found = asked.join(met, ["anchors", "windows"]).groupBy("doc_id").agg(F.collect_list("at").alias("found"))
    late = (
        opened.select("doc_id", "packed", "sure")
        .join(found, "doc_id", "left")
        .mapInArrow(_finish(length, digest), _RESULT_DDL)
    )
    names = [n for n, _ in _RESULT]
    return decided.where("packed is null").select(*names).union(late.select(*names))
