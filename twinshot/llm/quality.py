"""Quality rules: statistics of the rules, and an isolation forest that finds what they miss.

Every text is summed up by the counts that quality rules use. A forest of random trees isolates rows
by splits drawn uniformly over a random statistic's range in the node; anomalous rows are alone after
few splits. The range of the root is that of all documents, and the trees are grown from rows labelled
good, so that whatever lies where good rows are rare is isolated early, however common it is in the
corpus. They are a sample of ``SAMPLE_ROWS`` rows at most, drawn by the hash of their ids. The score is
2 ** (-E(path) / c), c being the expected path of a random search tree. The threshold is calibrated on
all labelled rows: a histogram of scores by label, summed over the cluster, gives the score with the
least share of good rows above plus bad rows below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.store import stored
from twinshot.llm.words import Words, mix, ngram_hashes, slices

TREES = 128
TREE_ROWS = 1024
SAMPLE_ROWS = 8192
SCORE_BINS = 1000
MIN_WORDS = 50
REPEAT_PERCENT = 50

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_START = np.ones(256, dtype=np.int64)
_START[0x80:0xC0] = 0  # continuation bytes of UTF-8 begin no character
_MARKS, _DIGITS, _CAPITALS = (np.zeros(256, dtype=np.int64) for _ in range(3))
_MARKS[list(b".,;:!?")] = 1
_DIGITS[list(b"0123456789")] = 1
_CAPITALS[list(range(ord("A"), ord("Z") + 1))] = 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_digits", "n_capitals", "n_lines"]
_STATS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])


def _by_text(table: np.ndarray, words: Words) -> np.ndarray:
    """Sum of a byte table over each text."""
    sums = np.r_[0, np.cumsum(table[words.data])]
    return np.diff(sums[words.offsets])


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each text in three-word windows found twice or more in it."""
    h = ngram_hashes(words.hashes(), 3)
    at = np.arange(len(h))
    doc = words.doc_of(at)
    fits = at + 3 <= words.first[doc + 1] if len(at) else np.zeros(0, bool)
    at, doc = at[fits], doc[fits]
    _, place, count = np.unique(mix(h[at] + doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    at = at[count[place] > 1]
    steps = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + 3, -1)
    sums = np.r_[0, np.cumsum(np.cumsum(steps[:-1]) > 0)]
    return np.diff(sums[words.first])


def _line_counts(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """(lines with a word, those equal to an earlier one) of each text."""
    blank = " \t\n\v\f\r"
    n, again = [], []
    for t in texts:
        lines = [line for line in (t or "").split("\n") if line.strip(blank)]
        n.append(len(lines))
        again.append(len(lines) - len(set(lines)))
    return n, again


def rule_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of every text: words, their code points, symbols, repeated lines and words, and others.

    Null and empty texts have zeros. Rows stay one to one; other columns are not read.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                begins = np.r_[0, np.cumsum(_START[words.data])]
                chars = np.r_[0, np.cumsum(begins[words.end] - begins[words.start])]
                lines, again = _line_counts(part.column("text").to_pylist())
                columns = [
                    words.counts,
                    np.diff(chars[words.first]),
                    _by_text(_SYMBOLS, words),
                    again,
                    _repeat_words(words),
                    *(_by_text(t, words) for t in (_MARKS, _DIGITS, _CAPITALS)),
                    lines,
                ]
                arrays = [pa.array(np.asarray(c, dtype=np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], schema=_STATS)

    return plain.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


FEATURES = ["word length", "symbols", "repeats", "marks", "capitals", "repeated lines", "digits", "words"]


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics of rows: rates by word, character or line; symbols, which are rare, and words on a log scale."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            c["word_chars"] / words,
            np.log1p(100 * c["n_symbols"] / words),
            c["n_repeat_words"] / words,
            c["n_marks"] / words,
            c["n_capitals"] / chars,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_digits"] / chars,
            np.log1p(c["n_words"]),
        ],
        axis=1,
    )


def _expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary search tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees as arrays: at node i, rows with column[i] below cut[i] go to below[i], others to above[i]."""

    column: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    roots: list[int]
    rows: int

    @classmethod
    def grow(cls, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 7) -> Forest:
        """Trees over rows ``x``; ``lo`` and ``hi`` bound the root's splits."""
        rng = np.random.default_rng(seed)
        nodes: list[list[float]] = []
        rows = min(TREE_ROWS, len(x))
        limit = math.ceil(math.log2(max(rows, 2))) + 4

        def node(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
            i = len(nodes)
            nodes.append([0, 0.0, -1, -1, depth + _expected_path(len(own))])
            open_columns = np.flatnonzero(lo < hi)
            if len(own) > 1 and depth < limit and len(open_columns):
                c = int(rng.choice(open_columns))
                cut = float(rng.uniform(lo[c], hi[c]))
                under = own[:, c] < cut
                lo_above, hi_below = lo.copy(), hi.copy()
                lo_above[c] = hi_below[c] = cut
                below, above = node(own[under], lo, hi_below, depth + 1), node(own[~under], lo_above, hi, depth + 1)
                nodes[i][:4] = [c, cut, below, above]
            return i

        roots = [node(x[rng.choice(len(x), rows, replace=False)], lo, hi, 0) for _ in range(TREES)] if len(x) else []
        a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
        return cls(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], roots, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in 0..1 of each row; without trees all rows score 0."""
        if not self.roots or not len(x):
            return np.zeros(len(x))
        total, all_rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                moving = all_rows[self.below[at] >= 0]
                if not len(moving):
                    break
                i = at[moving]
                under = x[moving, self.column[i]] < self.cut[i]
                at[moving] = np.where(under, self.below[i], self.above[i])
            total += self.leaf[at]
        return 2.0 ** (-total / len(self.roots) / max(_expected_path(self.rows), 1e-9))


def _ratios() -> list:
    """``features`` as columns, in the same order."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.col("word_chars") / words,
        F.log1p(F.lit(100) * F.col("n_symbols") / words),
        F.col("n_repeat_words") / words,
        F.col("n_marks") / words,
        F.col("n_capitals") / chars,
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_digits") / chars,
        F.log1p("n_words"),
    ]


def _scored(counts: DataFrame, forest: Forest) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast(forest)
    schema = pa.schema([*_STATS, ("good", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], schema=schema)

    columns = ["doc_id", *COUNTS, "good"]
    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", good int, score double"
    return counts.select(*columns).mapInArrow(run, ddl)


def _threshold(scored: DataFrame) -> int:
    """The score bin from which on rows are anomalous.

    It has the least share of good rows in or above it plus bad rows below it; of equally good bins
    the middle one. Without rows of both kinds no bin is anomalous.
    """
    bins = (
        scored.where("good in (0, 1)")
        .groupBy(F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin"), "good")
        .count()
        .collect()  # at most 2 x (SCORE_BINS + 1) rows
    )
    by_label = np.zeros((2, SCORE_BINS + 2))
    for r in bins:
        by_label[r["good"], r["bin"]] += r["count"]
    totals = by_label.sum(axis=1)
    if not totals.all():
        return SCORE_BINS + 1
    good_above = totals[1] - np.r_[0, np.cumsum(by_label[1])[:-1]]
    bad_below = np.r_[0, np.cumsum(by_label[0])[:-1]]
    loss = good_above / totals[1] + bad_below / totals[0]
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return int(best[len(best) // 2])


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """Counts of ``rule_counts``, base_failed, score and kept for every row of ``docs``.

    ``base_failed``: under MIN_WORDS words, or over REPEAT_PERCENT percent of words in repeated
    three-word windows. ``kept``: not failed, and the forest's score is below the threshold calibrated
    on ``labels`` (doc_id, label: 1 good, 0 bad; other values and repeats are ignored). Null and empty
    texts fail. Without good labels the forest has no trees and rejects nothing. Rows with a null id
    are judged too, but can't be labelled.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("good"))
        .where("doc_id is not null and good in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
    )
    counts = stored(rule_counts(docs, text, doc_id).join(known, "doc_id", "left"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    passed = counts.where(~failed)
    ratios = _ratios()
    bounds = passed.agg(*(f(r).alias(f"{n}{i}") for i, r in enumerate(ratios) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    lo, hi = (np.array([bounds[f"{n}{i}"] or 0.0 for i in range(len(ratios))]) for n in ("lo", "hi"))
    # The good rows of lowest id hash: a fixed number, whatever the size of the table.
    drawn = passed.where("good = 1").orderBy(F.xxhash64("doc_id"), *COUNTS).limit(SAMPLE_ROWS).select(*COUNTS).toArrow()
    forest = Forest.grow(features({c: drawn.column(c).to_numpy() for c in COUNTS}), lo, hi)
    scored = stored(_scored(counts, forest))
    anomalous = F.floor(F.col("score") * SCORE_BINS) >= F.lit(_threshold(scored.where(~failed)))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & ~anomalous).drop("good")
