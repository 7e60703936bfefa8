"""Language identification by compression.

Every language has a zstandard dictionary of raw content: a bounded sample of its texts. A text is
encoded once with each dictionary, and the language whose dictionary leaves the fewest bytes is
predicted. Texts are encoded in blocks of ``BLOCK_BYTES``, all of them, because a long text would teach
the encoder its own language and drown the dictionary's share. Letters are lower-cased and everything
else becomes a space, so symbols and capitals neither help nor hurt. The margin is the share by which
the best encoding is smaller than the second best; a narrow one rejects the prediction.

A language is left out if its sample has under ``LEAST_BYTES`` of letters: its texts then get the name
of another language, or are rejected. If no language reaches that, all with a few letters are learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.words import slices

#: Bounds of what is learned of a language: sampled texts and characters taken from each. What the
#: driver reads and sends out grows with the number of languages only.
SAMPLE_TEXTS = 96
SAMPLE_CHARS = 2048
DICTIONARY_BYTES = 1 << 16
LEAST_BYTES = 1 << 12
#: Encoders held at a time; further languages are scored in further blocks.
LANGUAGES_AT_ONCE = 128
BLOCK_BYTES = 1 << 12
NARROW = 0.01
#: Shorter texts are encoded three times over: below this an encoder would not try to match at all.
SHORT_BYTES = 256
UNKNOWN = "und"

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode()


class Languages:
    """One encoder per language, ``LANGUAGES_AT_ONCE`` of them in memory at a time."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples = samples
        self._held: tuple[int, list[tuple[str, zstandard.ZstdCompressor]]] | None = None

    def encoders(self, first: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
        """Encoders of the block of languages that begins with number ``first`` by name."""
        if self._held is not None and self._held[0] == first:
            return self._held[1]
        self._held = None
        out = []
        for name in sorted(self.samples)[first : first + LANGUAGES_AT_ONCE]:
            # Matches of three bytes: syllables tell languages apart, and short texts have little else.
            parameters = zstandard.ZstdCompressionParameters.from_level(
                5,
                source_size=BLOCK_BYTES,
                dict_size=DICTIONARY_BYTES,
                strategy=zstandard.STRATEGY_BTOPT,
                min_match=3,
                search_log=3,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=0,
                write_checksum=0,
                write_dict_id=0,
            )
            content = zstandard.ZstdCompressionDict(self.samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            out.append((name, zstandard.ZstdCompressor(compression_params=parameters, dict_data=content)))
        self._held = first, out
        return out

    def __getstate__(self) -> dict:
        return {"samples": self.samples, "_held": None}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, margin) of every text; ``und`` and 0 for a text without a letter."""
        bodies = [_blocks(t) if t and _LETTER.search(t) else [] for t in texts]
        best: list[tuple[float, str]] = [(math.inf, UNKNOWN)] * len(bodies)
        second = [math.inf] * len(bodies)
        for first in range(0, len(self.samples), LANGUAGES_AT_ONCE):
            for name, encoder in self.encoders(first):
                for i, body in enumerate(bodies):
                    if body:
                        size = sum(len(encoder.compress(b)) for b in body)
                        if size < best[i][0]:
                            best[i], second[i] = (size, name), best[i][0]
                        elif size < second[i]:
                            second[i] = size
        return [(name, 0.0 if name == UNKNOWN else 1.0 - size / other) for (size, name), other in zip(best, second)]


def _blocks(text: str) -> list[bytes]:
    body = letters(text)
    if len(body) < SHORT_BYTES:
        body = b" ".join([body] * 3)
    return [body[i : i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Dictionaries from the rows of ``docs`` that have a text and a language.

    The ``SAMPLE_TEXTS`` texts of lowest hash are taken of every language. A bar set by the language's
    number of distinct texts, estimated within a few hundredths, lets about twice as many through, so
    copies of one text count once and no language is sorted as a whole.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    scale = 1 << 30
    bar = F.lit(2.0 * scale * SAMPLE_TEXTS) / F.col("n")
    bars = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).select("lang", bar.alias("bar"))
    drawn = (
        rows.join(F.broadcast(bars), "lang")
        .where(F.pmod("h", F.lit(scale)) < F.col("bar"))
        .select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        .dropDuplicates(["lang", "h"])
        .collect()
    )
    samples: dict[str, list[bytes]] = {}
    for r in sorted(drawn, key=lambda r: (r["h"] % scale, r["h"])):
        taken = samples.setdefault(r["lang"], [])
        if len(taken) < SAMPLE_TEXTS:
            taken.append(letters(r["text"]))
    joined = {k: b" ".join(filter(None, v))[:DICTIONARY_BYTES] for k, v in samples.items()}
    least = LEAST_BYTES if any(len(v) >= LEAST_BYTES for v in joined.values()) else 8
    return Languages({k: v for k, v in joined.items() if len(v) >= least})


def predict(docs: DataFrame, languages: Languages, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``.

    ``score`` is the margin in 0..1; ``rejected`` if it is under NARROW or the text is unknown. Null
    texts and texts without a letter are ``und``. Rows stay one to one; other columns are not read.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = zip(*shared.value.predict(part.column("text").to_pylist()))
                scores = np.array(scores)
                rejected = (scores < NARROW) | (np.array(names) == UNKNOWN)
                columns = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, languages: Languages) -> DataFrame:
    """``docs`` without the rows whose prediction is rejected; all columns stay, nothing is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                said = shared.value.predict(part.column("text").to_pylist())
                yield part.filter(pa.array([n != UNKNOWN and s >= NARROW for n, s in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
