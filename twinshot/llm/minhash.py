"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes the set of its distinct word shingles. 32 bands of four minima give
   candidates: at similarity 0.8 the chance that no band agrees is (1 - 0.8**4)**32 = 5e-8. Texts
   with equal sets form a class, and only the class's lowest id goes on, so a group of exact copies
   costs one set of bands.
2. Texts that share a bucket with another class get their b-bit signature: 2048 minima, of each of which
   two bits of its mixed value are kept and packed (512 bytes a text), and their full set of shingle hashes.
3. Within a bucket no pairs are formed: every member is first compared with the member that sits
   in the fullest buckets, the likely origin of a group of near copies.
4. Candidates pass if the number of agreeing b-bit minima, which counts chance agreement of one in
   four, is one that a pair of similarity 0.8 falls below less than once in 1e7; then the full
   shingle sets decide.
5. Buckets whose members are not yet connected are compared completely between the components:
   small ones by a join, large ones in blocks of packed signatures. Nothing is capped; pairs that
   are already connected need no test, as a further link would not change a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinshot.llm.components import components
from twinshot.llm.store import stored
from twinshot.llm.words import Words, mix, pack_texts, shingles, signed, slices, unpack_texts

BANDS = 32
BAND_ROWS = 4
MINIMA = 2048
BITS = 2
MISS = 1e-7
SMALL_BUCKET = 32
BLOCK = 512

_N = max(MINIMA, BANDS * BAND_ROWS)
_A = (mix(np.arange(1, _N + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, _N + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def least_agreeing(similarity: float, miss: float = MISS) -> int:
    """The largest count that a pair of at least ``similarity`` stays below with probability under ``miss``.

    A b-bit minimum agrees with probability C + (1 - C) * similarity, C = 2**-b being chance
    agreement; this is the collision-corrected estimate solved for the count.
    """
    c = 2.0**-BITS
    p = c + (1 - c) * min(similarity, 1 - 1e-9)
    below = 0.0
    for k in range(MINIMA + 1):
        below += math.exp(_log_choose(MINIMA, k) + k * math.log(p) + (MINIMA - k) * math.log(1 - p))
        if below > miss:
            return k
    return MINIMA


def estimate(agreed: np.ndarray) -> np.ndarray:
    """Similarity estimated from counts of agreeing b-bit minima, chance agreement removed."""
    c = 2.0**-BITS
    return np.clip((agreed / MINIMA - c) / (1 - c), 0, 1)


def minima(doc: np.ndarray, h: np.ndarray, n_docs: int, count: int) -> np.ndarray:
    """(n_docs, count) minima of each text's shingle hashes; texts without any keep the maximum."""
    out = np.full((n_docs, count), np.iinfo(np.uint32).max, dtype=np.uint32)
    if len(h):
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        x = (h >> np.uint64(32)).astype(np.uint32)
        for i in range(count):
            out[doc[begins], i] = np.minimum.reduceat(x * _A[i] + _B[i], begins)
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """(n, MINIMA * BITS / 8) bytes: bit plane after bit plane of the retained bits.

    The bits come from a full mix of the minimum and its number. Those of the minimum itself are those
    of a linear hash: they depend on the lowest bits of a shingle alone, so that texts of few shingles
    would agree or differ in all their minima at once.
    """
    out = np.empty((len(mins), MINIMA * BITS // 8), dtype=np.uint8)
    number = np.arange(MINIMA, dtype=np.uint64) << np.uint64(32)
    for a in range(0, len(mins), 256):
        kept = mix(mins[a : a + 256] | number)
        planes = [np.packbits(((kept >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(BITS)]
        out[a : a + 256] = np.concatenate(planes, axis=1)
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of agreeing minima of packed signatures as 64-bit words: bits that differ in no plane."""
    x = a ^ b
    w = MINIMA // 64
    differ = x[..., :w]
    for p in range(1, BITS):
        differ = differ | x[..., p * w : (p + 1) * w]
    return MINIMA - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


_BANDED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set1", pa.int64()),
        ("set2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)
_BANDED_DDL = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"


def _bands(size: int):
    """Set size, 128 bits naming the set, and the band keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                doc, h = shingles(Words(part.column("text"), lower=True), size)
                counts = np.bincount(doc, minlength=n)
                ends = np.r_[0, np.cumsum(counts)]
                sums = [np.r_[np.uint64(0), np.cumsum(mix(h + np.uint64(k)))] for k in (1, 2)]
                set1, set2 = (mix(s[ends[1:]] - s[ends[:-1]]) for s in sums)
                mins = minima(doc, h, n, BANDS * BAND_ROWS).astype(np.uint64)
                keys = np.zeros((n, BANDS), dtype=np.uint64)
                for r in range(BAND_ROWS):
                    keys = mix(keys * np.uint64(3) + mins[:, r::BAND_ROWS] + np.uint64(1))
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                has = counts > 0
                spans = np.r_[0, np.cumsum(np.where(has, BANDS, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts.astype(np.int64)),
                        pa.array(signed(set1), mask=~has),
                        pa.array(signed(set2), mask=~has),
                        pa.ListArray.from_arrays(pa.array(spans), pa.array(signed(keys[has].ravel()))),
                    ],
                    schema=_BANDED,
                )

    return run


_SETS = pa.schema([("doc", pa.int64()), ("sig", pa.binary()), ("hashes", pa.binary())])


def _sets(size: int):
    """Packed b-bit signature and full shingle set (sorted 64-bit hashes) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", 1 << 19):
                n = part.num_rows
                doc, h = shingles(Words(unpack_texts(part.column("packed")), lower=True), size)
                cut = np.searchsorted(doc, np.arange(n + 1))
                packed = pack(minima(doc, h, n, MINIMA))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([p.tobytes() for p in packed], pa.binary()),
                        pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    ],
                    schema=_SETS,
                )

    return run


def _estimated(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""
    sig = signatures.select("doc", "sig")
    both = pairs.join(sig.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sig.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _unpacked(batch.column("sig_a")), _unpacked(batch.column("sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array(agreeing(x, y) >= least))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _within_blocks(members: DataFrame, least: int) -> DataFrame:
    """Agreeing pairs of different components inside large buckets, in blocks of signatures.

    A bucket of m members is cut into m / BLOCK blocks; each pair of blocks is one group, so no
    task holds the bucket and only pairs whose signatures agree leave it. A pair that shares
    several buckets leaves the first of them only, by the order of the bands.
    """
    cut = members.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("doc"), F.col("blocks").cast("long")).cast("int")
    )
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "doc", "component", "sig", "bands", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def run(table: pa.Table) -> pa.Table:
        ids, comp, own = (table.column(c).to_numpy() for c in ("doc", "component", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        key = table.column("key")[0].as_py()
        sig = _unpacked(table.column("sig"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(0, len(left), 16):
            rows = left[r : r + 16]
            hit = agreeing(sig[rows][:, None], sig[right][None]) >= least
            hit &= comp[rows][:, None] != comp[right][None]
            x, y = (rows_of[at] for rows_of, at in zip((rows, right), np.nonzero(hit)))
            first = np.argmax(bands[x] == bands[y], axis=1)
            here = bands[x, first] == key
            a.append(ids[x[here]])
            b.append(ids[y[here]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return spread.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full shingle sets have at least the similarity asked for."""
    percent = round(100 * similarity)
    left = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                shared = _shared(x, y)
                keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked if their sets of distinct ``shingle_words``-word shingles (A-Z lower-cased;
    a shorter text is one shingle) have ``similarity`` or more in common by Jaccard; a component
    is all that is connected by links, named by its lowest id, and that document is kept. Null and
    wordless texts have an empty set and stay alone. Ids are unique by contract; repeated rows come
    back repeated. Other columns of ``docs`` are not read, so their names can't clash. Rows with a
    null id are no documents and are left out.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(
        "doc_id is not null"
    )
    least = least_agreeing(similarity)
    banded = stored(plain.mapInArrow(_bands(shingle_words), _BANDED_DDL))
    filled = banded.where("set1 is not null")
    classes = stored(filled.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep")))

    # Members of buckets that hold two classes or more.
    reps = filled.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    members = reps.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("key")).distinct()
    full = stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(members.join(full, "key"))
    weights = stored(members.groupBy("doc").agg(F.sum("n").alias("weight")))
    texts = pack_texts(plain).join(weights.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(texts.dropDuplicates(["doc_id"]).mapInArrow(_sets(shingle_words), "doc long, sig binary, hashes binary"))

    hubs = stored(
        members.join(weights, "doc")
        .groupBy("key")
        .agg(F.max(F.struct("weight", F.negative("doc").alias("low"))).alias("top"))
        .select("key", F.negative("top.low").alias("b"))
    )
    to_hubs = members.select("key", F.col("doc").alias("a")).join(hubs, "key").where("a <> b").select("a", "b").distinct()
    likely = stored(_estimated(stored(to_hubs), sets, least))
    links = stored(_confirmed(likely, sets, similarity))
    labels = components(links)

    open_members = stored(
        members.join(labels.withColumnRenamed("id", "doc"), "doc", "left").select(
            "key", "n", "doc", F.coalesce("component", "doc").alias("component")
        )
    )
    open_keys = open_members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = stored(open_members.join(stored(open_keys.select("key")), "key", "left_semi"))
    small = rest.where(F.col("n") <= SMALL_BUCKET)
    left = small.select("key", F.col("doc").alias("a"), F.col("component").alias("ca"))
    right = small.select("key", F.col("doc").alias("b"), F.col("component").alias("cb"))
    crossing = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    bands = reps.select(F.col("doc_id").alias("doc"), "bands").dropDuplicates(["doc"])
    large = rest.where(F.col("n") > SMALL_BUCKET).join(sets.select("doc", "sig"), "doc").join(bands, "doc")
    tested = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _estimated(crossing, sets, least).union(_within_blocks(large, least)).distinct()
    further = stored(_confirmed(stored(more.join(tested, ["a", "b"], "left_anti")), sets, similarity))
    if further.limit(1).count():
        labels = components(links.union(further))

    named = classes.join(labels, F.col("rep") == F.col("id"), "left").select(
        "set1", "set2", F.coalesce("component", "rep").alias("component")
    )
    out = banded.select("doc_id", "n_shingles", "set1", "set2").join(stored(named), ["set1", "set2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but the lowest id of every component of near duplicates.

    Rows without an id are kept; of rows repeated with one id all stay or all go.
    """
    decided = near_duplicates(docs, shingle_words=shingle_words, similarity=similarity)
    gone = stored(decided.where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
