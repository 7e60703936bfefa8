"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item's set of distinct word shingles is contained in a document if the document has at least
``containment`` of it. A document may be thousands of times longer than an item, so their Jaccard
similarity says nothing, and a signature of the document could not find it. The search therefore
keeps minima of the items only and looks them up among all shingles of a document. Items are
partitioned by set size, in classes that double. Items of a class may miss at most as many
shingles as its largest size allows, and their sketches hold that number + 1 + ``EXTRA`` smallest hashes
(a bottom-k MinHash whose length the class sets). A document that contains an item of q shingles has
all but m = q - ceil(containment * q) of them, that is at least size(sketch) - m of the sketch: none is missed,
at any length. Candidates are then verified on the full sets of exact shingle hashes.

How the work is spread. Sketches and sets of the distinct item texts are computed in tasks and stored.
The items' hashes fill a bit table of fixed size, which goes to every task; one pass over the documents
leaves of each those of its distinct shingles that the table lists, and no row of the ones that have
none. What is left is stored and joined to the sketches, class by class, by hash. A class goes to every
task if it has been counted to hold at most ``CLASS_ROWS`` hashes, otherwise both sides are shuffled.
Documents with one text are compared once, named by 128 bits of hash, and a text's verdict is joined back
to its rows in parts, so that no group of copies is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinshot.llm.phrases import _listed, _table
from twinshot.llm.store import spread_lookup, stored
from twinshot.llm.words import Words, ngram_hashes, shingles, signed, slices

EXTRA = 7
#: Hashes of a class of sketches, or rows of a table of verdicts, that are sent to every task (16 MB of hashes and names
#: each); larger ones are shuffled.
CLASS_ROWS = 1 << 19
TEXT = ["text_a", "text_b"]
ITEM = ["item_a", "item_b"]


def _names(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _named(text: Column, names: list[str]) -> list[Column]:
    return [text.alias("text"), *(c.alias(n) for c, n in zip(_names(text), names))]


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its n shingles an item may miss: n - ceil(containment * n)."""
    return n - -(-percent * n // 100)


def _lists(values: np.ndarray, of: np.ndarray, rows: int) -> pa.Array:
    """Values, ordered by row, as one list per row."""
    offsets = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values)))


def item_sets(items: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(item_a, item_b, words, size_class, n, need, hits, sketch, grams) of each row of ``items`` (item_a, item_b, text).

    ``grams`` is the item's set, ``sketch`` its minima; a document must have ``hits`` of the sketch to be a
    candidate and ``need`` of the set to contain the item. Wordless items are left out. An item
    with fewer words than a shingle is one shorter run of ``words`` words.
    """
    fields = [("words", pa.int32()), ("size_class", pa.int32()), ("n", pa.int64()), ("need", pa.int64()), ("hits", pa.int64())]
    lists = [("sketch", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))]
    schema = pa.schema([*((c, pa.int64()) for c in ITEM), *fields, *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=True)
                rows = part.num_rows
                item, h = shingles(words, shingle_words)
                n = np.bincount(item, minlength=rows).astype(np.int64)
                size_class = np.frexp(n)[1].astype(np.int32)  # n.bit_length()
                largest = (1 << size_class.astype(np.int64)) - 1
                length = np.minimum(n, missing(largest, percent) + 1 + EXTRA)
                # Rows of a set are sorted by hash: its first ones are its minima.
                own = np.arange(len(h)) - np.searchsorted(item, np.arange(rows))[item] < length[item]
                columns = [
                    np.minimum(words.counts, shingle_words).astype(np.int32),
                    size_class,
                    n,
                    n - missing(n, percent),
                    length - missing(n, percent),
                ]
                out = [part.column(c) for c in ITEM] + [pa.array(c) for c in columns]
                out += [_lists(h[own], item[own], rows), _lists(h, item, rows)]
                yield pa.RecordBatch.from_arrays(out, schema=schema).filter(pa.array(n > 0))

    ddl = "item_a long, item_b long, words int, size_class int, n long, need long, hits long, sketch array<long>, grams array<long>"
    return items.select(*ITEM, "text").mapInArrow(run, ddl)


def _document_sets(words: Words, size: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of distinct shingles, with the shorter runs that some items are."""
    doc, h = shingles(words, size)
    if not short:
        return doc, h
    w = words.hashes()
    docs, hashes = [doc], [h]
    for n in short:
        g = ngram_hashes(w, n)
        at = np.arange(len(g))
        of = words.doc_of(at)
        fits = at + n <= words.first[of + 1] if len(at) else np.zeros(0, bool)
        docs.append(of[fits])
        hashes.append(g[fits])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def _listed_shingles(docs: DataFrame, table: np.ndarray, size: int, short: list[int]) -> DataFrame:
    """``docs`` (text, others) without the text, with ``listed``: its distinct shingles in the table; rows with none go."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in docs.columns if c != "text"]
    schema = pa.schema([*((c, pa.int64()) for c in kept), ("listed", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, h = _document_sets(Words(part.column("text"), lower=True), size, short)
                own = _listed(shared.value, h)
                doc, h = doc[own], h[own]
                lists = _lists(h, doc, part.num_rows)
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], schema=schema)
                yield out.filter(pa.array(np.bincount(doc, minlength=part.num_rows) > 0))

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in kept) + ", listed array<long>")


def _sent(table: DataFrame, rows: int) -> DataFrame:
    """``table``, marked to be sent to every task if it has been counted to be small."""
    return F.broadcast(table) if rows <= CLASS_ROWS else table


def _verified(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(text_a, text_b, item_a, item_b, n, n_shared) of every text (text_a, text_b, listed) and item it contains."""
    classes = sets.groupBy("size_class").agg(F.sum(F.size("sketch")).alias("rows")).collect()  # one row per class: 63 at most
    probes = texts.select(*TEXT, F.explode("listed").alias("h"))
    found = []
    for c in sorted(classes, key=lambda r: r["size_class"]):
        sketches = sets.where(F.col("size_class") == c["size_class"]).select(*ITEM, "hits", F.explode("sketch").alias("h"))
        met = probes.join(_sent(sketches, c["rows"]), "h").groupBy(*TEXT, *ITEM, "hits").agg(F.count("*").alias("met"))
        found.append(met.where("met >= hits").select(*TEXT, *ITEM))
    if not found:
        return texts.select(*TEXT, *(F.lit(0).cast("long").alias(c) for c in [*ITEM, "n", "n_shared"])).limit(0)
    candidates = found[0]
    for f in found[1:]:
        candidates = candidates.unionByName(f)
    grams = sum(c["rows"] for c in classes)
    full = _sent(sets.select(*ITEM, "n", "need", "grams"), 4 * grams)
    both = stored(candidates).join(full, ITEM).join(texts, TEXT)
    both = both.withColumn("n_shared", F.size(F.array_intersect("listed", "grams")).cast("long"))
    return both.where("n_shared >= need").select(*TEXT, *ITEM, "n", "n_shared")


def _search(docs: DataFrame, items: DataFrame, shingle_words: int, containment: float) -> tuple[DataFrame, DataFrame]:
    """(rows that share a shingle with an item: the columns of ``docs`` without the text, and ``_verified``).

    ``docs`` has text, text_a, text_b and other long columns, ``items`` item_a, item_b and text.
    """
    percent = round(100 * containment)
    sets = stored(item_sets(items.dropDuplicates(ITEM), shingle_words, percent))
    short = sorted(r["words"] for r in sets.where(F.col("words") < shingle_words).select("words").distinct().collect())
    table = _table(sets.select(F.explode("grams").alias("h")))
    listed = stored(_listed_shingles(docs, table, shingle_words, short))
    texts = stored(listed.groupBy(*TEXT).agg(F.first("listed").alias("listed")))
    return listed.drop("listed"), stored(_verified(texts, sets))


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), *_named(F.col(text).cast("string"), ITEM))
    return rows.where("item_id is not null and text is not null")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle_words: int = 5,
    containment: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document and item it contains.

    Shingles are runs of ``shingle_words`` words, A-Z lower-cased; an item with fewer words is one
    shorter run, looked for in the same way. Null, empty and wordless texts contain nothing and are
    contained nowhere. Rows without an id are left out; a repeated row gives repeated pairs. Other
    columns are not read. An empty table of items or documents gives an empty result. The search
    runs when this is called and its results are stored.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *_named(F.col(text).cast("string"), TEXT))
    rows = _items(items, item_id, item_text)
    listed, found = _search(plain.where("doc_id is not null"), rows, shingle_words, containment)
    # One row per text, with all that it contains; then its documents, and the items' ids of each item text.
    of_text = found.groupBy(*TEXT).agg(F.collect_list(F.struct(*ITEM, "n", "n_shared")).alias("found"))
    pairs = spread_lookup(listed, of_text, TEXT, F.col("doc_id")).select("doc_id", F.inline("found"))
    return pairs.join(rows.select("item_id", *ITEM), ITEM).select(
        "doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")
    )


def decontaminated(
    docs: DataFrame, items: DataFrame, shingle_words: int = 5, containment: float = 0.8
) -> DataFrame:
    """``docs`` without the rows whose ``text`` contains a benchmark item; all columns stay.

    The same search as ``contained_items``. The names of the texts to go are sent to every task if
    they are few, and no document is moved; otherwise documents are joined to them by name.
    """
    body = F.col("text").cast("string")
    _, found = _search(docs.select(*_named(body, TEXT)), _items(items, "item_id", "text"), shingle_words, containment)
    gone = stored(found.select(*(F.col(c).alias(f"_gone_{c}") for c in TEXT)).distinct())
    same = [name == F.col(f"_gone_{c}") for name, c in zip(_names(body), TEXT)]
    return docs.join(_sent(gone, gone.count()), same, "left_anti")
