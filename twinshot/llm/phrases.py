"""Collocations from suffix subtrees, partitioned vertically by memory budget.

The suffixes of all pieces, cut off at ``DEPTH`` words, form a tree; the number of suffixes below a node
is the number of occurrences of its phrase. The tree is never built as a whole. As in elastic-range suffix
tree construction it is partitioned by prefixes of variable length: a prefix that starts more suffixes
than the budget is extended by one word, until each of the rest (a stem) is within it. Stems are dealt
into as many groups as the budget asks for. A task sorts the suffixes of one group, that is, it lists the
leaves of its subtrees from left to right, and reads a node's count as the total of the leaves below it. The
few prefixes above the stems are counted by themselves.

A phrase with ``least`` occurrences has words, and pairs of neighbouring words, that occur as often, so a
suffix ends before its first rarer word or pair. Which these are is told by bit tables of fixed size, filled
by hashes of the words and pairs that are frequent enough: they may let rarer ones through, which costs
room and changes nothing. The budget grows
with the corpus once it would leave more than ``MOST_EXTENDED`` prefixes to extend, which bounds what is sent
out. Phrases themselves are never known by hashes alone: a block of suffixes carries its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinshot.llm.store import spread_lookup, stored
from twinshot.llm.words import _BYTE_BASE, _BYTE_VALUES, _span_hashes, mix, signed, slices

DEPTH = 5
BUDGET = 1 << 19
MOST_EXTENDED = 1 << 20
TABLE_BITS = 26
SLICE_BYTES = 4 << 20
PAIR_BITS = 40
_CHUNK_BITS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that end a piece, and bytes that end a word: those and blank and tab.
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True


class Pieces:
    """Lower-cased words of an Arrow column of texts, with the pieces they stand in.

    ``start``/``end`` are byte positions in ``data``; ``piece`` numbers pieces, so that words i and i + k
    stand in one piece if their numbers are equal. ``lang`` is the number of the word's language in ``langs``.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        lo, hi = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        body = texts.buffers()[2]
        self.data = _LOWER[np.frombuffer(body, dtype=np.uint8)[lo:hi]] if body is not None and hi > lo else np.zeros(0, np.uint8)
        offsets = offsets - lo
        inside = ~_ENDS_WORD[self.data]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cuts] = inside[cuts]
        ends[:-1] &= ~inside[1:]
        ends[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(offsets, self.start, "right") - 1
        # A text that ends where the next begins has no byte between them, so texts count as well.
        self.piece = np.cumsum(_ENDS_PIECE[self.data], dtype=np.int64)[self.start] + doc if len(self.start) else doc
        known = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs = known.dictionary.to_pylist()
        self.lang = known.indices.to_numpy(zero_copy_only=False).astype(np.int32)[doc] if n else np.zeros(0, np.int32)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word together with its language."""
        salt = np.array([hash_of(name) for name in self.langs] or [0], dtype=np.uint64)
        words = _span_hashes(lambda a, b: _BYTE_VALUES[self.data[a:b]], self.start, self.end, _BYTE_BASE)
        return mix(words ^ salt[self.lang])

    def strings(self, at: np.ndarray) -> list[bytes]:
        body = self.data.tobytes()
        return [body[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]


def hash_of(text: str) -> int:
    """A fixed 64-bit hash of a short string; Python's own differs from process to process."""
    h = 1
    for b in text.encode():
        h = (h * _BYTE_BASE + b) % (1 << 64)
    return int(mix(np.array([h], dtype=np.uint64))[0])


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix extended by one word."""
    return mix(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def _within(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            found = Pieces(part.column("text"), part.column("lang"))
            if len(found.start):
                yield found


def _counted(rows: DataFrame, prefixes) -> DataFrame:
    """(h, n) of the hashes that ``prefixes`` gives for the pieces of every batch, counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _pieces(batches):
            h, n = np.unique(prefixes(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["h", "n"])

    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _table(frequent: DataFrame) -> np.ndarray:
    """Bit table of 2**TABLE_BITS bits holding the hashes of ``frequent`` (h); its size is fixed."""
    mask = (1 << TABLE_BITS) - 1
    spots = frequent.select(F.col("h").bitwiseAND(mask).alias("spot")).distinct()
    chunks = spots.select((F.shiftright("spot", _CHUNK_BITS)).cast("int").alias("chunk"), F.col("spot").bitwiseAND((1 << _CHUNK_BITS) - 1).alias("at"))

    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK_BITS, dtype=np.uint8)
        bits[table.column("at").to_numpy()] = 1
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    size = 1 << (_CHUNK_BITS - 3)
    for row in chunks.groupBy("chunk").applyInArrow(packed, "chunk int, bits binary").collect():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _listed(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    spot = h & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(spot >> np.uint64(3)).astype(np.int64)] >> (7 - (spot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    """PAIR_BITS bits of every two neighbouring words; equal ones of different pairs only make a table fuller."""
    return _longer(h[:-1], h[1:]) >> np.uint64(64 - PAIR_BITS)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of ``width`` bytes, all their lowest bytes first: equal high bytes pack well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(body: bytes, n: int, width: int, offset: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(body, dtype=np.uint8, count=n * width, offset=offset).reshape(width, n).T
    return out.view("<u8").ravel(), offset + n * width


_PAIRS = pa.schema([("grp", pa.int64()), ("block", pa.binary())])


def _frequent_pairs(rows: DataFrame, table: np.ndarray, groups: int, least: int) -> DataFrame:
    """(h) of the pairs of listed words with ``least`` occurrences, counted in blocks by range of their hash."""
    width = (PAIR_BITS + 7) // 8

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for found in _pieces(batches):
            h = found.hashes()
            listed = _listed(table, h)
            both = listed[:-1] & listed[1:] & (found.piece[:-1] == found.piece[1:])
            keys, count = np.unique(_pair_hashes(h)[both], return_counts=True)
            group = (keys * np.uint64(groups)) >> np.uint64(PAIR_BITS) if groups < 1 << 24 else keys % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            keys, count, group = keys[order], count[order], group[order]
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, int)
            out = [
                squeeze.compress(_planes(np.diff(keys[a:b], prepend=np.uint64(0)), width) + _planes(count[a:b], 4))
                for a, b in zip(cuts, cuts[1:])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]].astype(np.int64)), pa.array(out, pa.binary())], schema=_PAIRS)

    def counted(block: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        keys, counts = [], []
        for blob in block.column("block").to_pylist():
            body = expand.decompress(blob)
            n = len(body) // (width + 4)
            steps, at = _unplaned(body, n, width, 0)
            keys.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(_unplaned(body, n, 4, at)[0].astype(np.int64))
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate(counts), len(key))
        return pa.table({"h": pa.array(signed(key[n >= least]))})

    return rows.mapInArrow(blocks, "grp long, block binary").groupBy("grp").applyInArrow(counted, "h long")


class _Suffixes:
    """Suffixes of the pieces' words, cut off at ``DEPTH`` words and before the first unlisted word or pair.

    ``length`` is the number of words of the suffix that begins at each word, 0 for an unlisted one.
    ``stem`` is the number of words of its stem (0: none, as the suffix ends among the extended prefixes)
    and ``key`` the stem's hash.
    """

    def __init__(self, found: Pieces, tables: tuple[np.ndarray, np.ndarray], extended: list[np.ndarray]):
        h = found.hashes()
        n = len(h)
        listed = _listed(tables[0], h)
        joined = listed[:-1] & listed[1:] & (found.piece[1:] == found.piece[:-1])
        joined &= _listed(tables[1], _pair_hashes(h))
        self.length = listed.astype(np.int8)
        going = listed.copy()
        for k in range(1, DEPTH):
            m = max(n - k, 0)
            going[m:] = False
            going[:m] &= joined[k - 1 :]
            self.length += going
        self.h = h
        self.stem = np.zeros(n, dtype=np.int8)
        self.key = h.copy()
        open_ = self.length > 0
        for k in range(1, DEPTH + 1):
            if k > 1:
                open_ = open_ & (self.length >= k)
                at = np.flatnonzero(open_)
                self.key[at] = _longer(self.key[at], h[at + k - 1])
            heavy = np.zeros(n, dtype=bool)
            if k < DEPTH and k <= len(extended) and len(extended[k - 1]):
                at = np.flatnonzero(open_)
                heavy[at] = _within(extended[k - 1], self.key[at])
            self.stem[open_ & ~heavy] = k
            open_ = open_ & heavy
            if not open_.any():
                break


_PARTS = pa.schema([("lang", pa.string()), ("grp", pa.int64()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.binary())])
_PARTS_DDL = "lang string, grp long, phrase string, n long, block binary"


def _parts(tables: tuple[np.ndarray, np.ndarray], extended: list[np.ndarray], groups: int):
    """Blocks of sorted, counted suffixes by group; counts of all words (no phrase) and of extended prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for found in _pieces(batches):
            s = _Suffixes(found, tables, extended)
            here = int(s.h[0] % np.uint64(groups))  # sums of a batch may go to any group
            sizes = np.bincount(found.lang, minlength=len(found.langs)).tolist()
            out = [(name, here, None, n, None) for name, n in zip(found.langs, sizes) if n]
            listed = np.flatnonzero(s.length > 0)
            if len(listed):
                _, first, code_of = np.unique(s.h[listed], return_index=True, return_inverse=True)
                # Hashes name words within this batch only if no two words share one; else the words do.
                names = found.strings(listed[first])
                if not _same_words(found, listed, code_of, first):
                    names, code_of = _by_word(found, listed)
                code = np.full(len(s.h), -1, dtype=np.int64)
                code[listed] = code_of
                out += _heavy(found, s, names, code, here) + _blocks(found, s, names, code, groups, squeeze)
            yield _batch(out)

    return run


def _same_words(found: Pieces, listed: np.ndarray, code: np.ndarray, first: np.ndarray) -> bool:
    """Whether all words of a code are the same bytes in the same language."""
    model = listed[first][code]
    size = found.end[listed] - found.start[listed]
    if not np.array_equal(size, found.end[model] - found.start[model]) or not np.array_equal(found.lang[listed], found.lang[model]):
        return False
    for k in range(int(size.max())):
        on = size > k
        if not on.all():
            listed, model, size = listed[on], model[on], size[on]
        if not np.array_equal(found.data[found.start[listed] + k], found.data[found.start[model] + k]):
            return False
    return True


def _by_word(found: Pieces, listed: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    known: dict[tuple[int, bytes], int] = {}
    code = [known.setdefault(w, len(known)) for w in zip(found.lang[listed].tolist(), found.strings(listed))]
    return [w for _, w in known], np.array(code, dtype=np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_PARTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def _codes(s: _Suffixes, at: np.ndarray, code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(DEPTH, n) word codes of the prefixes of given lengths at given words; -1 beyond them."""
    out = np.full((DEPTH, len(at)), -1, dtype=np.int32)
    for k in range(DEPTH):
        on = length > k
        out[k, on] = code[at[on] + k]
    return out


def _sorted_counts(codes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns in order, their summed counts, and where each was first among the sorted ones."""
    order = np.lexsort(codes[::-1])
    codes, count = codes[:, order], count[order]
    new = np.ones(codes.shape[1], dtype=bool)
    new[1:] = (codes[:, 1:] != codes[:, :-1]).any(axis=0)
    begins = np.flatnonzero(new)
    return codes[:, begins], np.add.reduceat(count, begins), order[begins]


def _heavy(found: Pieces, s: _Suffixes, names: list[bytes], code: np.ndarray, group: int) -> list[tuple]:
    """Counts of the extended prefixes."""
    out = []
    for k in range(1, DEPTH):
        # The prefix of k words is extended if the stem is longer, or if the suffix ends without one.
        at = np.flatnonzero((s.length >= k) & ((s.stem > k) | (s.stem == 0)))
        if len(at):
            codes, count, first = _sorted_counts(_codes(s, at, code, np.full(len(at), k)), np.ones(len(at), dtype=np.int64))
            for c, n, f in zip(codes[:k].T.tolist(), count.tolist(), first.tolist()):
                out.append((found.langs[found.lang[at[f]]], group, b" ".join(names[i] for i in c).decode(), n, None))
    return out


def _blocks(found: Pieces, s: _Suffixes, names: list[bytes], code: np.ndarray, groups: int, squeeze) -> list[tuple]:
    """One block for every group: its words, its distinct suffixes as places in that list, counts and stems."""
    at = np.flatnonzero(s.stem > 0)
    if not len(at):
        return []
    group = (s.key[at] % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((found.lang[at], group))
    at, group = at[order], group[order]
    lang = found.lang[at]
    cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (lang[1:] != lang[:-1]), True])
    out = []
    for a, b in zip(cuts, cuts[1:]):
        rows = at[a:b]
        codes, count, first = _sorted_counts(_codes(s, rows, code, s.length[rows]), np.ones(len(rows), dtype=np.int64))
        used, local = np.unique(codes, return_inverse=True)
        local = local.reshape(codes.shape) + (used[0] != -1)  # 0: no word
        used = used[used >= 0].tolist()
        words = sorted((names[i], k) for k, i in enumerate(used, 1))  # like words side by side pack well
        moved = np.zeros(len(used) + 1, dtype=np.int64)
        moved[[k for _, k in words]] = np.arange(1, len(used) + 1)
        listing = b"\n".join(w for w, _ in words)
        width = 2 if len(used) < 1 << 16 else 4
        head = np.array([len(listing), codes.shape[1], width], dtype=np.int64).tobytes()
        columns = b"".join(_planes(moved[c], width) for c in local)
        body = b"".join([head, listing, columns, _planes(count, 4), s.stem[rows[first]].tobytes()])
        out.append((found.langs[lang[a]], int(group[a]), None, None, squeeze.compress(body)))
    return out


def _subtrees(least: int):
    """(lang, phrase, f): nodes of the subtrees of one group and language, and sums of what else came along."""

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        parts = []
        blocks = table.column("block")
        for blob in blocks.drop_null().to_pylist():
            body = expand.decompress(blob)
            size, n, width = np.frombuffer(body, dtype=np.int64, count=3).tolist()
            words = body[24 : 24 + size].split(b"\n")
            place = np.array([-1] + [known.setdefault(w, len(known)) for w in words], dtype=np.int32)
            codes, at = np.empty((DEPTH, n), dtype=np.int32), 24 + size
            for k in range(DEPTH):
                local, at = _unplaned(body, n, width, at)
                codes[k] = place[local.astype(np.int64)]
            count, at = _unplaned(body, n, 4, at)
            parts.append((codes, count.astype(np.int64), np.frombuffer(body, dtype=np.int8, count=n, offset=at)))
        phrases: list[str | None] = []
        totals: list[int] = []
        if parts:
            codes, count, stem = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
            parts.clear()
            # The leaves of the group's subtrees from left to right, each with its total.
            codes, count, first = _sorted_counts(codes, count)
            stem = stem[first]
            names = list(known)
            new = np.zeros(codes.shape[1], dtype=bool)
            new[0] = True
            for k in range(1, DEPTH + 1):
                new[1:] |= codes[k - 1, 1:] != codes[k - 1, :-1]
                begins = np.flatnonzero(new)
                total = np.add.reduceat(count, begins)
                # Nodes above the stem have leaves in other groups; they are counted by themselves.
                kept = (total >= least) & (codes[k - 1, begins] >= 0) & (stem[begins] <= k)
                phrases += [b" ".join(names[i] for i in c).decode() for c in codes[:k, begins[kept]].T.tolist()]
                totals += total[kept].tolist()
        sums = table.filter(pc.is_null(blocks)).select(["phrase", "n"]).group_by("phrase").aggregate([("n", "sum")])
        phrases += sums.column("phrase").to_pylist()
        totals += sums.column("n_sum").to_pylist()
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(totals, pa.int64())})

    return run


def phrase_counts(
    docs: DataFrame, least: int = 100, text: str = "text", lang: str = "lang", budget: int = BUDGET
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the phrases of 1 to 5 words with ``least`` occurrences, and (lang, n) of all words.

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?]`` and line ends, pieces into words at
    blanks and tabs; a phrase lies within a piece, its words joined by one blank, and overlapping
    occurrences count. A null text has no words, a null language is ``und``. Only the two columns are read.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))

    words = stored(_counted(rows, lambda found: found.hashes()))
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // MOST_EXTENDED))
    groups = int(max(1, -(-2 * total // budget)))
    listed = _table(words.where(F.col("n") >= least))
    tables = listed, _table(_frequent_pairs(rows, listed, groups, least))

    def over(counts: DataFrame) -> np.ndarray:
        """Sorted hashes of the prefixes over budget: at most MOST_EXTENDED, since each has a budget's share of the words."""
        return np.sort(np.array([r["h"] for r in counts.where(F.col("n") > budget).select("h").collect()], dtype=np.int64).view(np.uint64))

    extended = [over(words)]
    while len(extended[-1]) and len(extended) < DEPTH - 1:
        k = len(extended) + 1

        def prefixes(found: Pieces, extended=tuple(extended), k=k) -> np.ndarray:
            s = _Suffixes(found, tables, list(extended))
            return s.key[s.stem == k]

        extended.append(over(_counted(rows, prefixes)))
    # Every row moves once: blocks to their groups, sums of a batch to any.
    parts = rows.mapInArrow(_parts(tables, extended, groups), _PARTS_DDL)
    nodes = stored(parts.groupBy("lang", "grp").applyInArrow(_subtrees(least), "lang string, phrase string, f long"))
    counts = nodes.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return stored(counts), nodes.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", budget: int = BUDGET
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to 5 words of every language.

    ``a`` is the phrase's count, ``n`` the language's words. Cut after its first k words, a phrase scores
    floor(1000 * a * n / (l * r)), l and r being the counts of its two parts; the cut of the lowest score
    counts, of equal ones the first. A phrase is left out if a longer one around it is as frequent. Ranks
    are by score, then a, descending, then by phrase in byte order. Products are decimals of 38 digits: exact
    up to 10**17 words in a language, an error beyond.
    """
    counts, sizes = phrase_counts(docs, least, text, lang, budget)
    words = F.split("phrase", " ")
    listed = stored(counts.withColumn("m", F.size(words)))
    phrases = listed.where("m > 1")

    # Around a phrase there is a longer one as frequent just if there is one longer by a single word.
    shorter = F.array(F.array_join(F.slice(words, F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("m") - 1), " "))
    covered = listed.where("m > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("f")).distinct()
    kept = phrases.join(covered, ["lang", "phrase", "f"], "left_anti")

    part = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    k = F.col("k")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), k).alias("first"), part(k + 1, F.col("m") - k).alias("rest")
    )
    known = listed.select("lang", "phrase", "f")
    for side, name in (("first", "l"), ("rest", "r")):
        cut = spread_lookup(cut, known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], F.col("phrase"))
    sized = spread_lookup(cut, sizes, ["lang"], F.col("phrase"))
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = (
        sized.withColumn("score", score.cast("long"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
        .select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    )
    return ranked(best, top)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of every language with their rank; parts of a language are cut to as many first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]

    def best(by: list[str], df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)

    parts = best(["lang", "_part"], rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))))
    out = best(["lang"], parts.drop("rank", "_part"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
