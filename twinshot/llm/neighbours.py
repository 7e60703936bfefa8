"""Nearest neighbours by inner product in vantage-point trees.

Vectors are dealt into shards by a hash of their id, and every shard is a vantage-point tree: a node
holds a vantage point, and its vectors are halved by their distance from it; the nearest and farthest
distance in either half are kept. With d the query's distance from the vantage point, no vector of a
half that spans distances lo to hi can be nearer to the query than max(lo - d, d - hi). A half is skipped
if ``factor`` times that bound is over the distance of the k-th best so far. Factor 1 skips only what
can't hold a neighbour, so the search is exact; larger factors skip more and may miss.

Inner products have no triangle inequality. Every vector of a shard gets one more coordinate that brings
it to the norm of the longest, and queries get 0 there: Euclidean distances then rank as inner products.

A shard is a group of bounded size, and so is a block of queries; a pair of the two is one task's work.
Within it queries go through the tree together: each first down to its own leaf, which gives it a bound,
then all through the tree, by matrix products of those that still need a leaf. Products only propose
candidates; the scores that count are sums in double precision over the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinshot.llm.store import stored

LEAF = 64
#: Bounds of a shard and of a block of queries; between them, so many shards that every core has several.
SHARD_ROWS = (4096, 65536)
QUERY_ROWS = 4096
#: Slack against rounding, relative to the norms: of a distance, and of a product.
SLACK = 1e-6
PRODUCT_SLACK = 1e-11
#: Numbers that a step holds at once.
_ROOM = 1 << 22


class Tree:
    """A vantage-point tree over the rows of a matrix, its nodes in preorder.

    ``order`` lists the rows leaf by leaf, ``begin:end`` is a node's part of it. ``point`` is the row of the
    vantage point, ``inner`` and ``outer`` the children (0 for a leaf), ``span`` their distances from it:
    least and greatest of the inner half, least and greatest of the outer one.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float64)
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.norm2 = float(squares.max())
        self.rest = np.sqrt(np.maximum(self.norm2 - squares, 0.0))
        self.order = np.arange(len(vectors))
        self.begin, self.end, self.point, self.inner, self.outer, self.span = [], [], [], [], [], []
        todo = [(0, len(vectors), -1, False)]
        while todo:
            a, b, above, is_outer = todo.pop()
            node = len(self.begin)
            if above >= 0:
                (self.outer if is_outer else self.inner)[above] = node
            self.begin.append(a)
            self.end.append(b)
            for column in (self.point, self.inner, self.outer):
                column.append(0)
            self.span.append((0.0, 0.0, 0.0, 0.0))
            if b - a > LEAF:
                rows = self.order[a:b]
                # The farthest from an arbitrary row lies at the rim, where distances spread most.
                point = rows[np.argmax(self._distances(rows[0], rows))]
                d = self._distances(point, rows)
                ranked = np.argsort(d, kind="stable")
                half = (b - a) // 2
                self.order[a:b] = rows[ranked]
                d = d[ranked]
                self.point[node], self.span[node] = int(point), (d[0], d[half - 1], d[half], d[-1])
                todo += [(a + half, b, node, True), (a, a + half, node, False)]

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        """Distances of rows from one row, in the lifted space."""
        products = self.vectors[rows] @ self.vectors[row] + self.rest[rows] * self.rest[row]
        return np.sqrt(np.maximum(2 * (self.norm2 - products), 0.0))

    def search(self, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best rows, leaving out those of its own id."""
        lengths = np.einsum("ij,ij->i", queries, queries)
        found = _Best(self.vectors, ids, queries, own, k, PRODUCT_SLACK * np.sqrt(lengths * self.norm2))
        slack = SLACK * math.sqrt(max(self.norm2, float(lengths.max(initial=0.0))))

        def from_point(node: int, at: np.ndarray) -> np.ndarray:
            products = queries[at] @ self.vectors[self.point[node]]
            return np.sqrt(np.maximum(lengths[at] + self.norm2 - 2 * products, 0.0))

        home = np.zeros(len(queries), dtype=np.int64)
        paths = [(0, np.arange(len(queries)))]
        while paths:
            node, at = paths.pop()
            if not len(at):
                continue
            if not self.inner[node]:
                home[at] = node
                found.add(at, self.order[self.begin[node] : self.end[node]])
                continue
            near = from_point(node, at) * 2 <= self.span[node][1] + self.span[node][2]
            paths += [(self.inner[node], at[near]), (self.outer[node], at[~near])]

        paths = [(0, np.arange(len(queries)))]
        while paths:
            node, at = paths.pop()
            if not self.inner[node]:
                at = at[home[at] != node]
                if len(at):
                    found.add(at, self.order[self.begin[node] : self.end[node]])
                continue
            d = from_point(node, at)
            for child, lo, hi in ((self.outer[node], *self.span[node][2:]), (self.inner[node], *self.span[node][:2])):
                reach = np.sqrt(np.maximum(lengths[at] + self.norm2 - 2 * found.bar[at], 0.0)) + slack
                kept = at[factor * np.maximum(lo - d, d - hi) <= reach]
                if len(kept):
                    paths.append((child, kept))
        return found.result()


class _Best:
    """The k best (score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, slack: np.ndarray):
        self.vectors, self.ids, self.queries, self.own, self.k, self.slack = vectors, ids, queries, own, k, slack
        self.repeated = len(np.unique(ids)) < len(ids)
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1, dtype=np.int64)
        #: The k-th best score: what a proposal must reach.
        self.bar = np.full(len(queries), -np.inf)

    def add(self, at: np.ndarray, rows: np.ndarray) -> None:
        # Products of a matrix may differ in their last bits from place to place, so they only propose.
        size = max(1, _ROOM // (len(rows) * self.vectors.shape[1]))
        for a in range(0, len(at), size):
            part = at[a : a + size]
            products = self.queries[part] @ self.vectors[rows].T
            proposed = products >= (self.bar[part] - self.slack[part])[:, None]
            proposed &= self.ids[rows][None, :] != self.own[part][:, None]
            i, j = np.nonzero(proposed)
            if len(i):
                self._merge(part, i, rows[j])

    def _merge(self, part: np.ndarray, i: np.ndarray, rows: np.ndarray) -> None:
        scores = exact(self.queries[part[i]], self.vectors[rows])
        hit, i = np.unique(i, return_inverse=True)
        at = part[hit]
        held, slot = np.nonzero(self.row[at] >= 0)
        q = np.r_[i, held]
        score = np.r_[scores, self.score[at[held], slot]]
        row = np.r_[rows, self.row[at[held], slot]]
        if self.repeated:  # of rows with one id the best counts
            order = np.lexsort((-score, self.ids[row], q))
            q, score, row = q[order], score[order], row[order]
            once = np.r_[True, (q[1:] != q[:-1]) | (self.ids[row[1:]] != self.ids[row[:-1]])]
            q, score, row = q[once], score[once], row[once]
        order = np.lexsort((self.ids[row], -score, q))
        q, score, row = q[order], score[order], row[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[at] = -np.inf
        self.row[at] = -1
        self.score[at[q[top]], place[top]] = score[top]
        self.row[at[q[top]], place[top]] = row[top]
        self.bar[at] = self.score[at, self.k - 1]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, slot = np.nonzero(self.row >= 0)
        return q, self.ids[self.row[q, slot]], self.score[q, slot]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, each summed in the order of its components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    factor: float = 1.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row that ``queries`` holds for.

    Nearest is the largest inner product in double precision, ties to the smaller id; rows of the query's own
    id are no candidates, and if there are fewer than ``k``, all are returned. A null, zero or not finite
    vector, or one without id, takes no part; vectors of another length than the query's are not compared
    with it. Of rows repeated with one id the nearest counts. ``queries`` is an expression over the id.
    With ``factor`` 1 the search is exact.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), queries.alias("_asked"))
    # The type stays that of the table: floats take half the room, and become doubles in the tasks.
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    sizes = stored(rows.groupBy("dim").agg(F.count("*").alias("_n"), F.count_if(F.coalesce("_asked", F.lit(False))).alias("_q")))
    if shard_rows is None:
        least, most = SHARD_ROWS
        wanted = F.ceil(F.col("_n") / F.lit(4 * spark.sparkContext.defaultParallelism))
        shard_rows = F.greatest(F.lit(least), F.least(F.lit(most), wanted))
    shards = F.ceil(F.col("_n") / shard_rows).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_q") / F.lit(query_rows))).cast("int")
    plan = sizes.select("dim", shards.alias("_shards"), blocks.alias("_blocks"))
    # As many rows as there are lengths of vectors, which are one or few; unhinted, as that is not proven.
    placed = rows.join(plan, "dim")

    def dealt(count: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(count).cast("long")).cast("int")

    indexed = placed.withColumn("shard", dealt("_shards", 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    asking = placed.where("_asked").withColumn("block", dealt("_blocks", 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    keys = ["dim", "shard", "block"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return schema.empty_table()
        ids, own = (t.column("vec_id").to_numpy() for t in (shard, block))
        tree = Tree(_matrix(shard.column("v")))
        q, found, score = tree.search(ids, _matrix(block.column("v")), own, k, factor)
        return pa.table({"query_id": own[q], "vec_id": found, "score": score}, schema=schema)

    found = (
        indexed.select(*keys, "vec_id", "v")
        .groupBy(*keys)
        .cogroup(asking.select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "v")]).groupBy(*keys))  # columns of its own
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    # Dealt out by query once, for the aggregate and for the ranks.
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
