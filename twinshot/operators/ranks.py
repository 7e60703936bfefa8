"""Exact order statistics of groups of any size, by selection.

Spark's exact ``percentile`` and an unpartitioned window keep a whole group in one task. Here nothing is
sorted as a whole and no value is moved but those near a wanted rank: a group is cut into buckets by a sketch
of its values, buckets are counted (partial sums move, not rows), and only buckets that hold a wanted rank
and more than one value are looked into again, until they are small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinshot.operators.keys import join_groups, materialise

# Levels of the binary search below: 2 ** 10 - 1 bounds per bucket that is cut.
_STEPS = [2**i for i in range(9, -1, -1)]
_BOUNDS = 2**10 - 1
#: Codes of a bucket's parts: between two bounds, or equal to one.
_CODES = 2**11
#: Rows of a bucket that are ranked by a sort.
SMALL = 1_000_000


def _bucket(bounds: Column, value: Column) -> Column:
    """Twice the number of the sorted bounds below the value, plus one if it equals the next.

    So a value with a noticeable share of the rows, which is a bound, has a bucket for itself.
    """
    steps = F.array(*[F.lit(s) for s in _STEPS])
    below = F.aggregate(
        steps, F.lit(0), lambda at, s: at + F.when(F.get(bounds, at + s - 1) < value, s).otherwise(F.lit(0))
    )
    return F.transform(F.array(below), lambda b: 2 * b + F.coalesce(F.get(bounds, b) == value, F.lit(False)).cast("int"))[0]


def select_ranks(df: DataFrame, value: str, by: list[str], wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(by..., k, n, value): the value at rank k, from 1, of n in its group.

    ``wanted`` turns the groups (by..., n) into the ranks asked for (by..., n, k). NULL values have no
    rank; NULL is a group. ``df`` is read twice before rows are few, so give a stored table if it is costly.
    """
    cell = [*by, "_cell"]
    part = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.lit(0).cast("long").alias("_cell"))
    want, found = None, []
    probs = [i / (_BOUNDS + 1) for i in range(1, _BOUNDS + 1)]
    while True:
        bounds = part.groupBy(*cell).agg(F.percentile_approx("_v", probs, 10_000).alias("_bounds"))
        placed = join_groups(part, bounds, cell).withColumn("_b", _bucket(F.col("_bounds"), F.col("_v"))).drop("_bounds")
        below = Window.partitionBy(*cell).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sizes = placed.groupBy(*cell, "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        sizes = materialise(sizes).withColumn("_off", F.coalesce(F.sum("_c").over(below), F.lit(0)))
        if want is None:
            want = wanted(sizes.groupBy(*by).agg(F.sum("_c").alias("n"))).distinct().select(*by, "n", "k", F.lit(0).cast("long").alias("_cell"), F.col("k").alias("_left"))
        at = join_groups(want, sizes, cell).where("_off < _left and _left <= _off + _c")
        at = materialise(at.withColumn("_left", F.col("_left") - F.col("_off")).drop("_off"))
        found.append(at.where("_lo = _hi").select(*by, "k", "n", F.col("_lo").alias(value)))
        open_ = at.where("_lo < _hi")
        largest = open_.agg(F.max("_c")).first()[0]
        if largest is None:
            break
        inner = (F.col("_cell") * _CODES + F.col("_b")).alias("_cell")
        part = materialise(join_groups(placed, open_.select(*cell, "_b").distinct(), [*cell, "_b"], "left_semi").select(*by, "_v", inner))
        want = open_.select(*by, "n", "k", inner, "_left")
        if largest <= SMALL:
            ranked = part.withColumn("_left", F.row_number().over(Window.partitionBy(*cell).orderBy("_v")).cast("long"))
            found.append(join_groups(ranked, want, [*cell, "_left"]).select(*by, "k", "n", F.col("_v").alias(value)))
            break
    return reduce(DataFrame.union, found)


def exact_percentiles(df: DataFrame, value: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation: ``by..., n`` and one column per name."""
    position = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ends = {name: (F.floor(pos) + 1, F.ceil(pos) + 1) for name, pos in position.items()}

    def wanted(groups: DataFrame) -> DataFrame:
        return groups.withColumn("k", F.explode(F.array(*[k for pair in ends.values() for k in pair])))

    ranks = select_ranks(df, value, by, wanted)
    picked = [F.max(F.when(F.col("k") == k, F.col(value))) for pair in ends.values() for k in pair]
    flat = ranks.groupBy(*by, "n").agg(*[p.alias(f"_v{i}") for i, p in enumerate(picked)])
    out = []
    for i, (name, pos) in enumerate(position.items()):
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return flat.select(*by, "n", *out)
