"""Cohorts of pairs: labels, duplicates, matched and random samples, long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinshot.functions.scalar import bin_index, md5_int, rel_diff, sample_group

PAIR_KEYS = ["t1_shot_number", "t2_shot_number"]
MATCH_EDGES = list(range(0, 1200, 60))

_COARSE_BITS = 12


def label_groups(overlaid: DataFrame) -> DataFrame:
    """Adds ``sample_grp``: treatment, control or NULL."""
    return overlaid.withColumn("sample_grp", sample_group())


def dedup_pairs(df: DataFrame, by: str | None = "sample_grp") -> DataFrame:
    """Keep the first pair of each t1 shot, then the first of each t2 shot among those.

    First means the lowest id of the other shot. Works per group; rows without a group are
    dropped. A pair that occurs more than once, say in overlapping tiles, gives one row: the
    least one by the columns of simple type, taken in order. Both steps are minimum aggregates
    over the keys, so a shot with very many pairs is combined before the shuffle, and wide rows
    move only if their pair is kept. The input is read twice: pass a stored table
    (``materialise``) rather than a long plan.
    """
    grp = [by] if by else []
    rows = df.where(F.col(by).isNotNull()) if by else df
    first_t1 = rows.groupBy(*grp, "t1_shot_number").agg(F.min("t2_shot_number").alias("t2_shot_number"))
    kept = first_t1.groupBy(*grp, "t2_shot_number").agg(F.min("t1_shot_number").alias("t1_shot_number"))
    chosen = rows.join(kept, [*grp, *PAIR_KEYS], "left_semi")
    keys = [*grp, *PAIR_KEYS]
    ordered = [c for c, t in df.dtypes if c not in keys and not t.startswith(("map", "variant"))]
    last = [c for c in df.columns if c not in keys and c not in ordered]
    one = chosen.groupBy(*keys).agg(F.min_by(F.struct(*ordered, *last), F.struct(*ordered)).alias("_row")) if ordered else chosen.distinct()
    return one.select(*keys, *(["_row.*"] if ordered else [])).select(*df.columns)


def duplicate_counts(df: DataFrame, by: str = "sample_grp") -> DataFrame:
    """Rows beyond the first per t1 and per t2 shot, by group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count_distinct("t1_shot_number")).alias("s1_duplicates"),
        (F.count("*") - F.count_distinct("t2_shot_number")).alias("s2_duplicates"),
    )


def group_counts(df: DataFrame, by: str = "sample_grp") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def _priority(keys: list[str], hash: str, digits: int) -> Column:
    if hash == "md5":
        return md5_int(*[F.col(k) for k in keys], digits=digits)
    return F.xxhash64(*keys).bitwiseAND(2 ** (4 * digits) - 1)


def match_strata(
    df: DataFrame,
    col: str = "time_diff",
    edges: list[int] = MATCH_EDGES,
    both: bool = False,
    group: str = "sample_grp",
    keys: list[str] = PAIR_KEYS,
    hash: str = "xxhash64",
) -> DataFrame:
    """Sample controls per bin of ``col`` down to the number of treatments in the bin.

    With ``both`` treatments are cut to the number of controls as well, and rows outside
    all bins vanish; otherwise every treatment stays. The sample is the rows of lowest key
    hash (``md5`` is portable, ``xxhash64`` fast) and hence reproducible.

    A few bins hold all rows, so no bin is ever ranked as a whole: a histogram of the
    hash's leading bits locates the cut of each bin, rows below it pass without a shuffle, and
    only the slice at the cut, one of 4096 per bin, is ranked. The input is read three times: pass
    a stored table.
    """
    digits = 15
    prepared = df.withColumn("_bin", bin_index(F.col(col), edges)).withColumn("_prio", _priority(keys, hash, digits))
    prepared = prepared.withColumn("_coarse", F.shiftright("_prio", 4 * digits - _COARSE_BITS))
    binned = prepared.where(F.col("_bin").isNotNull() & F.col(group).isin("control", "treatment"))
    hist = binned.groupBy("_bin", group, "_coarse").agg(F.count("*").alias("_cnt"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(group) == name, F.col("_cnt"))).over(Window.partitionBy("_bin")), F.lit(0))

    smaller = F.least("_nc", "_nt")
    quota = smaller if both else F.when(F.col(group) == "treatment", F.col("_nt")).otherwise(smaller)
    run = Window.partitionBy("_bin", group).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        hist.withColumn("_nc", total("control"))
        .withColumn("_nt", total("treatment"))
        .withColumn("_quota", quota)
        .withColumn("_run", F.sum("_cnt").over(run))
        .where((F.col("_run") >= F.col("_quota")) & (F.col("_run") - F.col("_cnt") < F.col("_quota")))
        .select("_bin", group, F.col("_coarse").alias("_cut"), (F.col("_quota") - F.col("_run") + F.col("_cnt")).alias("_rest"))
    )
    # One row per bin and group at most: bounded by the number of edges.
    placed = prepared.join(F.broadcast(cuts), ["_bin", group], "left").withColumn("_all", F.lit(False) if both else F.coalesce(F.col(group) == "treatment", F.lit(False)))
    # Rows below the cut stay as they are; only the slice that straddles it is ranked.
    below = placed.where(F.col("_all") | (F.col("_coarse") < F.col("_cut")))
    order = Window.partitionBy("_bin", group).orderBy("_prio", *keys)
    at_cut = placed.where(~F.col("_all") & (F.col("_coarse") == F.col("_cut"))).withColumn("_rn", F.row_number().over(order))
    sampled = below.unionByName(at_cut.where(F.col("_rn") <= F.col("_rest")).drop("_rn"))
    return sampled.drop("_bin", "_prio", "_coarse", "_cut", "_rest", "_all")


def random_sample(df: DataFrame, fraction: float = 0.1, seed: int | None = None) -> DataFrame:
    """Bernoulli sample without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, keys: list[str] = PAIR_KEYS, fraction: float = 0.1, hash: str = "xxhash64") -> DataFrame:
    """Bernoulli sample decided by a key hash: the same rows in every run."""
    scale = 16**8
    return df.where(_priority(keys, hash, 8) < int(fraction * scale))


def treatment_rows(df: DataFrame, group: str = "sample_grp") -> DataFrame:
    return df.where(F.col(group) == "treatment")


def long_metrics(groups: dict[str, DataFrame], metrics: dict[str, str], quantity=rel_diff) -> DataFrame:
    """``control_group, metric, value``: one row per pair, tagged group and metric."""
    parts = []
    for tag, df in groups.items():
        rows = F.array(*[F.struct(F.lit(label).alias("metric"), quantity(m).alias("value")) for label, m in metrics.items()])
        parts.append(df.select(F.lit(tag).alias("control_group"), F.explode(rows).alias("_r")).select("control_group", "_r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
