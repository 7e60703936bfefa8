"""Shared joins and stores: group statistics, hot join keys, results written once."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rows, as they are in memory, that a task should join at most.
TASK_BYTES = 128 << 20


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join a table with one row per group back to the rows, NULL groups included.

    The groups have no hint: adaptive execution broadcasts them by their measured size, or shuffles and splits
    skewed partitions. The rows are never broadcast: files of a few MB can hold hundreds of MB of rows, which Spark,
    planning by file size, would send through the driver. The columns of ``rows`` come first, ``by`` once.
    """
    other = groups.select(*[F.col(c).alias(f"_g_{c}") if c in by else F.col(c) for c in groups.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    drop = [f"_g_{c}" for c in by]
    if how != "inner":
        return rows.join(other, on, how).drop(*drop)
    # Of an outer join only the groups can be broadcast. The mark is unfolded so that the filter on it stays above the
    # join: below, Spark would see an inner join again.
    marked = rows.join(other.withColumn("_met", F.lit(True)), on, "left").withColumn("_met", F.explode(F.array("_met")))
    return marked.where("_met").drop("_met", *drop)


#: What makes Spark remove the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark):
    """Shuffle files of what is written inside the ``with`` go at the end of each write.

    Otherwise they stay until the driver happens to collect its garbage, so that those of all steps pile up on disk.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write a result once and read it back, so that later steps do not recompute it.

    Without a path a new folder is made under ``spark.checkpoint.dir``, the shared folder a
    cluster names; what is written there outlives any executor. Only a session without
    that setting (a local test) makes itself a folder for checkpoints.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    with shuffles_removed(spark):
        df.write.mode("errorifexists").parquet(path, partitionBy=partition_by, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


_WORK: ContextVar[str | None] = ContextVar("work folder", default=None)


def new_folder(spark) -> str:
    """A path that nothing uses yet: in the work folder at hand, else in the shared folder."""
    return f"{_WORK.get() or _shared_folder(spark)}/twinshot-{uuid.uuid4().hex}"


@contextmanager
def work_folder(spark):
    """A folder for all that is stored inside the ``with``, removed at its end, also after a failure.

    For steps that write their result: a table that is read later must not be stored in it.
    """
    path = new_folder(spark)
    token = _WORK.set(path)
    try:
        yield path
    finally:
        _WORK.reset(token)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _shared_folder(spark) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="twinshot-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    row = one.select(F.struct(*[F.col(c) for c in one.columns]).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def hot_keys(
    df: DataFrame, key: Column, rows_per_split: int, buckets: int = 64, per_bucket: int = 32, tracked: int = 2048
) -> DataFrame:
    """(hot_key, splits) of keys holding more than ``rows_per_split`` rows.

    Frequent-item sketches of fixed size are merged per key bucket, so the pass shuffles
    no rows and its result has at most ``buckets * per_bucket`` rows. A missed or
    over-estimated key changes only how evenly work is spread, never a result.
    """
    sketched = (
        df.select(key.alias("k"))
        .where(F.col("k").isNotNull())
        .groupBy(F.pmod(F.hash("k"), F.lit(buckets)).alias("b"))
        .agg(F.expr(f"approx_top_k(k, {per_bucket}, {tracked})").alias("top"))
    )
    return (
        sketched.select(F.explode("top").alias("t"))
        .where(F.col("t.count") > rows_per_split)
        .select(
            F.col("t.item").alias("hot_key"),
            F.ceil(F.col("t.count") / F.lit(rows_per_split)).cast("int").alias("splits"),
        )
    )


def row_bytes(df: DataFrame) -> int:
    """Bytes that a row takes in memory: a word a column, and three more for one of no fixed width."""
    wide = ("string", "binary", "array", "map", "struct")
    return sum(8 if f.dataType.typeName() not in wide else 32 for f in df.schema.fields)


def tasks_for(sides: list[tuple[DataFrame, int]]) -> int:
    """Tasks that a join of tables with so many rows is dealt to: as many as there are cores, at least."""
    whole = sum(row_bytes(df) * rows for df, rows in sides)
    return max(sides[0][0].sparkSession.sparkContext.defaultParallelism, math.ceil(whole / TASK_BYTES))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
    strategy: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Join ``big`` to a table with at most one row per key.

    ``strategy`` is a join hint for ``small``: 'merge' for tables whose files don't tell their size.

    ``tasks`` (``tasks_for``) deals both sides out to so many tasks. Without it adaptive execution fills tasks by
    the size of shuffled bytes, and wide rows with many equal values take tens of times that when sorted.

    ``hot`` is a result of ``hot_keys`` over ``xxhash64(*on)``: rows of those keys are
    spread over several tasks and the one matching row is copied to each. Without it the
    adaptive skew join splits oversized partitions at run time.
    """
    hinted = lambda side: side.hint(strategy) if strategy else side
    dealt = lambda side, keys: side.repartition(tasks, *keys) if tasks else side
    if hot is None:
        return dealt(big, on).join(hinted(dealt(small, on)), on, how)
    hot = F.broadcast(hot)  # bounded by construction, see hot_keys
    h = F.xxhash64(*on)
    left = (
        big.withColumn("_h", h)
        .join(hot, F.col("_h") == F.col("hot_key"), "left")
        # A hash of the row, not rand(): a recomputed task must send rows to the same place.
        .withColumn("_split", F.pmod(F.xxhash64(*big.columns), F.coalesce("splits", F.lit(1)).cast("long")).cast("int"))
        .drop("_h", "hot_key", "splits")
    )
    right = (
        small.withColumn("_h", h)
        .join(hot, F.col("_h") == F.col("hot_key"), "left")
        .withColumn("_split", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)))
        .drop("_h", "hot_key", "splits")
    )
    keys = [*on, "_split"]
    return dealt(left, keys).join(hinted(dealt(right, keys)), keys, how).drop("_split")
