"""Tables stored in buckets of a key, so that joins on it move neither side.

A pair table is joined twice to tables with one row per shot, and more than one such table may follow. Stored
in buckets of the shot, the metrics stay where they are in every one of these joins; pairs stored in buckets
of their first shot are moved once, for the second. Both sides need the same number of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from twinshot.operators.keys import new_folder

#: Bytes that a bucket should hold at most; a task joins one bucket.
BUCKET_BYTES = 256 << 20


def buckets_for(bytes_stored: int, least: int) -> int:
    """Number of buckets for a table: a power of two, so that tables of other sizes still fit together."""
    n = 1
    while n < least or n * BUCKET_BYTES < bytes_stored:
        n *= 2
    return n


def store_bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` in ``buckets`` files by the hash of ``key``, each sorted by it, and read it back.

    Rows without a key are kept. The files lie in ``path``, else in a new folder (``keys.new_folder``); the
    session's catalog gets an external table over them (``bucketed_names``). A key with very many rows
    makes a large bucket that the adaptive join can't split: salt such tables by ``lookup_join``
    instead.
    """
    spark = df.sparkSession
    name = f"twinshot_{uuid.uuid4().hex}"
    # One task per bucket, hence one file each.
    spread = df.repartition(buckets, key)
    spread.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name, path=path or new_folder(spark))
    return spark.table(name)


def bucketed_names(spark: SparkSession) -> list[str]:
    """Names of the stored tables in the session's catalog."""
    return sorted(t.name for t in spark.catalog.listTables(pattern="twinshot_*"))


def forget_bucketed(spark: SparkSession) -> None:
    """Take all stored tables out of the catalog; their files stay."""
    for name in bucketed_names(spark):
        spark.sql(f"drop table {name}")
