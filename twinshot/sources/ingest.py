"""Readers and writers."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinshot.functions.geo import double_from_bits, swap_bytes
from twinshot.operators.keys import shuffles_removed
from twinshot.schemas import METRIC_SCHEMA

PARTITION_OPTIONS = {"numPartitions", "partitionColumn", "lowerBound", "upperBound"}


def read_pairs(spark: SparkSession, path: str, geometry: tuple[str, ...] = ("t1_geometry", "t2_geometry")) -> DataFrame:
    """Pair table from parquet; WKB geometry columns become ``*_lon, *_lat``."""
    pairs = spark.read.parquet(path)
    for g in geometry:
        if g in pairs.columns:
            prefix = g.removesuffix("geometry")
            pairs = points_from_wkb(pairs, g, f"{prefix}lon", f"{prefix}lat")
    return pairs


def points_from_wkb(df: DataFrame, geometry: str = "geometry", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Replace a WKB column by two double columns; NULL where the geometry is not a point.

    Both byte orders and an embedded SRID are understood. The bytes are decoded by column
    expressions, in steps, so that no part is written out more than once.
    """
    keep = [c for c in df.columns if c != geometry]
    text, kind = F.col("_hex"), F.col("_kind")
    steps = df.withColumn("_hex", F.hex(geometry)).withColumn("_little", F.substring("_hex", 1, 2) == "01")
    type_code = F.when(F.col("_little"), swap_bytes(F.substring(text, 3, 8), 4)).otherwise(F.substring(text, 3, 8))
    steps = steps.withColumn("_kind", F.conv(type_code, 16, 10).cast("long"))
    # Flag bits lead the type code; ISO variants with Z or M add thousands.
    start = F.when(kind.bitwiseAND(0x20000000) != 0, F.lit(19)).otherwise(F.lit(11))
    steps = steps.withColumns({"_start": start, "_is_point": kind.bitwiseAND(0x0FFFFFFF) % 1000 == 1})
    for name, offset in ((lon, 0), (lat, 16)):
        raw = F.substr(text, F.col("_start") + offset, F.lit(16))
        steps = steps.withColumn("_raw", raw)
        steps = steps.withColumn("_raw", F.when(F.col("_little"), swap_bytes(F.col("_raw"), 8)).otherwise(F.col("_raw")))
        steps = steps.withColumns(
            {
                "_head": F.conv(F.substring("_raw", 1, 3), 16, 10).cast("int"),
                "_tail": F.conv(F.substring("_raw", 4, 13), 16, 10).cast("long"),
            }
        )
        steps = steps.withColumn(name, F.when(F.col("_is_point"), double_from_bits(F.col("_head"), F.col("_tail"))))
    return steps.select(*keep, lon, lat)


def read_metrics(spark: SparkSession, path: str, schema: StructType = METRIC_SCHEMA) -> DataFrame:
    """Shot metrics from CSV files with headers; the declared schema saves an inference pass.

    Columns are chosen by header name; files of one folder may have them in different orders and have
    columns of their own. Files are grouped by their first line in one pass of Spark over the folder, and
    each distinct header is one scan; the scans are united by name. A file that lacks a declared
    column is an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    # The first line of a file is the first row of its first block.
    first = lines.where("at = 0").groupBy("file").agg(F.first("value").alias("header"))
    headers = first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for row in sorted(headers, key=lambda r: r["header"] or ""):
        names = next(csv.reader([row["header"] or ""]), [])
        missing = [n for n in types if n not in names]
        if missing:
            raise ValueError(f"columns missing from {row['files'][:3]}: {missing}")
        # Columns outside the declared schema are read as text and pruned.
        file_schema = StructType()
        for name in names:
            file_schema.add(name, types.get(name, "string"))
        scan = spark.read.schema(file_schema).option("header", True).option("enforceSchema", False).csv(row["files"])
        parts.append(scan.select(*types))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.union, parts)


def jdbc_options(url: str, table: str, partition: dict | None = None, properties: dict | None = None) -> dict[str, str]:
    """Options of a JDBC read; a query is passed as a parenthesised ``table`` with an alias."""
    options = {"url": url, "dbtable": table, **{k: str(v) for k, v in (properties or {}).items()}}
    if partition:
        if set(partition) != PARTITION_OPTIONS:
            raise ValueError(f"partition must have exactly the keys {sorted(PARTITION_OPTIONS)}")
        options |= {k: str(v) for k, v in partition.items()}
    return options


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition: dict | None = None, properties: dict | None = None
) -> DataFrame:
    """Table or subquery over JDBC, read in parallel ranges of a numeric column if given."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, partition, properties)).load()


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet sink; refuses an existing target unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)


def write_chunks(df: DataFrame, path: str, rows: int = 10_000, overwrite: bool = False) -> None:
    """Parquet sink whose files hold at most ``rows`` rows."""
    mode = "overwrite" if overwrite else "errorifexists"
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)
