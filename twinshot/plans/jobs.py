"""End-to-end jobs: each reads tables, composes operators and writes one result table.

Rasters may be pixel tables or stored block tables (``operators/blocks.py``); of the latter only the tiles
are read that pairs lie in.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinshot.operators.cohort import dedup_pairs, label_groups
from twinshot.operators.blocks import asked_blocks, hot_blocks
from twinshot.operators.keys import TASK_BYTES, hot_keys, materialise, row_bytes, work_folder
from twinshot.operators.overlay import (
    ALERT_EPOCH,
    DEFORESTATION,
    disturbed,
    intact_pairs,
    overlay_alerts,
    overlay_intensity,
    overlay_yearly,
    with_days,
    with_years,
)
from twinshot.operators.pairs import enrich_pairs, near_pairs, quality_shots, with_time_diff
from twinshot.operators.raster import assign_tile, window2, window3
from twinshot.operators.region import Ring, within_region
from twinshot.sources.ingest import read_metrics, read_pairs, write_table

# Session settings the jobs assume. Adaptive execution sizes partitions and splits the
# oversized ones of sort-merge joins at run time.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Larger generated methods are never compiled by the JVM; run such stages operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

# Rows of one raster block that a single task should join at most.
WINDOW_ROWS = 1_000_000


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)
    return spark


def job(run):
    """What the job stores between its steps is gone when it ends."""

    @wraps(run)
    def tidy(spark: SparkSession, *args, **kw) -> None:
        with work_folder(spark):
            run(spark, *args, **kw)

    return tidy


@job
def find_pairs(spark: SparkSession, shots_path: str, out: str, region: Ring | None = None, radius_m: float = 40.0, overwrite: bool = False) -> None:
    """Near-coincident pairs of the quality shots of a region, with all columns of both shots.

    The distance join sees ids and positions only; the other columns are attached to the pairs that it
    finds.
    """
    shots = quality_shots(spark.read.parquet(shots_path))
    if region:
        shots = within_region(shots, region)
    narrow = materialise(shots.select("shot_number", "lon", "lat"))
    pairs = near_pairs(narrow, radius_m, partition_col="geo_partition")
    write_table(enrich_pairs(pairs, shots.drop("lon", "lat"), key="shot_number", outlier=None), out, overwrite)


@job
def add_metrics(spark: SparkSession, pairs_path: str, metrics_path: str, out: str, overwrite: bool = False) -> None:
    """Both shots' metrics on each pair, without outliers."""
    pairs, metrics = read_pairs(spark, pairs_path), read_metrics(spark, metrics_path)
    # Rows of one shot that a task should join, with the metrics of both.
    most = max(1, TASK_BYTES // (row_bytes(pairs) + 2 * row_bytes(metrics)))
    hot = tuple(hot_keys(pairs, F.xxhash64(f"{t}_shot_number"), most) for t in ("t1", "t2"))
    write_table(enrich_pairs(pairs, metrics, hot=hot, rows=(pairs.count(), metrics.count())), out, overwrite)


def _blocks(pairs: DataFrame, tiles: DataFrame, window, anchor: str) -> dict[str, DataFrame]:
    """Blocks that the pairs ask for, stored so that they prune the raster's scan, and those asked for very often.

    Only the positions of the stored pairs are read.
    """
    placed = window(assign_tile(pairs.select("t2_lon", "t2_lat"), tiles), anchor=anchor)
    return {"asked": materialise(asked_blocks(placed)), "hot": hot_blocks(placed, WINDOW_ROWS)}


@job
def yearly_degradation(
    spark: SparkSession,
    pairs_path: str,
    pixels_path: str,
    tiles: DataFrame,
    out: str,
    years: list[int],
    exclude_class: int | None = DEFORESTATION,
    anchor: str = "edge",
    overwrite: bool = False,
) -> None:
    """Pairs with yearly-map degradation inside or outside their interval, deforestation excluded."""
    pairs = with_years(read_pairs(spark, pairs_path))
    pixels = spark.read.parquet(pixels_path)
    overlaid = overlay_yearly(
        pairs, pixels, tiles, years, exclude_class=exclude_class, anchor=anchor, **_blocks(pairs, tiles, window2, anchor)
    )
    write_table(disturbed(overlaid), out, overwrite)


@job
def alert_degradation(
    spark: SparkSession,
    pairs_path: str,
    alerts_path: str,
    tiles: DataFrame,
    out: str,
    buffer_days: int = 30,
    anchor: str = "centre",
    overwrite: bool = False,
    epoch: str = ALERT_EPOCH,
) -> None:
    """Pairs with alerts inside or outside their interval; ``epoch`` is day zero of the alerts."""
    pairs = with_days(read_pairs(spark, pairs_path), epoch)
    overlaid = overlay_alerts(
        pairs, spark.read.parquet(alerts_path), tiles, buffer_days, anchor=anchor, sparse=True, **_blocks(pairs, tiles, window3, anchor)
    )
    write_table(disturbed(overlaid), out, overwrite)


@job
def disturbance_intensity(
    spark: SparkSession,
    yearly_path: str,
    pixels_path: str,
    tiles: DataFrame,
    out: str,
    first_year: int,
    anchor: str = "edge",
    overwrite: bool = False,
) -> None:
    """Intensity of the events found by ``yearly_degradation``."""
    pairs = spark.read.parquet(yearly_path).drop("tile")
    pixels = spark.read.parquet(pixels_path)
    scored = overlay_intensity(pairs, pixels, tiles, first_year, anchor=anchor, **_blocks(pairs, tiles, window2, anchor))
    write_table(scored, out, overwrite)


@job
def intact_controls(
    spark: SparkSession, pairs_path: str, pixels_path: str, tiles: DataFrame, out: str, anchor: str = "centre", overwrite: bool = False
) -> None:
    """Pairs in forest undisturbed in every year."""
    pairs = read_pairs(spark, pairs_path)
    pixels = spark.read.parquet(pixels_path)
    write_table(intact_pairs(pairs, pixels, tiles, anchor=anchor, **_blocks(pairs, tiles, window3, anchor)), out, overwrite)


def analysis_frame(overlaid: DataFrame) -> DataFrame:
    """Labelled, de-duplicated pairs with their time difference: the input of the statistics."""
    return dedup_pairs(label_groups(with_time_diff(overlaid)))
