"""Rasters as pixel tables: one row per pixel, keyed by (tile, row, col).

A tile table holds one row per raster tile: ``tile, x0, y0, dx, dy, nx, ny`` and the
extent ``xmin, ymin, xmax, ymax``. Sparse pixel tables leave out default-valued pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinshot.functions.geo import nearest_index, two_nearest
from twinshot.operators.region import Ring, within_region

AXES = ["x0", "y0", "dx", "dy", "nx", "ny"]
EXTENT = ["xmin", "ymin", "xmax", "ymax"]


def with_extent(tiles: DataFrame) -> DataFrame:
    """Bounding box columns from edge-anchored axes."""
    x1 = F.col("x0") + F.col("nx") * F.col("dx")
    y1 = F.col("y0") + F.col("ny") * F.col("dy")
    return tiles.select(
        "*",
        F.least("x0", x1).alias("xmin"),
        F.least("y0", y1).alias("ymin"),
        F.greatest("x0", x1).alias("xmax"),
        F.greatest("y0", y1).alias("ymax"),
    )


def tile_index(pixels: DataFrame, geo: DataFrame) -> DataFrame:
    """Tile table from a dense pixel table and its georeference ``tile, x0, y0, dx, dy``."""
    sizes = pixels.groupBy("tile").agg(
        (F.max("col") + 1).cast("int").alias("nx"), (F.max("row") + 1).cast("int").alias("ny")
    )
    return with_extent(geo.join(sizes, "tile").select("tile", *AXES))


def tile_tokens(files: DataFrame, pattern: str, group: int = 1, path: str = "path") -> DataFrame:
    """Tile name of each raster file, taken from its path."""
    return files.withColumn("tile", F.regexp_extract(F.col(path), pattern, group))


def duplicate_tiles(tiles: DataFrame) -> DataFrame:
    """Tile names that occur more than once; must be empty for a usable index."""
    return tiles.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1")


def stack_bands(pixels: DataFrame, years: list[int], value: str = "value") -> DataFrame:
    """One row per pixel with ``vals`` = one entry per year, from one row per pixel and year."""
    bands = [F.max(F.when(F.col("year") == y, F.col(value))).alias(f"y{y}") for y in years]
    wide = pixels.where(F.col("year").isin(years)).groupBy("tile", "row", "col").agg(*bands)
    return wide.select("tile", "row", "col", F.array(*[f"y{y}" for y in years]).alias("vals"))


def pair_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles of two products with identical bounds, and those without a partner.

    ``status`` is 'both', 'a_only' or 'b_only'.
    """
    left = a.select(*EXTENT, F.col("tile").alias("a_tile"))
    right = b.select(*EXTENT, F.col("tile").alias("b_tile"))
    status = F.when(F.col("b_tile").isNull(), "a_only").when(F.col("a_tile").isNull(), "b_only").otherwise("both")
    return left.join(right, EXTENT, "full_outer").withColumn("status", status)


def join_pixels(rows: DataFrame, pixels: DataFrame) -> DataFrame:
    """Join to a pixel table by ``tile, row, col``, never by broadcast.

    A raster's files are hundreds of times smaller than its rows, so Spark, which plans by their size, would
    send the pixels of thousands of tiles through the driver.
    """
    return rows.join(pixels.hint("merge"), ["tile", "row", "col"])


def mask_product(pixels: DataFrame, mask: DataFrame, value: str = "value", by: str = "mask") -> DataFrame:
    """Pixel-wise product of a value and a mask, without the pixels it sets to zero."""
    live = mask.where(F.col(by) != 0)
    return (
        join_pixels(pixels.where(F.col(value) != 0), live)
        .select("tile", "row", "col", (F.col(value) * F.col(by)).alias(value))
    )


def split_alerts(pixels: DataFrame, mask: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Confidence digit and day number of CDDDD codes, after masking."""
    masked = pixels.where(F.col(value) != 0) if mask is None else mask_product(pixels, mask, value)
    return masked.select(
        "tile",
        "row",
        "col",
        F.floor(F.col(value) / 10000).cast("int").alias("confidence"),
        (F.col(value) % 10000).cast("int").alias("day"),
    )


def crop_pixels(
    pixels: DataFrame,
    tiles: DataFrame,
    region: Ring | tuple[float, float, float, float],
    value: str = "value",
    nodata: float | None = None,
) -> DataFrame:
    """Pixels whose centre lies in a box (xmin, ymin, xmax, ymax) or polygon; nodata to NULL.

    Tiles that miss the region's box are dropped before the pixels are joined.
    """
    box = region if not isinstance(region[0], (tuple, list)) else None
    if box is None:
        xs, ys = [p[0] for p in region], [p[1] for p in region]
        xmin, ymin, xmax, ymax = min(xs), min(ys), max(xs), max(ys)
    else:
        xmin, ymin, xmax, ymax = box
    hit = tiles.where(
        (F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax)
    )
    placed = (
        pixels.join(hit.select("tile", "x0", "y0", "dx", "dy"), "tile")
        .withColumn("lon", F.col("x0") + (F.col("col") + 0.5) * F.col("dx"))
        .withColumn("lat", F.col("y0") + (F.col("row") + 0.5) * F.col("dy"))
    )
    if box is None:
        placed = within_region(placed, region)
    else:
        placed = placed.where(F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax))
    clean = F.col(value) if nodata is None else F.nullif(F.col(value), F.lit(nodata))
    return placed.select("tile", "row", "col", "lon", "lat", clean.alias(value))


# ----- points on tiles --------------------------------------------------------------


def assign_tile(points: DataFrame, tiles: DataFrame, lon: str = "t2_lon", lat: str = "t2_lat") -> DataFrame:
    """Points strictly inside a tile, one row per (point, tile), with the tile's axes.

    Every tile is listed in a grid whose cells are as wide as the tile, rounded up to a power of two, so it
    meets four cells at most, however much sizes differ. A point probes one cell of each grid that any
    tile is in; that list is a scalar subquery, so nothing runs before the result is asked for. Tiles are
    joined by cell, without hint: adaptive execution broadcasts them by measured size, or shuffles.
    """
    width = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-9))
    levelled = tiles.withColumn("_level", F.ceil(F.log2(width)).cast("int"))
    levels = levelled.agg(F.collect_set("_level").alias("_levels")).scalar()

    def cell(v: Column, level: Column) -> Column:
        return F.floor(v / F.pow(F.lit(2.0), level))

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(cell(F.col(low), F.col("_level")), cell(F.col(high), F.col("_level"))))

    listed = levelled.withColumn("_cx", span("xmin", "xmax")).withColumn("_cy", span("ymin", "ymax"))
    x, y = F.col(lon), F.col(lat)
    inside = (x > F.col("xmin")) & (x < F.col("xmax")) & (y > F.col("ymin")) & (y < F.col("ymax"))
    # A point without position gets a cell no tile covers.
    nowhere = F.lit(-(2**62))
    probing = points.withColumn("_level", F.explode(levels))
    return (
        probing.withColumn("_cx", F.coalesce(cell(x, F.col("_level")), nowhere))
        .withColumn("_cy", F.coalesce(cell(y, F.col("_level")), nowhere))
        .join(listed.select("_level", "_cx", "_cy", "tile", *AXES, *EXTENT), ["_level", "_cx", "_cy"])
        .where(inside)
        .select(*points.columns, "tile", *AXES)
    )


# ----- pixel windows ----------------------------------------------------------------
# A window is named by one pixel: its lowest corner (2 x 2) or its centre (3 x 3). What the
# raster holds there is read from the block that owns that pixel, see ``blocks.py``.


def window2(points: DataFrame, lon: str = "t2_lon", lat: str = "t2_lat", anchor: str = "edge") -> DataFrame:
    """Corner (wrow, wcol) of the 2 x 2 window of a point and where its nearest pixel sits.

    ``near_row`` and ``near_col`` are 0 or 1: the offset of the nearest pixel from the
    corner. Windows reaching outside the raster are dropped.
    """
    near_x, far_x = two_nearest(F.col(lon), F.col("x0"), F.col("dx"), F.col("nx"), anchor)
    near_y, far_y = two_nearest(F.col(lat), F.col("y0"), F.col("dy"), F.col("ny"), anchor)
    found = F.struct(near_x.alias("_nx"), far_x.alias("_fx"), near_y.alias("_ny"), far_y.alias("_fy"))
    return (
        # Unfolded, so that the filter and what follows read the indices and don't repeat their formulas.
        points.select("*", F.inline(F.array(found)))
        .where(F.col("_fx").between(0, F.col("nx") - 1) & F.col("_fy").between(0, F.col("ny") - 1))
        .withColumns(
            {
                "wrow": F.least("_ny", "_fy").cast("int"),
                "wcol": F.least("_nx", "_fx").cast("int"),
                "near_row": (F.col("_ny") > F.col("_fy")).cast("int"),
                "near_col": (F.col("_nx") > F.col("_fx")).cast("int"),
            }
        )
        .drop("_nx", "_fx", "_ny", "_fy")
    )


def window1(points: DataFrame, lon: str = "t2_lon", lat: str = "t2_lat", anchor: str = "centre") -> DataFrame:
    """Nearest pixel (wrow, wcol) of a point, clamped to the raster."""
    return points.withColumns(
        {
            "wrow": nearest_index(F.col(lat), F.col("y0"), F.col("dy"), F.col("ny"), anchor).cast("int"),
            "wcol": nearest_index(F.col(lon), F.col("x0"), F.col("dx"), F.col("nx"), anchor).cast("int"),
        }
    )


def window3(points: DataFrame, lon: str = "t2_lon", lat: str = "t2_lat", anchor: str = "centre") -> DataFrame:
    """Centre (wrow, wcol) of the 3 x 3 window of a point; border windows are dropped."""
    inside = F.col("wrow").between(1, F.col("ny") - 2) & F.col("wcol").between(1, F.col("nx") - 2)
    return window1(points, lon, lat, anchor).where(inside)


def window_pixels(points: DataFrame, size: int) -> DataFrame:
    """Long form of the windows: one row per point and pixel (``p, row, col``).

    For ad-hoc lookups against a pixel table; the overlays use block tables instead.
    ``p`` counts x offsets outermost, starting from the nearest pixel for 2 x 2 windows.
    """
    if size == 1:
        cells = [(F.lit(0), F.lit(0))]
    elif size == 2:
        row = [F.col("near_row"), 1 - F.col("near_row")]
        col = [F.col("near_col"), 1 - F.col("near_col")]
        cells = [(row[j], col[i]) for i in (0, 1) for j in (0, 1)]
    else:
        cells = [(F.lit(j), F.lit(i)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    listed = F.array(
        *[
            F.struct(
                F.lit(p + 1).alias("p"),
                (F.col("wrow") + r).cast("int").alias("row"),
                (F.col("wcol") + c).cast("int").alias("col"),
            )
            for p, (r, c) in enumerate(cells)
        ]
    )
    return points.withColumn("_cell", F.explode(listed)).select(*points.columns, "_cell.*")
