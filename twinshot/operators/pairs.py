"""Near-coincident pairs: distance self-join, metric enrichment, pair filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinshot.functions.geo import EARTH_RADIUS_M, geo_partition, haversine_m, haversine_term
from twinshot.functions.scalar import days_between
from twinshot.operators.keys import lookup_join, tasks_for
from twinshot.operators.quadtree import LEAF_KEYS, in_leaf, in_reached_leaves, leaves, part

PAIR_KEYS = ["t1_shot_number", "t2_shot_number"]


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Every column renamed with a prefix."""
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def quality_shots(shots: DataFrame, flag: str = "l4_quality_flag") -> DataFrame:
    return shots.where(F.col(flag) == 1)


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height)


def _columns_in_band(band: Column, height: float) -> Column:
    """How many cells of at least ``height`` degrees of arc fit around the globe in a band."""
    low, high = band * height - 90, (band + 1) * height - 90
    widest_lat = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians(widest_lat)) * 360 / height))


def _lon_cell(lon: Column, columns: Column) -> Column:
    return F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * columns)


def _cell_key(band: Column, lon_cell: Column) -> Column:
    return F.shiftleft(band, 32) + lon_cell


def _own_cell(lon: Column, lat: Column, height: float) -> Column:
    band = _band(lat, height)
    columns = _columns_in_band(band, height)
    key = _cell_key(band, F.least(_lon_cell(lon, columns), columns - 1))
    # Never NULL for a placed point; saying so spares the join an IS NOT NULL filter that
    # would compute the cell a second time.
    return F.coalesce(key, F.lit(-1).cast("long"))


def _own_parts(lon: Column, lat: Column, height: float) -> tuple[Column, Column]:
    """Parts of its own cell that a point lies in."""
    band = _band(lat, height)
    columns = _columns_in_band(band, height)
    along = F.pmod(lon + 180, F.lit(360.0)) / 360 * columns
    return part(along - F.least(F.floor(along), columns - 1)), part((lat + 90) / height - band)


def _lon_reach(lat: Column, reach: float) -> Column:
    """Degrees of longitude that ``reach`` degrees of arc span at most."""
    top_lat = F.abs(lat) + reach
    return F.when(top_lat >= 89.9, F.lit(180.0)).otherwise(F.lit(reach) / F.cos(F.radians(top_lat)))


def _reaches(lon: Column, lat: Column, height: float, reach: float) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """(low, high) of a point's box along the sides of the cell ``_cell``, as fractions of them."""
    band = F.shiftright("_cell", 32)
    cell = F.col("_cell").bitwiseAND(F.lit((1 << 32) - 1))
    columns = _columns_in_band(band, height)
    half = _lon_reach(lat, reach) / 360 * columns
    # From the cell's west side to the point, the short way around the globe.
    along = F.pmod((lon + 180) / 360 * columns - cell + columns / 2, columns.cast("double")) - columns / 2
    # A box nearly as wide as the band reaches over all of every cell.
    around = half * 2 >= columns - 2
    up = (lat + 90) / height - band
    x = F.when(around, F.lit(0.0)).otherwise(along - half), F.when(around, F.lit(1.0)).otherwise(along + half)
    return x, (up - reach / height, up + reach / height)


def _touched_cells(lon: Column, lat: Column, height: float, reach: float) -> Column:
    """Cells met by the box of ``reach`` degrees of arc around a point, across the antimeridian."""
    bands = F.sequence(
        _band(F.greatest(lat - reach, F.lit(-90.0)), height), _band(F.least(lat + reach, F.lit(90.0)), height)
    )
    dlon = _lon_reach(lat, reach)

    def cells(band: Column) -> Column:
        columns = _columns_in_band(band, height)
        unit = columns / F.lit(360.0)
        first = F.floor((lon + 180 - dlon) * unit)
        last = F.floor((lon + 180 + dlon) * unit)
        # A box as wide as the band wraps onto itself: name each cell once.
        last = F.least(last, first + columns - 1)
        return F.transform(F.sequence(first, last), lambda c: _cell_key(band, F.pmod(c, columns)))

    return F.flatten(F.transform(bands, cells))


def near_pairs(
    shots: DataFrame,
    radius_m: float = 40.0,
    id: str = "shot_number",
    lon: str = "lon",
    lat: str = "lat",
    cell_factor: float = 4.0,
    hot_cell_rows: int | None = 20_000,
    partition_col: str | None = None,
) -> DataFrame:
    """Pairs of shots at most ``radius_m`` apart with ``t1`` id below ``t2`` id, each once.

    Cells are ``cell_factor`` radii high and, per latitude band, at least as wide on the
    ground, so no pass over the data is needed to size them. One side stays in its own
    cell, the other is copied to the cells its reach touches (on average
    ``(1 + 2 / cell_factor)^2`` copies), which turns the theta join into an equi-join and
    yields each pair once. Cells above ``hot_cell_rows`` rows are quartered again and again
    (``quadtree.py``), and what can't be is cut into a square of blocks, each joined by its own
    task; ``None`` leaves skew to the adaptive join. All shot columns appear as ``t1_*`` and ``t2_*``,
    plus ``distance_m``; with wide shots, pair a few columns and attach the rest by ``enrich_pairs``.
    ``shots`` is read once for either side and, by position only, for the counts of cells and of full
    cells' parts: give a stored table. Nothing runs before an action.
    """
    # Outward margin on the reach only: extra candidates are dropped by the distance test.
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    height = reach * max(cell_factor, 1.0)
    lon_c, lat_c = F.col(lon), F.col(lat)

    placed = shots.where(lon_c.isNotNull() & lat_c.isNotNull())
    t1 = (F.col(f"t1_{lon}"), F.col(f"t1_{lat}"))
    t2 = (F.col(f"t2_{lon}"), F.col(f"t2_{lat}"))
    left = prefixed(placed, "t1_").withColumn("_cell", _own_cell(*t1, height))
    right = prefixed(placed, "t2_").withColumn("_cell", F.explode(_touched_cells(*t2, height, reach)))
    keys = ["_cell"]
    if hot_cell_rows is not None:
        keys = LEAF_KEYS
        parts = _own_parts(lon_c, lat_c, height)
        counted = placed.select(_own_cell(lon_c, lat_c, height).alias("_cell"), *[c.alias(n) for n, c in zip(("_x", "_y"), parts)])
        pieces = F.broadcast(leaves(counted, hot_cell_rows))  # bounded by construction, see there
        left = in_leaf(left, pieces, *_own_parts(*t1, height), f"t1_{id}")
        right = in_reached_leaves(right, pieces, *_reaches(*t2, height, reach), f"t2_{id}")

    limit = math.sin(radius_m / (2 * EARTH_RADIUS_M)) ** 2
    pairs = (
        left.join(right, keys)
        .where(F.col(f"t1_{id}") < F.col(f"t2_{id}"))
        .where(F.abs(t1[1] - t2[1]) <= reach)
        .where(haversine_term(*t1, *t2) <= limit)
        .drop(*keys)
        .withColumn("distance_m", haversine_m(*t1, *t2))
    )
    if partition_col:
        pairs = pairs.withColumn(partition_col, geo_partition(*t1))
    return pairs


def enrich_pairs(
    pairs: DataFrame,
    metrics: DataFrame,
    key: str = "shot_num",
    outlier: str | None = "outlier_umd",
    hot: tuple[DataFrame | None, DataFrame | None] = (None, None),
    rows: tuple[int, int] | None = None,
) -> DataFrame:
    """Attach a metric table (one row per shot) to both members of each pair.

    With ``outlier`` set, rows whose flag is not 0 on either side are dropped; the filter
    is applied to the metric table once, before both joins. ``rows`` are the numbers of pairs and of metric
    rows: by them and the columns' widths the joins of wide tables are dealt to enough tasks.
    """
    if outlier:
        metrics = metrics.where(F.col(outlier) == 0)
    how = "inner"
    for prefix, hot_side in zip(("t1_", "t2_"), hot):
        side = prefixed(metrics, prefix).withColumnRenamed(prefix + key, prefix + "shot_number")
        clash = (set(side.columns) & set(pairs.columns)) - {prefix + "shot_number"}
        if clash:
            raise ValueError(f"columns present on both inputs: {sorted(clash)}")
        tasks = tasks_for([(pairs, rows[0]), (side, rows[1])]) if rows else None
        pairs = lookup_join(pairs, side, [prefix + "shot_number"], how, hot_side, tasks=tasks)
    return pairs


def with_time_diff(pairs: DataFrame, time: str = "absolute_time") -> DataFrame:
    """Whole days between the two measurements."""
    return pairs.withColumn("time_diff", days_between(F.col(f"t1_{time}"), F.col(f"t2_{time}")))


def drop_same_day(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("time_diff") != 0)


def closer_than(pairs: DataFrame, metres: float = 30.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pairs strictly closer than ``metres``."""
    d = haversine_m(F.col(f"t1_{lon}"), F.col(f"t1_{lat}"), F.col(f"t2_{lon}"), F.col(f"t2_{lat}"))
    return pairs.where(d < metres)


def intersect_pairs(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``pairs`` whose keys are also in ``other``; rows are never multiplied."""
    return pairs.join(other.select(*PAIR_KEYS), PAIR_KEYS, "left_semi").select(*pairs.columns)
