"""Polygon regions: containment of points and splitting into named chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinshot.functions.geo import corner_name

Ring = list[tuple[float, float]]

EDGE_SCHEMA = "x1 double, y1 double, x2 double, y2 double"


def _edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    return [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(closed, closed[1:])]


def _crossings(edges: Column, lon: Column, lat: Column) -> Column:
    """How many edges a ray toward +x from the point crosses."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.coalesce(spans & (lon < at), F.lit(False))

    return F.size(F.filter(edges, crosses))


def _slab_edges(spark: SparkSession, rings: list[Ring], slab: float) -> DataFrame:
    edges = [e for ring in rings for e in _edges(ring)]
    flat = spark.createDataFrame(edges, EDGE_SCHEMA)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return (
        flat.withColumn("_slab", F.explode(F.sequence(F.floor(low / slab), F.floor(high / slab))))
        .groupBy("_slab")
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    )


def within_region(df: DataFrame, ring: Ring | list[Ring], lon: str = "lon", lat: str = "lat", slab: float | None = None) -> DataFrame:
    """Points inside a polygon (even-odd rule, straight edges in degrees).

    A list of rings is an outline with holes or several parts. The bounding box reaches
    the scan as a pushed filter. The outline is cut into latitude slabs, so a point is
    tested against the edges of its own slab only, whatever the number of vertices.
    """
    rings = ring if isinstance(ring[0][0], (list, tuple)) else [ring]
    xs = [p[0] for r in rings for p in r]
    ys = [p[1] for r in rings for p in r]
    x, y = F.col(lon), F.col(lat)
    if slab is None:
        slab = max((max(ys) - min(ys)) / 1000, 1e-6)
    boxed = df.where(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)))
    slabs = _slab_edges(df.sparkSession, rings, slab)
    return (
        boxed.withColumn("_slab", F.floor(y / slab))
        .join(slabs, "_slab")
        .where(_crossings(F.col("_edges"), x, y) % 2 == 1)
        .select(*df.columns)
    )


def chunk_region(spark: SparkSession, ring: Ring, dx: int = 2, dy: int = 2) -> DataFrame:
    """Grid chunks that overlap a polygon: ``name, xmin, ymin, xmax, ymax``.

    Chunks start at the floor of the polygon's minimum and are named by their top left
    corner. A chunk is kept if its centre lies inside or an edge passes through it.
    """
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    y_axis = F.sequence(F.lit(math.floor(min(ys))), F.lit(math.ceil(max(ys)) + dy - 1), F.lit(dy))
    x_axis = F.sequence(F.lit(math.floor(min(xs))), F.lit(math.ceil(max(xs)) + dx - 1), F.lit(dx))
    edges = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"))]) for e in _edges(ring)])
    grid = (
        spark.range(1)
        .select(F.explode(y_axis).alias("ymin"))
        .withColumn("xmin", F.explode(x_axis))
        .withColumn("xmax", F.col("xmin") + dx)
        .withColumn("ymax", F.col("ymin") + dy)
    )
    inside = _crossings(edges, F.col("xmin") + dx / 2, F.col("ymin") + dy / 2) % 2 == 1
    box = tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    touched = F.exists(edges, lambda e: _edge_meets_box(e, *box))
    return grid.where(inside | touched).select(
        corner_name(F.col("xmin"), F.col("ymax")).alias("name"), "xmin", "ymin", "xmax", "ymax"
    )


def _edge_meets_box(e: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a segment passes through the interior of a box (separating-axis test)."""
    apart = (
        (F.greatest(e["x1"], e["x2"]) <= xmin)
        | (F.least(e["x1"], e["x2"]) >= xmax)
        | (F.greatest(e["y1"], e["y2"]) <= ymin)
        | (F.least(e["y1"], e["y2"]) >= ymax)
    )

    def side(x: Column, y: Column) -> Column:
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])

    corners = [side(xmin, ymin), side(xmin, ymax), side(xmax, ymin), side(xmax, ymax)]
    all_one_side = (F.least(*corners) >= 0) | (F.greatest(*corners) <= 0)
    return ~apart & ~all_one_side


def chunk_key(lon: Column, lat: Column, ring: Ring, dx: int = 2, dy: int = 2) -> tuple[Column, Column]:
    """(xmin, ymin) of the chunk cell that holds a point."""
    x0 = math.floor(min(p[0] for p in ring))
    y0 = math.floor(min(p[1] for p in ring))
    return (
        (F.floor((lon - x0) / dx) * dx + x0).cast("int"),
        (F.floor((lat - y0) / dy) * dy + y0).cast("int"),
    )
