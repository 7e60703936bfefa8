"""Full grid cells quartered until no piece holds too many rows.

Rows of a cell are counted exactly. A cell above the limit is split into quarters, full quarters again, at
most ``DEPTH`` times; a piece that is still full, as all its rows lie together, is cut into a square of
``splits`` x ``splits`` blocks. Pieces without rows don't exist, so copies that reach into them meet no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Times that a cell is quartered, and the parts along its sides that this gives.
DEPTH = 3
SIDE = 1 << DEPTH
#: Cells that are split, the fullest first, which bounds the table of pieces to 2^18 rows; a cell left whole
#: holds less than a MAX_CELLS-th of all rows.
MAX_CELLS = 1 << 12
#: Widening of reaches, in parts: rounding of a position must not hide a piece that it touches.
_MARGIN = 1e-5

LEAF_KEYS = ["_cell", "_leaf", "_i", "_j"]


def part(fraction: Column) -> Column:
    """Part of a cell's side (0 to SIDE - 1) that a position, as a fraction of the side, lies in."""
    return F.least(F.greatest(F.floor(fraction * SIDE), F.lit(0)), F.lit(SIDE - 1)).cast("int")


def leaves(rows: DataFrame, limit: int) -> DataFrame:
    """Pieces ``full_cell, x, y, size, splits`` of the cells with more than ``limit`` of the rows ``_cell, _x, _y``.

    ``x, y`` are a piece's lowest parts, ``size`` its width in parts and ``splits`` the cuts that it needs
    once it can't be quartered any more.
    """
    counted = rows.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    fullest = F.broadcast(counted.orderBy(F.desc("_n"), "_cell").limit(MAX_CELLS).select("_cell"))
    fine = rows.join(fullest, "_cell", "left_semi").groupBy("_cell", "_x", "_y").agg(F.count("*").alias("_n"))

    leaf = None
    for level in range(DEPTH, 0, -1):
        bits = DEPTH - level
        corner = [F.shiftright(c, bits) for c in ("_x", "_y")]
        n = F.sum("_n").over(Window.partitionBy("_cell", *corner))
        piece = F.struct(
            F.shiftleft(corner[0], bits).alias("x"), F.shiftleft(corner[1], bits).alias("y"),
            F.lit(1 << bits).alias("size"), F.ceil(n / limit).cast("int").alias("splits"),
        )
        leaf = piece if leaf is None else F.when(n <= limit, piece).otherwise(leaf)
    # One exchange serves all levels: a cell's parts are few.
    pieces = fine.repartition("_cell").select(F.col("_cell").alias("full_cell"), leaf.alias("_piece"))
    return pieces.distinct().select("full_cell", "_piece.*")


def _in_pieces(rows: DataFrame, pieces: DataFrame, meets: Column, id: str, own: str, other: str) -> DataFrame:
    """Each row with the pieces that it meets, its slice of them and a copy for every slice of the other side."""
    splits = F.coalesce("splits", F.lit(1))
    return (
        rows.join(pieces, (F.col("_cell") == F.col("full_cell")) & meets, "left")
        # Rows of other cells have leaf -1, as have copies that reach into no piece and so meet nothing.
        .withColumn("_leaf", F.coalesce(F.col("y") * SIDE + F.col("x"), F.lit(-1)))
        .withColumn(own, F.pmod(F.hash(F.col(id)), splits))
        .withColumn(other, F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop(*pieces.columns)
    )


def in_leaf(rows: DataFrame, pieces: DataFrame, x: Column, y: Column, id: str) -> DataFrame:
    """Rows with ``_cell`` in the one piece that holds their part ``x, y``."""
    size = F.col("size")
    holds = (x >= F.col("x")) & (x < F.col("x") + size) & (y >= F.col("y")) & (y < F.col("y") + size)
    return _in_pieces(rows, pieces, holds, id, "_i", "_j")


def in_reached_leaves(
    rows: DataFrame, pieces: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], id: str
) -> DataFrame:
    """Rows with ``_cell`` once for every piece that they reach; ``x, y`` are (low, high) fractions of the cell's sides."""

    def meets(reach: tuple[Column, Column], corner: Column) -> Column:
        return (reach[1] * SIDE + _MARGIN >= corner) & (reach[0] * SIDE - _MARGIN < corner + F.col("size"))

    return _in_pieces(rows, pieces, meets(x, F.col("x")) & meets(y, F.col("y")), id, "_j", "_i")
