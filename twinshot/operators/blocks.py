"""Rasters as blocks: one row per square of pixels, its values as arrays.

A block table is keyed by ``tile, brow, bcol`` and holds, for every value of the pixels, an array over the
``SIZE`` x ``SIZE`` pixels of the block and the ring of one pixel around them. So the 2 x 2 window above a
corner pixel and the 3 x 3 window around a centre lie in the block that owns that pixel, and a point
needs one row of the raster, whatever its window: nothing is spread over windows. Entries of pixels that the
raster doesn't list are NULL, and blocks without any listed pixel don't exist.

Stored tables are partitioned by ``shard``, a hash of the tile. ``only_blocks`` leaves the blocks that points ask
for; with a stored, hence small and sized, table of those Spark prunes the shards before the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DataType, IntegerType, LongType, ShortType

from twinshot.operators.keys import hot_keys, lookup_join, materialise

SIZE = 64
BLOCK_KEYS = ["tile", "brow", "bcol"]
#: Rows of blocks of a tile that share a file.
_FILE_ROWS = 16
#: Folders of a stored table. One for every tile of many would take longer to make and to list than to fill.
SHARDS = 512


def is_blocks(raster: DataFrame) -> bool:
    return {"brow", "bcol"} <= set(raster.columns)


def to_blocks(pixels: DataFrame, values: list[str], size: int = SIZE) -> DataFrame:
    """Block table of a pixel table ``tile, row, col, values...`` with one row per pixel.

    A pixel goes to its own block, and at the rim to the neighbours whose ring it is in: 6 % more rows than
    pixels. A group is one block, so its memory is bounded by ``size``.
    """
    edge = size + 2

    def owners(at: str) -> Column:
        return F.array_distinct(F.array(*[F.floor((F.col(at) + d) / F.lit(size)).cast("int") for d in (-1, 0, 1)]))

    spread = (
        pixels.select("tile", "row", "col", F.explode(owners("row")).alias("brow"), *values)
        .select("tile", "row", "col", "brow", F.explode(owners("col")).alias("bcol"), *values)
        .where("brow >= 0 and bcol >= 0")
    )
    place = (F.col("row") - F.col("brow") * size + 1) * edge + (F.col("col") - F.col("bcol") * size + 1)
    # Unfolded, so that the aggregate takes the pixel as it is and doesn't work it out itself, which isn't compiled.
    pixel = F.explode(F.array(F.struct(place.cast("int").alias("_at"), *values)))
    listed = spread.select(*BLOCK_KEYS, pixel.alias("_p")).groupBy(*BLOCK_KEYS).agg(F.array_sort(F.collect_list("_p")).alias("_px"))
    # The place listed before each one, so that the gap between them can be filled. It is an argument and
    # not a column of the lambda, which would work it out anew for every pixel.
    places = F.transform("_px", lambda p: p["_at"])
    before = F.concat(F.array(F.lit(-1)), F.slice(places, F.lit(1), F.size("_px") - 1))
    types = {f.name: f.dataType for f in pixels.schema.fields}

    def dense(value: str) -> Column:
        none = F.lit(None).cast(types[value])
        after_gap = lambda p, q: F.concat(F.array_repeat(none, p["_at"] - q - 1), F.array(p[value]))
        runs = F.zip_with("_px", before, lambda p, q: F.when(p["_at"] == q + 1, F.array(p[value])).otherwise(after_gap(p, q)))
        return F.flatten(runs).alias(value)

    return listed.select(*BLOCK_KEYS, *[dense(v) for v in values])


def _shard() -> Column:
    return F.pmod(F.hash("tile"), F.lit(SHARDS))


def store_blocks(blocks: DataFrame, path: str | None = None, gathered: bool = False) -> DataFrame:
    """Write a block table partitioned by shard, in the order of its blocks, and read it back.

    ``gathered`` says that the blocks of a tile lie in one task, or in few, as those of a stored table do: they are
    written from there and don't move.
    """
    sharded = blocks.withColumn("shard", _shard())
    if not gathered:
        sharded = sharded.repartition("shard", F.floor(F.col("brow") / _FILE_ROWS))
    return materialise(sharded.sortWithinPartitions("shard", *BLOCK_KEYS), path, partition_by=["shard"])


def with_block(points: DataFrame, size: int = SIZE) -> DataFrame:
    """``brow, bcol`` of the block that owns each point's window pixel (wrow, wcol)."""
    return points.withColumns({f"b{c}": F.floor(F.col(f"w{c}") / F.lit(size)).cast("int") for c in ("row", "col")})


def asked_blocks(points: DataFrame, size: int = SIZE) -> DataFrame:
    """The distinct blocks that points with a window ask for. Store the result (``materialise``) before it prunes a scan."""
    return with_block(points, size).select(*BLOCK_KEYS).distinct()


def only_blocks(raster: DataFrame, asked: DataFrame) -> DataFrame:
    """The blocks named in ``asked``. Its filter holds for all; Spark prunes partitions only by a side that has one."""
    named = asked.where("brow >= 0")
    if "shard" not in raster.columns:
        return raster.join(named, BLOCK_KEYS, "left_semi")
    return raster.join(named.withColumn("shard", _shard()), ["shard", *BLOCK_KEYS], "left_semi")


def hot_blocks(points: DataFrame, rows: int, size: int = SIZE) -> DataFrame:
    """Blocks that more than ``rows`` points ask for, for the ``hot`` argument of the overlays."""
    return hot_keys(with_block(points, size), F.xxhash64(*BLOCK_KEYS), rows)


# ----- blocks on their way to the points ----------------------------------------------
# A join copies the whole block for every point, and an array of 4356 small arrays takes ten times the room of
# its numbers. So integers travel as one flat array of the narrowest type that holds the block's values.

_WIDTHS = (ByteType(), ShortType(), IntegerType())
_WHOLE = (*_WIDTHS, LongType())


def _narrowed(numbers: Column, kind: DataType) -> Column:
    """An array of integers in the field of the narrowest type that holds all of them: ``w0`` (a byte) and so on."""
    kinds = _WHOLE[: _WHOLE.index(kind) + 1]
    low, high = F.array_min(numbers), F.array_max(numbers)
    fields, taken = [], F.lit(False)
    for i, k in enumerate(kinds):
        top = 2 ** (8 * 2**i - 1)
        fits = F.coalesce((low >= -top) & (high < top), F.lit(True)) if k != kind else F.lit(True)
        fields.append(F.when(~taken & fits, numbers.cast(ArrayType(k))).alias(f"w{i}"))
        taken = taken | fits
    return F.struct(*fields)


def _fields(packed: str, kind: DataType) -> list[Column]:
    return [F.col(f"{packed}.w{i}") for i in range(_WHOLE.index(kind) + 1)]


def _packable(kind: DataType) -> DataType | None:
    """Type of the integers in a block's array of ``kind``, None if it holds none."""
    inner = kind.elementType if isinstance(kind, ArrayType) else kind
    return inner if inner in _WHOLE else None


def _packed(raster: DataFrame, values: list[str]) -> DataFrame:
    """``_b_...`` columns of each value, read by ``_entry``; values that aren't integers, or lists of them, stay.

    Lists of one length go into ``_b_``, their length into ``_k_``, and ``_t_`` is 1 where a pixel has one; a
    block with lists of several lengths keeps them in ``_r_``.
    """
    types = {f.name: f.dataType.elementType for f in raster.schema.fields if f.name in values}
    lists = [v for v in values if _packable(types[v]) and isinstance(types[v], ArrayType)]
    flat = [v for v in values if _packable(types[v]) and v not in lists]
    sizes = {f"_s_{v}": F.array_distinct(F.transform(F.filter(v, lambda a: a.isNotNull()), F.size)) for v in lists}
    out = raster.select(*BLOCK_KEYS, *values).withColumns(sizes)
    regular = {v: F.size(f"_s_{v}") == 1 for v in lists}
    out = out.withColumns({f"_k_{v}": F.when(regular[v], F.col(f"_s_{v}")[0]) for v in lists})
    # The fillers are an argument of the lambda, not a column in it, which would be made anew for every pixel.
    none = {v: F.array_repeat(F.array_repeat(F.lit(None).cast(_packable(types[v])), F.col(f"_k_{v}")), F.size(v)) for v in lists}
    numbers = {v: F.when(F.col(f"_k_{v}").isNotNull(), F.flatten(F.zip_with(v, none[v], lambda a, n: F.coalesce(a, n)))) for v in lists}
    out = out.withColumns({f"_n_{v}": numbers[v] for v in lists})
    columns = [F.col(v).alias(f"_b_{v}") for v in values if v not in lists and v not in flat]
    columns += [_narrowed(F.col(v), types[v]).alias(f"_b_{v}") for v in flat]
    for v in lists:
        there = F.transform(v, lambda a: F.when(a.isNotNull(), F.lit(1).cast("tinyint")))
        columns += [
            _narrowed(F.col(f"_n_{v}"), _packable(types[v])).alias(f"_b_{v}"), F.col(f"_k_{v}"),
            F.when(F.col(f"_k_{v}").isNotNull(), there).alias(f"_t_{v}"), F.when(F.col(f"_k_{v}").isNull(), F.col(v)).alias(f"_r_{v}"),
        ]
    return out.select(*BLOCK_KEYS, *columns)


def _runs(value: str, kind: DataType, row: int, start: Column, length: int) -> dict[str, Column]:
    """What a packed block holds from place ``start`` on, from 0, for ``length`` pixels of a window's row."""
    number = _packable(kind)
    if number is None:
        return {f"_n{row}_{value}": F.slice(f"_b_{value}", start + 1, F.lit(length))}
    fields = _fields(f"_b_{value}", number)
    lists = isinstance(kind, ArrayType)
    k = F.coalesce(f"_k_{value}", F.lit(0)) if lists else F.lit(1)
    runs = {f"_n{row}_{value}": F.coalesce(*[F.slice(f, start * k + 1, k * length).cast(ArrayType(number)) for f in fields])}
    if lists:
        runs |= {f"_{c}{row}_{value}": F.slice(f"_{c}_{value}", start + 1, F.lit(length)) for c in ("t", "r")}
    return runs


def _entry(value: str, kind: DataType, row: int, at: int) -> Column:
    """The value of pixel ``at``, from 0, of a run."""
    run = F.col(f"_n{row}_{value}")
    if _packable(kind) is None or not isinstance(kind, ArrayType):
        return F.get(run, F.lit(at))
    k = F.coalesce(f"_k_{value}", F.lit(0))
    listed = F.get(F.col(f"_t{row}_{value}"), F.lit(at)) == 1
    return F.when(F.col(f"_k_{value}").isNull(), F.get(F.col(f"_r{row}_{value}"), F.lit(at))).when(listed, F.slice(run, k * at + 1, k))


#: Runs that one step takes from a block.
_STEP_RUNS = 2


def _unfolded(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` and the columns, unfolded so that what reads them doesn't repeat them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def attach_windows(
    points: DataFrame,
    raster: DataFrame,
    window: int,
    values: list[str],
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
    how: str = "left",
    size: int = SIZE,
) -> DataFrame:
    """Add each value of the raster as the array of its ``window`` x ``window`` pixels at every point.

    ``raster`` is a block table, or a pixel table that is made into one. ``wrow, wcol`` name the window by its
    lowest corner (1 x 1, 2 x 2) or centre (3 x 3). Entry ``column offset * window + row offset``, counted
    from the lowest pixel, is that pixel's value, NULL if the raster doesn't list it. ``asked`` prunes the
    raster (``asked_blocks``); with ``how`` 'inner' points in blocks without any listed pixel are dropped.
    """
    if not is_blocks(raster):
        raster = to_blocks(raster.select("tile", "row", "col", *values), values, size)
    if asked is not None:
        raster = only_blocks(raster, asked)
    edge = size + 2
    types = {f.name: f.dataType.elementType for f in raster.schema.fields if f.name in values}
    # Blocks in files are hundreds of times smaller than as rows: never broadcast for the size of their files.
    joined = lookup_join(with_block(points, size), _packed(raster, values), BLOCK_KEYS, how, hot, "merge")
    at = (F.col("wrow") - F.col("brow") * size + 1) * edge + (F.col("wcol") - F.col("bcol") * size + 1)
    low = -1 if window == 3 else 0
    seen = joined.withColumn("_w", at.cast("int"))
    # The rows of the window first, then their pixels, in steps: spelled out for every pixel and type, the look-up
    # would be a method of more than the 8000 bytes that the JVM compiles.
    runs = [r for v in values for j in range(window) for r in _runs(v, types[v], j, F.col("_w") + ((low + j) * edge + low), window).items()]
    for i in range(0, len(runs), _STEP_RUNS):
        seen = _unfolded(seen, dict(runs[i : i + _STEP_RUNS]), seen.columns)
    for v in values:
        pixels = F.array(*[_entry(v, types[v], j, i) for i in range(window) for j in range(window)])
        seen = _unfolded(seen, {v: pixels}, seen.columns)
    return seen.select(*points.columns, *values)
