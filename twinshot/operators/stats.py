"""Descriptive statistics of pairs and samples, each in as few passes as it needs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinshot.functions.scalar import bin_index, difference, ratio, rel_diff
from twinshot.operators.keys import attach_row, join_groups
from twinshot.operators.ranks import exact_percentiles


def sma_columns(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of the reduced major axis, as aggregates."""
    slope = F.signum(F.corr(x, y)) * F.stddev(y) / F.nullif(F.stddev(x), F.lit(0.0))
    return slope, F.avg(y) - slope * F.avg(x)


def sma_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Reduced-major-axis regression of y on x: ``n, slope, intercept, r``."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope, intercept = sma_columns(F.col(x), F.col(y))
    return both.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), slope.alias("slope"), intercept.alias("intercept"), F.corr(x, y).alias("r")
    )


def pair_stats(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Agreement of t1 and t2 per metric, all metrics in one aggregate.

    One row per metric (and group): ``n, bias, rel_diff, corr, mean_t1, pct_bias,
    sma_slope, sma_intercept``.
    """
    by = by or []
    aggs = []
    for m in metrics:
        t1, t2 = F.col(f"t1_{m}"), F.col(f"t2_{m}")
        slope, intercept = sma_columns(t1, t2)
        bias, mean_t1 = F.avg(difference(m)), F.avg(t1)
        aggs.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.count(difference(m)).alias("n"),
                bias.alias("bias"),
                F.avg(rel_diff(m)).alias("rel_diff"),
                F.corr(t1, t2).alias("corr"),
                mean_t1.alias("mean_t1"),
                (ratio(bias, mean_t1) * 100).alias("pct_bias"),
                slope.alias("sma_slope"),
                intercept.alias("sma_intercept"),
            )
        )
    wide = df.groupBy(*by).agg(F.array(*aggs).alias("_m"))
    return wide.select(*by, F.inline("_m"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def lag_stats(
    df: DataFrame, edges: list[int], values: dict[str, Column], min_n: int = 0, col: str = "time_diff"
) -> DataFrame:
    """Standard deviation and mean of each value per band ``[lo, hi)`` of a lag.

    Every band appears; statistics are NULL where it has fewer than ``min_n`` rows.
    """
    edges = sorted(edges)
    aggs = [F.count("*").alias("n")]
    for name, v in values.items():
        aggs += [F.stddev(v).alias(f"sd_{name}"), F.avg(v).alias(f"bias_{name}")]
    found = df.withColumn("_band", bin_index(F.col(col), edges, right=False)).where("_band is not null").groupBy("_band").agg(*aggs)
    bands = df.sparkSession.createDataFrame(
        [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "_band int, lag_lo long, lag_hi long"
    )
    n = F.coalesce("n", F.lit(0)).alias("n")
    stats = [
        F.when(F.col("n") >= min_n, F.col(f"{k}_{name}")).alias(f"{k}_{name}") for name in values for k in ("sd", "bias")
    ]
    return bands.join(found, "_band", "left").select("lag_lo", "lag_hi", n, *stats)


def with_extremes(df: DataFrame, values: dict[str, str], by: list[str]) -> DataFrame:
    """Attach ``{name}_min`` and ``{name}_max`` of each group to its rows.

    The extremes are a second, pre-aggregated pass: one row per group, NULL being a group.
    """
    aggs = []
    for name, c in values.items():
        aggs += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    if by:
        return join_groups(df, df.groupBy(*by).agg(*aggs), by)
    return attach_row(df, df.agg(*aggs))


def histogram(df: DataFrame, col: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in ``bins`` equal-width bins between each group's extremes.

    The last bin is closed on both sides. Timestamps are binned by their seconds.
    """
    by = by or []
    kind = dict(df.dtypes)[col]
    x = F.unix_micros(F.col(col).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(col).cast("double")
    rows = with_extremes(df.select(*by, x.alias("_x")).where("_x is not null"), {"_x": "_x"}, by)
    width = (F.col("_x_max") - F.col("_x_min")) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_x_min")) / F.nullif(width, F.lit(0.0))))
    )
    return (
        rows.groupBy(*by, idx.cast("int").alias("bin"), "_x_min", width.alias("_w"))
        .agg(F.count("*").alias("n"))
        .select(
            *by,
            "bin",
            (F.col("_x_min") + F.col("bin") * F.col("_w")).alias("bin_lo"),
            (F.col("_x_min") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
            "n",
        )
    )


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 100, mincnt: int = 1) -> DataFrame:
    """Counts of points in hexagonal cells: ``cx, cy`` (cell centre) and ``n``.

    Two rectangular lattices offset by half a cell; a point belongs to the nearer centre.
    ``gridsize`` cells in x, ``gridsize / sqrt(3)`` in y.
    """
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    points = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    rows = with_extremes(points, {"x": "_x", "y": "_y"}, [])
    pad = 1e-9

    def axis(v: str, name: str, n: int) -> tuple[Column, Column]:
        span = F.col(f"{name}_max") - F.col(f"{name}_min")
        low = F.col(f"{name}_min") - span * pad
        return (F.col(v) - low) / (span * (1 + 2 * pad) / n), low

    u, x_low = axis("_x", "x", nx)
    v, y_low = axis("_y", "y", ny)
    rows = rows.withColumns({"_u": u, "_v": v, "_xl": x_low, "_yl": y_low})
    on_grid = (F.col("_u") - F.rint("_u")) ** 2 + 3 * (F.col("_v") - F.rint("_v")) ** 2
    off_grid = (F.col("_u") - F.floor("_u") - 0.5) ** 2 + 3 * (F.col("_v") - F.floor("_v") - 0.5) ** 2
    near = on_grid < off_grid
    rows = rows.withColumns(
        {
            "_cu": F.when(near, F.rint("_u")).otherwise(F.floor("_u") + 0.5),
            "_cv": F.when(near, F.rint("_v")).otherwise(F.floor("_v") + 0.5),
        }
    )
    x_step = (F.col("x_max") - F.col("x_min")) * (1 + 2 * pad) / nx
    y_step = (F.col("y_max") - F.col("y_min")) * (1 + 2 * pad) / ny
    return (
        rows.groupBy("_cu", "_cv", "_xl", "_yl", x_step.alias("_sx"), y_step.alias("_sy"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= mincnt)
        .select(
            (F.col("_cu") * F.col("_sx") + F.col("_xl")).alias("cx"),
            (F.col("_cv") * F.col("_sy") + F.col("_yl")).alias("cy"),
            "n",
        )
    )


def kde(df: DataFrame, col: str, by: list[str] | None = None, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid of each group: ``x, density``.

    Bandwidth is the sample standard deviation times n^(-1/5); the grid reaches ``cut``
    bandwidths past the extremes. Every row meets the fixed grid in its own task and only partial
    sums are shuffled: at most ``points`` rows per group and task, whatever the number of values.
    """
    by = by or []
    rows = df.select(*by, F.col(col).cast("double").alias("_v")).where("_v is not null")
    shape = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.stddev("_v").alias("_sd"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    shape = shape.withColumn("_bw", F.col("_sd") * F.pow("_n", F.lit(-0.2))).where("_bw > 0")
    joined = join_groups(rows, shape, by) if by else attach_row(rows, shape).where("_bw > 0")
    step = (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_bw")) / (points - 1)
    grid = joined.withColumn("_step", step).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") - cut * F.col("_bw") + F.col("point") * F.col("_step")
    z = (x - F.col("_v")) / F.col("_bw")
    norm = F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi)
    return grid.groupBy(*by, "point", x.alias("x"), norm.alias("_norm")).agg(
        F.sum(F.exp(z * z * -0.5)).alias("_s")
    ).select(*by, "point", "x", (F.col("_s") / F.col("_norm")).alias("density"))


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``n, q25, q50, q75`` per group, exact."""
    return exact_percentiles(df, value, by, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 interquartile ranges."""
    q = quartiles(df, value, by)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    v = F.col(value)
    near = v.between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        join_groups(df.where(v.isNotNull()), q, by)
        .groupBy(*by, "n", "q25", "q50", "q75")
        .agg(F.min(F.when(near, v)).alias("whisker_lo"), F.max(F.when(near, v)).alias("whisker_hi"))
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def shares(df: DataFrame, conditions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Percent of rows meeting a condition among those meeting another, all in one pass.

    ``conditions`` maps a name to (numerator, denominator); rows counted in the numerator
    meet both.
    """
    return df.agg(
        F.count("*").alias("n"),
        *[(ratio(F.count_if(a & b) * 100.0, F.count_if(b).cast("double"))).alias(name) for name, (a, b) in conditions.items()],
    )


def max_by_group(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.max(value).alias(f"max_{value}"))
