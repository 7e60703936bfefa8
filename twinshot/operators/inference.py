"""Tests, resampling and fits. Inputs may be large; results have a few hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinshot.functions.scalar import md5_int
from twinshot.operators.keys import join_groups, materialise
from twinshot.operators.ranks import select_ranks

_PANELS = 4000
#: Ranks that one task of the bootstrap should draw at most.
DRAWS = 5_000_000


def student_upper_tail(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t with ``df`` degrees of freedom, for finite t.

    With t = sqrt(df) tan(a) the density becomes cos(a)^(df - 1); both the tail and the
    whole are integrated by Simpson's rule over a = u / sqrt(df), which stays well scaled
    for any df. Meant for result rows, not for the rows of a large table.
    """
    scale = F.sqrt(df)
    top = scale * F.lit(1.5707963267948966)

    def integral(start: Column, width: Column) -> Column:
        step = width / _PANELS

        def term(acc: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == _PANELS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            # The cosine can undershoot 0 by rounding at the very end of the range.
            height = F.pow(F.greatest(F.lit(0.0), F.cos((start + i * step) / scale)), df - 1)
            return acc + weight * height

        return F.aggregate(F.sequence(F.lit(0), F.lit(_PANELS)), F.lit(0.0), term) * step / 3

    # Beyond 40 scaled units the integrand of any df is below 1e-300 or outside the range.
    half = integral(F.lit(0.0), F.least(top, F.lit(40.0)))
    at = F.atan(F.abs(t) / scale) * scale
    tail = integral(at, F.least(top - at, F.lit(40.0) / (1 + at / 4))) / (2 * half)
    return F.when(t >= 0, tail).otherwise(1 - tail)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation, and of the slope of a line."""
    free = (n - 2).cast("double")
    left = F.lit(1.0) - r * r
    t = F.abs(r) * F.sqrt(free / F.nullif(F.greatest(left, F.lit(0.0)), F.lit(0.0)))
    return F.when(free > 0, F.coalesce(2 * student_upper_tail(t, free), F.when(r.isNotNull(), F.lit(0.0))))


def welch_t(df: DataFrame, value: Column, group: str = "sample_grp", first: str = "control", second: str = "treatment") -> DataFrame:
    """Welch's t-test of two groups in one aggregate.

    ``p_two_sided`` tests equal means, ``p_greater`` that the first mean is greater.
    """
    def of(name: str) -> Column:
        return F.when(F.col(group) == name, value)

    a, b = of(first), of(second)
    stats = df.agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"),
        F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
        F.var_samp(a).alias("var1"), F.var_samp(b).alias("var2"),
    )
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    freedom = (e1 + e2) ** 2 / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    tested = stats.withColumn("t", (F.col("mean1") - F.col("mean2")) / F.sqrt(e1 + e2)).withColumn("df", freedom)
    upper = student_upper_tail(F.col("t"), F.col("df"))
    return (
        tested.withColumn("p_greater", upper)
        .withColumn("p_two_sided", 2 * F.least(F.col("p_greater"), 1 - F.col("p_greater")))
        .select("n1", "n2", "mean1", "mean2", "t", "df", "p_two_sided", "p_greater")
    )


def bootstrap_median(
    df: DataFrame,
    value: str,
    group: list[str],
    key: list[str],
    n: int = 100,
    seed: int = 0,
    hash: str = "xxhash64",
) -> DataFrame:
    """Medians of ``n`` resamples with replacement, each of its group's size.

    Returns ``group..., replicate, median``. A resample of a sorted group is a multiset of
    ranks, and its median sits at the median drawn rank, so values are not resampled at
    all: every row draws one rank per replicate by hash, counts of drawn ranks find the
    middle one, and the few ranks found are looked up among the exact ranks of the data.
    Ranks over ten standard errors from the middle are pooled on each side before counting;
    should a median fall there (odds below 1e-22), the query fails rather than be inexact.
    ``key`` must identify a row; ``md5`` draws are portable, ``xxhash64`` draws fast. Rows of NULL
    groups, and rows without a value, are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, *key, value)
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    rows = materialise(rows)  # narrow, and read by each of the steps below
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    # Files of narrow rows are few; tasks follow the draws instead, which are n times the rows.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * n // DRAWS))
    rep = F.col("replicate")
    if hash == "md5":
        # The row's part of the text is made once, not for every draw; a key of NULLs has none.
        name = [F.col(k).cast("string") for k in key]
        rows_drawn = rows.select(*group, *key, F.when(F.coalesce(*name).isNotNull(), F.concat_ws("|", *name)).alias("_name"))
        draw = md5_int(F.lit(seed), rep, F.col("_name"))
    else:
        rows_drawn = rows.select(*group, *key)
        draw = F.xxhash64(F.lit(seed), rep, *[F.col(k) for k in key])
    size = F.col("_n")
    reach = F.ceil(F.sqrt(size.cast("double")) * 5) + 1
    middle = F.floor(size / 2)
    pooled = F.greatest(middle - reach, F.least(middle + reach + 1, F.pmod(draw, size) + 1))
    drawn = (
        rows_drawn.join(sizes, group)
        .repartition(tasks, *key)
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .groupBy(*group, "replicate", "_n", pooled.alias("_rank"))
        .agg(F.count("*").alias("_c"))
    )
    run = Window.partitionBy(*group, "replicate").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    low_at, high_at = F.floor((size + 1) / 2), middle + 1
    middles = (
        drawn.withColumn("_run", F.sum("_c").over(run))
        .groupBy(*group, "replicate", "_n")
        .agg(
            F.min(F.when(F.col("_run") >= low_at, F.col("_rank"))).alias("_low"),
            F.min(F.when(F.col("_run") >= high_at, F.col("_rank"))).alias("_high"),
        )
    )
    outside = ((F.col("_low") <= middle - reach) & (middle - reach >= 1)) | (
        (F.col("_high") >= middle + reach + 1) & (middle + reach + 1 <= size)
    )
    checked = F.when(outside, F.raise_error(F.lit("bootstrap median outside the counted ranks"))).otherwise(F.lit(None))
    middles = middles.withColumn("_low", F.coalesce(checked.cast("long"), F.col("_low")))

    middles = materialise(middles)
    # At most 2 n ranks per group are wanted, all of them near the middle.
    found = select_ranks(
        rows, value, group, lambda groups: middles.select(*group, F.col("_n").alias("n"), F.explode(F.array("_low", "_high")).alias("k"))
    ).select(*group, F.col(value).alias("_v"), F.col("k").alias("_k"))
    found = materialise(found)
    low = found.select(*group, F.col("_k").alias("_low"), F.col("_v").alias("_v1"))
    high = found.select(*group, F.col("_k").alias("_high"), F.col("_v").alias("_v2"))
    return (
        middles.join(low, [*group, "_low"])
        .join(high, [*group, "_high"])
        .select(*group, "replicate", ((F.col("_v1") + F.col("_v2")) / 2).alias("median"))
    )


def replicate_ci(replicates: DataFrame, group: list[str], value: str = "median") -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles over the replicates of each group."""
    ci = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*group).agg(
        F.count("*").alias("replicates"), F.avg(value).alias("mean"), ci[0].alias("ci_lo"), ci[1].alias("ci_hi")
    )


def fit_by_replicate(replicates: DataFrame, x: Column, by: list[str] | None = None, y: str = "median") -> DataFrame:
    """Least-squares line of ``y`` on ``x`` in each replicate: ``slope, intercept, r2, p``.

    Pass ``F.sqrt(...)`` for a square-root curve.
    """
    keys = [*(by or []), "replicate"]
    rows = replicates.select(*keys, F.col(y).cast("double").alias("_y"), x.cast("double").alias("_x"))
    fits = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
    )
    return fits.withColumn("p", correlation_p(F.sqrt("r2"), F.col("n")))


def mean_fit(fits: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Averages of fit columns over the replicates."""
    return fits.groupBy(*(by or [])).agg(*[F.avg(c).alias(c) for c in columns])


def quad_fit(df: DataFrame, x: Column, y: Column, by: list[str]) -> DataFrame:
    """Least squares of y on (1, x^2, x) per group, from power sums of one aggregate.

    Returns ``b0, b_sq, b_lin``, adjusted R^2 and the p-value of each coefficient. The
    3 x 3 normal equations are solved by cofactors around the group's mean of x.
    """
    rows = df.select(*by, x.cast("double").alias("_x0"), y.cast("double").alias("_y")).dropna(subset=["_x0", "_y"])
    centre = rows.groupBy(*by).agg(F.avg("_x0").alias("_m"))
    rows = join_groups(rows, centre, by).withColumn("_x", F.col("_x0") - F.col("_m"))
    p = lambda k: F.sum(F.pow("_x", F.lit(float(k))))
    s = rows.groupBy(*by, "_m").agg(
        F.count("*").cast("double").alias("n"),
        p(1).alias("s1"), p(2).alias("s2"), p(3).alias("s3"), p(4).alias("s4"),
        F.sum("_y").alias("y0"), F.sum(F.col("_x") * F.col("_y")).alias("y1"),
        F.sum(F.col("_x") * F.col("_x") * F.col("_y")).alias("y2"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )
    c = {k: F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2", "yy", "_m")}
    n, s1, s2, s3, s4 = c["n"], c["s1"], c["s2"], c["s3"], c["s4"]
    # Cofactors of [[n, s1, s2], [s1, s2, s3], [s2, s3, s4]] (symmetric).
    cof = {
        "00": s2 * s4 - s3 * s3, "01": s2 * s3 - s1 * s4, "02": s1 * s3 - s2 * s2,
        "11": n * s4 - s2 * s2, "12": s1 * s2 - n * s3, "22": n * s2 - s1 * s1,
    }
    s = s.withColumns({f"c{k}": v for k, v in cof.items()})
    cf = {k: F.col(f"c{k}") for k in cof}
    s = s.withColumn("det", F.nullif(n * cf["00"] + s1 * cf["01"] + s2 * cf["02"], F.lit(0.0)))
    det = F.col("det")
    s = s.withColumns(
        {
            "a0": (cf["00"] * c["y0"] + cf["01"] * c["y1"] + cf["02"] * c["y2"]) / det,
            "a1": (cf["01"] * c["y0"] + cf["11"] * c["y1"] + cf["12"] * c["y2"]) / det,
            "a2": (cf["02"] * c["y0"] + cf["12"] * c["y1"] + cf["22"] * c["y2"]) / det,
        }
    )
    a0, a1, a2, m = F.col("a0"), F.col("a1"), F.col("a2"), c["_m"]
    sse = F.greatest(F.lit(0.0), c["yy"] - a0 * c["y0"] - a1 * c["y1"] - a2 * c["y2"])
    s = s.withColumn("sse", sse).withColumn("sst", c["yy"] - c["y0"] * c["y0"] / n)
    noise = F.col("sse") / F.nullif(n - 3, F.lit(0.0))
    # Back to uncentred coefficients; variances follow from the same linear map.
    v00, v01, v02, v11, v12, v22 = (cf[k] / det for k in ("00", "01", "02", "11", "12", "22"))
    s = s.withColumns(
        {
            "b0": a0 - a1 * m + a2 * m * m,
            "b_sq": a2,
            "b_lin": a1 - 2 * a2 * m,
            "se0": F.sqrt(noise * (v00 + m * m * v11 + m * m * m * m * v22 - 2 * m * v01 + 2 * m * m * v02 - 2 * m * m * m * v12)),
            "se_sq": F.sqrt(noise * v22),
            "se_lin": F.sqrt(noise * (v11 + 4 * m * m * v22 - 4 * m * v12)),
        }
    )
    free = (n - 3).cast("double")
    pv = lambda b, se: F.when(free > 0, 2 * student_upper_tail(F.abs(b / F.nullif(se, F.lit(0.0))), free))
    return s.select(
        *by,
        F.col("n").cast("long").alias("n"),
        "b0", "b_sq", "b_lin",
        (1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0)) * (n - 1) / F.nullif(n - 3, F.lit(0.0))).alias("adj_r2"),
        pv(F.col("b0"), F.col("se0")).alias("p0"),
        pv(F.col("b_sq"), F.col("se_sq")).alias("p_sq"),
        pv(F.col("b_lin"), F.col("se_lin")).alias("p_lin"),
    )


def correlation_test(df: DataFrame, x: Column, y: Column, by: list[str]) -> DataFrame:
    """Pearson correlation of x and y per group with its two-sided p-value."""
    rows = df.select(*by, x.cast("double").alias("_x"), y.cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    r = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r"))
    return r.withColumn("p", correlation_p(F.col("r"), F.col("n")))
