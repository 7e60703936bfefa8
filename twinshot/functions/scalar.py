"""Scalar expressions on measurements and dates."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def days_between(t1: Column, t2: Column) -> Column:
    """Whole days from t1 to t2, floored (one hour backwards is -1)."""
    return F.floor((F.unix_micros(t2) - F.unix_micros(t1)) / F.lit(MICROS_PER_DAY).cast("long"))


def days_since(ts: Column, epoch: str) -> Column:
    """Calendar days of a timestamp after an ISO date."""
    return F.datediff(ts, F.lit(epoch).cast("date"))


def year_day(ts: Column) -> Column:
    """YYYYDDD as one integer."""
    return F.year(ts) * 1000 + F.dayofyear(ts)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is zero."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def difference(metric: str) -> Column:
    return F.col(f"t2_{metric}") - F.col(f"t1_{metric}")


def rel_diff(metric: str) -> Column:
    """(t2 - t1) / (t1 + t2)."""
    return ratio(difference(metric), F.col(f"t1_{metric}") + F.col(f"t2_{metric}"))


def pct_diff(metric: str, offset: float = 0.1) -> Column:
    """Percent change against t1, with a small offset against empty baselines."""
    return ratio(difference(metric), F.col(f"t1_{metric}") + offset) * 100


def pct_loss(metric: str) -> Column:
    """Percent of the t1 value lost by t2."""
    return ratio(-difference(metric), F.col(f"t1_{metric}").cast("double")) * 100


def sample_group(measured: str = "measured_disturbance", control: str = "control_disturbance") -> Column:
    """'treatment' if anything was measured, else 'control' if anything happened outside, else NULL."""
    return F.when(F.col(measured) > 0, "treatment").when(F.col(control) > 0, "control")


def _bins_passed(x: Column, edges: list[float], right: bool) -> Column:
    """Index of the last edge below x (at or below, if not right); -1 before the first."""
    passed = [((F.lit(e) < x) if right else (F.lit(e) <= x)).cast("int") for e in edges]
    return reduce(add, passed) - 1


def bin_index(x: Column, edges: list[float], right: bool = True) -> Column:
    """Index of the bin holding x: (a, b] if right else [a, b); NULL outside all bins."""
    bins = F.array(*[F.lit(i) for i in range(len(edges) - 1)])
    return F.when(x.isNotNull(), F.get(bins, _bins_passed(x, edges, right)))


def cut(x: Column, edges: list[float], right: bool = True) -> Column:
    """Lower edge of the bin holding x, NULL outside all bins."""
    lows = F.array(*[F.lit(float(e)) for e in edges[:-1]])
    return F.when(x.isNotNull(), F.get(lows, _bins_passed(x, edges, right)))


def months(days: Column) -> Column:
    return F.floor(days / 30)


def rescaled_intensity(intensity: Column, measured: Column, window: int = 4) -> Column:
    """Mean over the window turned into a mean over the disturbed pixels."""
    return ratio(intensity * window, measured.cast("double"))


def nonzero(cols: list[Column]) -> Column:
    """Array of the non-zero values among columns."""
    return F.filter(F.array(*cols), lambda d: d != 0)


def row_mode(cols: list[Column]) -> Column:
    """Most frequent non-zero value of a row, smallest on ties, NULL if none.

    The columns of one row never leave it: no explode, no shuffle.
    """
    values = F.array_sort(nonzero(cols))
    counted = F.transform(
        F.array_distinct(values),
        lambda d: F.struct(F.size(F.filter(values, lambda e: e == d)).alias("n"), (-d).alias("neg")),
    )
    return -F.array_max(counted)["neg"]


def third_height_bucket(height: Column) -> Column:
    """A third of a height, rounded down to a multiple of 5."""
    return (F.floor(height / 3 / 5) * 5).cast("int")


def profile_at(profile: Column, bucket: Column, step: int = 5) -> Column:
    """Value of a height profile held as an array with one entry per ``step``."""
    return F.get(profile, F.floor(bucket / step).cast("int"))


def canopy_lost(metric: str = "rh_98_a0", keep: float = 0.65) -> Column:
    return ~(F.col(f"t2_{metric}") >= F.lit(keep) * F.col(f"t1_{metric}"))


def md5_int(*parts: Column, digits: int = 15) -> Column:
    """Leading hex digits of an md5 over '|'-joined parts as a bigint (15 digits = 60 bits)."""
    if not 1 <= digits <= 15:
        raise ValueError("digits must be between 1 and 15")
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")
