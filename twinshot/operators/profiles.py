"""Vertical profiles of shots, split at a third of the height before the disturbance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinshot.functions.scalar import profile_at, third_height_bucket
from twinshot.schemas import PROFILE_HEIGHTS, PROFILE_STEP


def profile_columns(kind: str = "pai", prefix: str = "") -> list[str]:
    return [f"{prefix}{kind}_{h}" for h in PROFILE_HEIGHTS]


def folded(kind: str = "pai", prefix: str = "") -> Column:
    """The profile's columns as one array, lowest height first."""
    return F.array(*[F.col(c) for c in profile_columns(kind, prefix)])


def split_profiles(
    df: DataFrame, height: str = "t1_rh_98_a0", kind: str = "pai", prefixes: tuple[str, ...] = ("t1_", "t2_"), bucket: str = "t1_mid_tch_bucket"
) -> DataFrame:
    """Adds the split height and, for every prefix, what a cumulative profile holds above and below it.

    The split is a third of ``height`` rounded down to a multiple of 5, the same for all prefixes;
    ``{prefix}upper_{kind}`` is the profile there less its value at the top, ``{prefix}lower_{kind}`` its value
    at the ground less the one there. Heights outside the profile, and NULL, give NULL. The columns
    ``{prefix}{kind}_0`` to ``_100`` are read by place, in one pass and without a group per split height.
    """
    out = df.withColumn(bucket, third_height_bucket(F.col(height)))
    for p in prefixes:
        at = profile_at(folded(kind, p), F.col(bucket), PROFILE_STEP)
        ground, top = F.col(f"{p}{kind}_{PROFILE_HEIGHTS[0]}"), F.col(f"{p}{kind}_{PROFILE_HEIGHTS[-1]}")
        out = out.withColumns({f"{p}upper_{kind}": at - top, f"{p}lower_{kind}": ground - at})
    return out


def split_series(split: DataFrame, lost: str = "canopy_lost", kind: str = "pai") -> DataFrame:
    """``story, series, value`` of split pairs: before, and after by whether the canopy was lost."""
    rows = []
    for story in ("upper", "lower"):
        before, after = F.col(f"t1_{story}_{kind}"), F.col(f"t2_{story}_{kind}")
        rows.append(F.struct(F.lit(story).alias("story"), F.lit("before").alias("series"), before.alias("value")))
        series = F.when(F.col(lost), "after, lost").otherwise("after, kept")
        rows.append(F.struct(F.lit(story).alias("story"), series.alias("series"), after.alias("value")))
    return split.select(F.inline(F.array(*rows)))
