"""Classification of pairs from raster events around their location.

Every overlay places a pair on a raster tile by its t2 position, joins it once to the raster's
block that holds its whole window and evaluates the rule as column expressions. Rasters are pixel
tables or, better, stored block tables (``blocks.py``); ``asked`` names the blocks that are needed
at all and ``hot`` those that very many pairs need. Results carry all pair columns plus
``tile``; a pair inside two overlapping tiles yields one row per tile.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinshot.functions.scalar import days_since, year_day
from twinshot.operators.blocks import attach_windows
from twinshot.operators.raster import AXES, assign_tile, window1, window2, window3

# Classes of the yearly maps, day zero of the alert product.
UNDISTURBED, DEGRADATION, DEFORESTATION, RECOVERY, OTHER = 1, 2, 3, 4, 6
ALERT_EPOCH = "2014-12-31"


def with_days(pairs: DataFrame, epoch: str = ALERT_EPOCH, time: str = "absolute_time") -> DataFrame:
    """``t1_days, t2_days``: calendar days since the epoch."""
    return pairs.withColumns({f"{t}_days": days_since(F.col(f"{t}_{time}"), epoch) for t in ("t1", "t2")})


def with_years(pairs: DataFrame, time: str = "absolute_time") -> DataFrame:
    """``t1_year, t2_year``."""
    return pairs.withColumns({f"{t}_year": F.year(f"{t}_{time}") for t in ("t1", "t2")})


def with_year_days(pairs: DataFrame, time: str = "absolute_time") -> DataFrame:
    """``t1_yyyydoy, t2_yyyydoy``."""
    return pairs.withColumns({f"{t}_yyyydoy": year_day(F.col(f"{t}_{time}")) for t in ("t1", "t2")})


def run_overlay(pairs: DataFrame, tiles: DataFrame, overlay_fn: Callable[..., DataFrame], **kw) -> DataFrame:
    """Place pairs on tiles and apply any overlay of this module or of the caller's own.

    ``overlay_fn(placed, **kw)`` receives the pairs with their tile and its axes.
    """
    return overlay_fn(assign_tile(pairs, tiles), **kw)


def first_event_year(vals: Column, cls: int, base: int) -> Column:
    """Year of the first entry equal to ``cls`` counting from ``base + 1``; ``base`` if none."""
    return (F.lit(base) + F.coalesce(F.array_position(vals, cls), F.lit(0))).cast("int")


_MEASURED, _CONTROL = 1, 2


def _once(value: Column) -> Column:
    """The value, worked out once per row: filters on it are not pushed below an explode, where they would repeat it."""
    return F.explode(F.array(value))


def _classified(df: DataFrame, dates: Column, hit: Callable[[int], Column], window: int) -> DataFrame:
    """Counts and dates from the dates, then found in ``_dates``, and a hit code per window position, from 0.

    Dates and codes are unfolded: copied into pushed-down filters, the rules would outgrow what the JVM compiles.
    """
    coded = df.withColumn("_dates", _once(dates)).withColumn("_hits", _once(F.array(*[hit(p) for p in range(window)])))
    codes = [F.get("_hits", F.lit(p)) for p in range(window)]
    found = [reduce(add, [F.when(c == code, 1).otherwise(0) for c in codes]) for code in (_MEASURED, _CONTROL)]
    coded = coded.withColumn("_found", _once(F.array(*found)))
    columns = {name: F.get("_found", F.lit(i)) for i, name in enumerate(("measured_disturbance", "control_disturbance"))}
    for p, c in enumerate(codes):
        columns[f"p{p + 1}_disturb_date"] = F.when(c > 0, F.get("_dates", F.lit(p))).otherwise(F.lit(0))
    return coded.withColumns(columns).drop("_dates", "_hits", "_found")


def _code(treatment: Column, control: Column) -> Column:
    return F.when(treatment, _MEASURED).when(control, _CONTROL).otherwise(0)


def disturbed(overlaid: DataFrame) -> DataFrame:
    """Pairs with any disturbance, inside or outside their interval."""
    return overlaid.where(F.col("measured_disturbance") + F.col("control_disturbance") > 0)


def _positions() -> list[Column]:
    """Window entry of each 2 x 2 position p1..p4 (x offset outer, nearest pixel first).

    Windows count from the corner, p counts from the nearest pixel.
    """
    row, col = F.col("near_row"), F.col("near_col")
    return [col.bitwiseXOR(F.lit(i)) * 2 + row.bitwiseXOR(F.lit(j)) for i in (0, 1) for j in (0, 1)]


def in_near_order(values: str) -> Column:
    """A 2 x 2 window's entries from p1, the nearest pixel, to p4."""
    return F.array(*[F.get(F.col(values), at) for at in _positions()])


# ----- yearly class maps ------------------------------------------------------------


def overlay_yearly(
    pairs: DataFrame,
    pixels: DataFrame,
    tiles: DataFrame,
    years: list[int],
    cls: int = DEGRADATION,
    exclude_class: int | None = None,
    anchor: str = "edge",
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """2 x 2 overlay of yearly class maps.

    Per pixel with first event year f: treatment if t1 < f < t2; control if f lies outside
    [t1, t2] and after the first map year. With ``exclude_class`` neither holds unless that
    class, too, first appears outside [t1, t2]. A pixel without event has f = first year - 1.
    ``pixels`` holds ``vals``, one class per year; pixels missing from it have no event.
    """
    placed = window2(assign_tile(pairs, tiles), anchor=anchor)
    seen = attach_windows(placed, pixels, 2, ["vals"], hot, asked)
    base = years[0] - 1
    s1, s2 = F.col("t1_year"), F.col("t2_year")

    def in_order(of: int) -> Column:
        first = F.transform("vals", lambda v: F.coalesce(first_event_year(v, of, base), F.lit(base)))
        return F.array(*[F.get("_first", at) for at in _positions()]), first

    def treatment(f: Column) -> Column:
        return (s1 < f) & (f < s2)

    def control(f: Column) -> Column:
        return ((s2 < f) | (s1 > f)) & (f > years[0])

    if exclude_class is not None:
        other, first = in_order(exclude_class)
        seen = seen.withColumn("_first", first).withColumn("_other", other)
        clear = lambda g: (s2 < g) | (s1 > g)
    else:
        clear = lambda g: F.lit(True)

    def hit(p: int) -> Column:
        f, g = F.get("_dates", F.lit(p)), F.get("_other", F.lit(p)) if exclude_class is not None else None
        return _code(treatment(f) & clear(g), control(f) & clear(g))

    dates, first = in_order(cls)
    return _classified(seen.withColumn("_first", first), dates, hit, 4).drop("_first", "_other", "vals", *_PLACE)


_PLACE = [*AXES, "wrow", "wcol", "near_row", "near_col"]


def intact_pairs(
    pairs: DataFrame,
    pixels: DataFrame,
    tiles: DataFrame,
    undisturbed: int = UNDISTURBED,
    anchor: str = "centre",
    years: int = 4,
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Pairs whose 3 x 3 window is undisturbed in each of ``years`` years.

    All nine pixels must be there with a value for every year, so a missing pixel, tile or year is not
    taken for an intact one.
    """
    placed = window3(assign_tile(pairs, tiles), anchor=anchor)
    seen = attach_windows(placed, pixels, 3, ["vals"], hot, asked, how="inner")
    same = lambda v: F.coalesce((F.size(v) == years) & F.forall(v, lambda c: c.isNotNull() & (c == undisturbed)), F.lit(False))
    return seen.where(F.forall("vals", same)).select(*pairs.columns, "tile")


# ----- day-resolution alerts --------------------------------------------------------


def with_alert_days(
    placed: DataFrame,
    alerts: DataFrame,
    confidence: int | None = 3,
    anchor: str = "centre",
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
    sparse: bool = False,
) -> DataFrame:
    """Attach ``alert_days``, the nine alert days (0 = none) around each placed pair.

    Alerts of another ``confidence`` don't count (None: any does). With ``sparse`` pairs without an alert
    are dropped, those in blocks without any before they are looked at.
    """
    seen = attach_windows(window3(placed, anchor=anchor), alerts, 3, ["confidence", "day"], hot, asked, "inner" if sparse else "left")
    none = F.lit(0)
    if confidence is None:
        days = F.transform("day", lambda d: F.coalesce(d, none))
    else:
        days = F.zip_with("day", "confidence", lambda d, c: F.when(c == confidence, F.coalesce(d, none)).otherwise(none))
    out = seen.withColumn("alert_days", _once(days)).drop("confidence", "day", *AXES, "wrow", "wcol")
    return out.where(F.exists("alert_days", lambda d: d != 0)) if sparse else out


def classify_alerts(attached: DataFrame, buffer: Column | int, start: str = "t1_days", end: str = "t2_days") -> DataFrame:
    """Treatment, control and dates from attached alert days.

    Treatment: the day less the buffer is after t1 and the day is before t2. Control: there
    is an alert, before t1 or by more than the buffer after t2. Others count as neither.
    """
    buffer = F.lit(buffer) if isinstance(buffer, int) else buffer
    s1, s2 = F.col(start), F.col(end)

    def hit(p: int) -> Column:
        d = F.get("_dates", F.lit(p))
        return _code((d - buffer > s1) & (d < s2), (d != 0) & ((d < s1) | (d - buffer > s2)))

    return _classified(attached, F.col("alert_days"), hit, 9).drop("alert_days")


def overlay_alerts(
    pairs: DataFrame,
    alerts: DataFrame,
    tiles: DataFrame,
    buffer_days: int = 30,
    confidence: int | None = 3,
    start: str = "t1_days",
    end: str = "t2_days",
    anchor: str = "centre",
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
    sparse: bool = False,
) -> DataFrame:
    """3 x 3 overlay of alert days. ``alerts`` is sparse: ``tile, row, col, confidence, day``.

    ``start`` and ``end`` name the pair's dates in the unit of ``day``; with
    ``buffer_days=0, confidence=None`` any ordered day code will do. ``sparse`` keeps only
    pairs with an alert in their window.
    """
    attached = run_overlay(
        pairs, tiles, with_alert_days, alerts=alerts, confidence=confidence, anchor=anchor, hot=hot, asked=asked, sparse=sparse
    )
    return classify_alerts(attached, buffer_days, start, end)


def buffer_sweep(
    pairs: DataFrame,
    alerts: DataFrame,
    tiles: DataFrame,
    buffers: list[int],
    metric: str = "agbd_a0",
    confidence: int | None = 3,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Mean difference of disturbed pairs without a measured disturbance, per buffer.

    One overlay join serves all buffers; only the rule is repeated. Pairs without any alert are in no mean.
    """
    attached = run_overlay(pairs, tiles, with_alert_days, alerts=alerts, confidence=confidence, asked=asked, sparse=True)
    needed = ["alert_days", "t1_days", "t2_days", f"t1_{metric}", f"t2_{metric}"]
    swept = attached.select(*needed, F.explode(F.array(*[F.lit(b) for b in buffers])).alias("buffer_days"))
    control = disturbed(classify_alerts(swept, F.col("buffer_days"))).where("measured_disturbance = 0")
    return control.groupBy("buffer_days").agg(
        F.count("*").alias("n"), F.avg(F.col(f"t2_{metric}") - F.col(f"t1_{metric}")).alias("bias")
    )


# ----- intensity --------------------------------------------------------------------


def overlay_intensity(
    pairs: DataFrame,
    pixels: DataFrame,
    tiles: DataFrame,
    first_year: int,
    pixel_order: str = "xy",
    anchor: str = "edge",
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Mean over the 2 x 2 window of disrupted / valid observations in each pixel's event year.

    ``pixels`` holds ``disrupt`` and ``valid``, one count per year; a year without valid observations
    divides by 1, and a pixel that isn't listed or has no event adds nothing. ``pixel_order`` 'xy'
    reads p2 and p3 where the yearly overlay wrote them; 'yx' reads them transposed.
    """
    if pixel_order not in ("xy", "yx"):
        raise ValueError("pixel_order must be 'xy' or 'yx'")
    placed = window2(assign_tile(pairs.drop("tile"), tiles), anchor=anchor)
    seen = attach_windows(placed, pixels, 2, ["disrupt", "valid"], hot, asked)
    at = _positions() if pixel_order == "xy" else [_positions()[p] for p in (0, 2, 1, 3)]
    parts = []
    for p in range(4):
        band = F.col(f"p{p + 1}_disturb_date") - first_year
        year = F.when(band >= 0, band)
        disrupt, valid = (F.get(F.get(c, at[p]), year) for c in ("disrupt", "valid"))
        share = disrupt / F.when(valid == 0, 1).otherwise(valid)
        parts.append(F.coalesce(share, F.lit(0.0)))
    scored = seen.withColumn("_shares", _once(F.array(*parts)))
    mean = reduce(add, [F.get("_shares", F.lit(p)) for p in range(4)]) / 4
    return scored.withColumn("disturb_intensity", _once(mean.cast("float"))).drop("disrupt", "valid", "_shares", *_PLACE)


# ----- burns ------------------------------------------------------------------------


def overlay_burn(
    pairs: DataFrame,
    burns: DataFrame,
    tiles: DataFrame,
    years: list[int],
    anchor: str = "centre",
    hot: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Whether the nearest pixel burned between the two dates, per year and in any.

    ``burns`` is sparse: ``tile, row, col, days`` with one burn day of year per year (0 = none).
    """
    placed = window1(assign_tile(pairs, tiles), anchor=anchor)
    seen = attach_windows(placed, burns, 1, ["days"], hot, asked)
    joined = with_year_days(seen.withColumn("_days", F.get("days", F.lit(0))).drop("days"))
    flags = {}
    for i, y in enumerate(years):
        day = F.coalesce(F.get("_days", F.lit(i)), F.lit(0))
        date = day + y * 1000
        flags[f"burn_bool_{y}"] = (day != 0) & (date > F.col("t1_yyyydoy")) & (date < F.col("t2_yyyydoy"))
    any_burn = reduce(lambda a, b: a | b, [F.col(f"burn_bool_{y}") for y in years])
    return joined.withColumns(flags).withColumn("interceding_burn", any_burn).drop("_days", *AXES, "wrow", "wcol")
