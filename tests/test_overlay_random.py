"""Overlays against a cell-by-cell restatement of their rules on random rasters."""

import random

import pytest

from rasters import COLS, ROWS, collect_hits, pair_rows, tiles, yearly_pixels
from twinshot.operators.blocks import SIZE, asked_blocks, attach_windows, hot_blocks, only_blocks, store_blocks, to_blocks
from twinshot.operators.keys import materialise
from twinshot.operators.overlay import (
    disturbed,
    intact_pairs,
    overlay_alerts,
    overlay_burn,
    overlay_yearly,
    run_overlay,
)
from twinshot.operators.raster import assign_tile, window2, window3
from pyspark.sql import functions as F

YEARS = [2019, 2020, 2021, 2022]


def window2x2(lat, lon):
    def axis(v, n):
        i = min(range(n), key=lambda k: abs(k + 0.5 - v))
        return i, i - 1 if v < i + 0.5 else i + 1

    xs, ys = axis(lon, COLS), axis(lat, ROWS)
    if min(xs) < 0 or max(xs) >= COLS or min(ys) < 0 or max(ys) >= ROWS:
        return None
    return [(ys[j], xs[i]) for i in (0, 1) for j in (0, 1)]


def window3x3(lat, lon):
    x = min(range(COLS), key=lambda k: abs(k - lon))
    y = min(range(ROWS), key=lambda k: abs(k - lat))
    if x < 1 or x > COLS - 2 or y < 1 or y > ROWS - 2:
        return None
    return [(y + j, x + i) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def random_pairs(rnd, n, low, high):
    out = []
    for _ in range(n):
        a, b = sorted((rnd.randint(low, high), rnd.randint(low, high)))
        # Half steps put points exactly on pixel edges and centres.
        snap = rnd.random() < 0.3
        lat, lon = rnd.uniform(-0.5, 6.5), rnd.uniform(-0.5, 7.5)
        out.append((a, b, round(lat * 2) / 2 if snap else lat, round(lon * 2) / 2 if snap else lon))
    return out


def first(vals, cls):
    return next((y for y, v in zip(YEARS, vals) if v == cls), 2018)


@pytest.mark.parametrize("exclude", [None, 3])
def test_yearly(spark, exclude):
    rnd = random.Random(11)
    marked = {
        (r, c): {y: rnd.choice([1, 1, 2, 2, 3, 4, 6]) for y in YEARS} for r in range(ROWS) for c in range(COLS) if rnd.random() < 0.7
    }
    pairs = random_pairs(rnd, 300, 2016, 2023)  # includes years before the first map
    expected = {}
    for k, (s1, s2, lat, lon) in enumerate(pairs):
        cells = window2x2(lat, lon)
        if cells is None:
            continue
        m = c = 0
        dates = {}
        for p, cell in enumerate(cells, 1):
            vals = [marked.get(cell, {}).get(y, 1) for y in YEARS]
            f, g = first(vals, 2), first(vals, 3)
            clear = exclude is None or s2 < g or s1 > g
            treat = s1 < f < s2 and clear
            ctrl = (s2 < f or s1 > f) and f > 2019 and clear
            m, c = m + treat, c + ctrl
            if treat or ctrl:
                dates[p] = f
        expected[k] = (m, c, dates)
    df = pair_rows(spark, pairs, "t1_year", "t2_year")
    px = yearly_pixels(spark, marked)
    out = overlay_yearly(df, px, tiles(spark), YEARS, exclude_class=exclude)
    assert collect_hits(out, 4) == expected
    hot = hot_blocks(window2(assign_tile(df, tiles(spark))), 3)
    assert hot.count() > 0
    spread = overlay_yearly(df, px, tiles(spark), YEARS, exclude_class=exclude, hot=hot)
    assert collect_hits(spread, 4) == expected
    assert collect_hits(disturbed(out), 4) == {k: v for k, v in expected.items() if v[0] + v[1] > 0}


@pytest.mark.parametrize("buffer", [0, 30])
def test_alerts(spark, buffer):
    rnd = random.Random(5)
    raster = {(r, c): (rnd.randint(1, 4), rnd.choice([0, rnd.randint(1, 400)])) for r in range(ROWS) for c in range(COLS)}
    pairs = random_pairs(rnd, 200, 0, 400)
    expected = {}
    for k, (s1, s2, lat, lon) in enumerate(pairs):
        cells = window3x3(lat, lon)
        if cells is None:
            continue
        m = c = 0
        dates = {}
        for p, cell in enumerate(cells, 1):
            conf, day = raster[cell]
            d = day if conf == 3 else 0
            treat = d - buffer > s1 and d < s2
            ctrl = d != 0 and (d < s1 or d - buffer > s2)
            assert not (treat and ctrl)
            m, c = m + treat, c + ctrl
            if treat or ctrl:
                dates[p] = d
        expected[k] = (m, c, {p: d for p, d in dates.items() if d})
    alerts = spark.createDataFrame([("t", r, c, *v) for (r, c), v in raster.items()], "tile string, row int, col int, confidence int, day int")
    out = overlay_alerts(pair_rows(spark, pairs, "t1_days", "t2_days"), alerts, tiles(spark), buffer)
    assert collect_hits(out, 9) == expected


def test_intact(spark):
    rnd = random.Random(9)
    marked = {(2, 3): {2021: 4}, (5, 0): {2019: 6}}
    pairs = random_pairs(rnd, 200, 2019, 2022)
    out = intact_pairs(pair_rows(spark, pairs, "t1_year", "t2_year"), yearly_pixels(spark, marked), tiles(spark))
    expected = {k for k, (_, _, lat, lon) in enumerate(pairs) if (w := window3x3(lat, lon)) and not set(w) & set(marked)}
    assert {r.t1_shot_number for r in out.collect()} == expected and expected


def test_pairs_without_pixels_are_not_intact(spark):
    df = pair_rows(spark, [(2019, 2021, 2.0, 2.0), (2019, 2021, 3.0, 4.0)], "t1_year", "t2_year")
    whole = yearly_pixels(spark, {})

    def intact(pixels):
        return sorted(r.t1_shot_number for r in intact_pairs(df, pixels, tiles(spark)).collect())

    assert intact(whole) == [0, 1]
    assert intact(whole.limit(0)) == []
    assert intact(whole.where("not (row = 1 and col = 1)")) == [1]
    assert intact(whole.withColumn("vals", F.slice("vals", 1, 3))) == []


def test_overlapping_tiles_and_own_overlay(spark):
    """A pair in two tiles appears once per tile; any function can serve as overlay."""
    two = tiles(spark).union(tiles(spark, name="u"))
    df = pair_rows(spark, [(2019, 2021, 2.5, 2.5)], "t1_year", "t2_year")
    out = overlay_yearly(df, yearly_pixels(spark, {(2, 2): {2020: 2}}), two, YEARS)
    assert sorted((r.tile, r.measured_disturbance) for r in out.collect()) == [("t", 1), ("u", 0)]
    assert run_overlay(df, two, lambda placed, k: placed.where(F.col("nx") == k), k=COLS).count() == 2


@pytest.mark.parametrize("size", [2, 3, 64])
def test_windows_come_from_one_block(spark, size):
    """Whatever the block size: windows at block rims, unlisted pixels, arrays as values, tiles without pixels."""
    rnd = random.Random(size)
    n = 11
    value = {(t, r, c): [r, c] for t in "ab" for r in range(n) for c in range(n) if rnd.random() < 0.6}
    pixels = spark.createDataFrame([(*k, v, sum(v)) for k, v in value.items()], "tile string, row int, col int, v array<int>, s int")
    points = [(t, r, c) for t in "abc" for r in range(n - 1) for c in range(n - 1)]
    df = spark.createDataFrame(points, "tile string, wrow int, wcol int")
    for window, low in ((1, 0), (2, 0), (3, -1)):
        offsets = [(dr, dc) for dc in range(low, low + window) for dr in range(low, low + window)]
        got = {(x.tile, x.wrow, x.wcol): (x.v, x.s) for x in attach_windows(df, pixels, window, ["v", "s"], size=size).collect()}
        for t, r, c in points:
            want = [value.get((t, r + dr, c + dc)) for dr, dc in offsets]
            assert got[t, r, c] == (want, [None if w is None else sum(w) for w in want])


def test_stored_blocks_are_pruned_by_tile(spark, tmp_path):
    grid = [(f"0{t}", r, c, [1]) for t in range(12) for r in range(0, SIZE + 2, 5) for c in range(0, 9, 4)]
    raster = store_blocks(to_blocks(spark.createDataFrame(grid, "tile string, row int, col int, vals array<int>"), ["vals"]), str(tmp_path / "r"))
    assert raster.schema["tile"].dataType.simpleString() == "string" and {r.tile for r in raster.select("tile").collect()} == {g[0] for g in grid}
    points = spark.createDataFrame([("03", 5, 4), ("03", 6, 5), ("011", SIZE + 1, 8), ("99", 1, 1)], "tile string, wrow int, wcol int")
    asked = materialise(asked_blocks(points))
    kept = only_blocks(raster, asked)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert sorted((r.tile, r.brow) for r in kept.collect()) == [("011", 1), ("03", 0)]
    seen = {(r.tile, r.wrow): r.vals for r in attach_windows(points, raster, 1, ["vals"], asked=asked).collect()}
    assert seen == {("03", 5): [[1]], ("03", 6): [None], ("011", SIZE + 1): [[1]], ("99", 1): [None]}


def test_overlays_run_no_job_before_an_action(spark):
    started = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    df = pair_rows(spark, [(2019, 2021, 2.5, 2.5)], "t1_year", "t2_year")
    out = overlay_yearly(df, yearly_pixels(spark, {(2, 2): {2020: 2}}), tiles(spark), YEARS)
    assert not started.getJobIdsForGroup("lazy")
    assert out.count() == 1 and started.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sparse_alerts_keep_pairs_with_an_alert_only(spark):
    alerts = spark.createDataFrame([("t", 2, 2, 3, 50), ("t", 4, 4, 1, 60)], "tile string, row int, col int, confidence int, day int")
    df = pair_rows(spark, [(0, 99, 2.0, 2.0), (0, 99, 4.0, 5.0), (0, 99, 1.0, 5.0)], "t1_days", "t2_days")
    for confidence, kept in ((3, [0]), (None, [0, 1])):
        out = overlay_alerts(df, alerts, tiles(spark), 0, confidence=confidence, sparse=True)
        assert sorted(r.t1_shot_number for r in out.collect()) == kept
        whole = overlay_alerts(df, alerts, tiles(spark), 0, confidence=confidence).where("measured_disturbance > 0")
        assert sorted(r.t1_shot_number for r in whole.collect()) == kept


def test_descending_axis(spark):
    """On a descending y axis the window is the one around the point."""
    flipped = spark.createDataFrame(
        [("t", 0.0, 6.0, 1.0, -1.0, COLS, ROWS, -1.0, -1.0, 8.0, 7.0)],
        "tile string, x0 double, y0 double, dx double, dy double, nx int, ny int, xmin double, ymin double, xmax double, ymax double",
    )
    df = pair_rows(spark, [(2019, 2021, 3.4, 2.5)], "t1_year", "t2_year")
    w = window2(assign_tile(df, flipped)).first()
    # Latitude 3.4 lies in row 2 (3..4); its nearer neighbour is row 3 (2..3).
    assert (w.wrow, w.near_row, w.wcol, w.near_col) == (2, 0, 2, 0)


def test_burn(spark):
    burns = spark.createDataFrame([("t", 2, 2, [0, 100, 0, 0])], "tile string, row int, col int, days array<int>")
    rows = [(1, 2, 2.0, 2.0, "2020-01-01 00:00:00", "2020-06-01 00:00:00"), (3, 4, 2.0, 2.0, "2020-05-01 00:00:00", "2020-06-01 00:00:00"), (5, 6, 4.0, 4.0, "2020-01-01 00:00:00", "2020-06-01 00:00:00")]
    df = spark.createDataFrame(rows, "t1_shot_number long, t2_shot_number long, t2_lon double, t2_lat double, a string, b string").selectExpr(
        "t1_shot_number", "t2_shot_number", "t2_lon", "t2_lat", "timestamp(a) t1_absolute_time", "timestamp(b) t2_absolute_time"
    )
    out = {r.t1_shot_number: (r.burn_bool_2020, r.interceding_burn) for r in overlay_burn(df, burns, tiles(spark), YEARS).collect()}
    assert out == {1: (True, True), 3: (False, False), 5: (False, False)}
