"""Overlays by a caller's rule: equal to the native ones, and windows as arrays."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasters import collect_hits, pair_rows, tiles, yearly_pixels
from twinshot.operators.overlay import overlay_yearly
from twinshot.operators.vectorised import overlay_by_rule, window_array

YEARS = [2019, 2020, 2021, 2022]
NAMES = ["measured_disturbance", "control_disturbance", *[f"p{i}_disturb_date" for i in range(1, 5)]]
ADDS = ", ".join(f"{n} int" for n in NAMES)


def yearly(batch):
    met = window_array(batch.column("vals"), (4, 4)) == 2
    first = np.where(met.any(axis=2), 2019 + met.argmax(axis=2), 2018)
    t1, t2 = (batch.column(c).to_numpy()[:, None] for c in ("t1_year", "t2_year"))
    inside = (t1 < first) & (first < t2)
    outside = ((t2 < first) | (t1 > first)) & (first > 2019) & ~inside
    dates = np.where(inside | outside, first, 0).astype("int32")
    return dict(zip(NAMES, [inside.sum(axis=1).astype("int32"), outside.sum(axis=1).astype("int32"), *dates.T]))


def cases(spark, n=200):
    rnd = random.Random(21)
    pairs = [(*sorted((rnd.randint(2018, 2023), rnd.randint(2018, 2023))), rnd.uniform(-0.5, 6.5), rnd.uniform(-0.5, 7.5)) for _ in range(n)]
    marked = {(r, c): {y: 2 for y in YEARS if rnd.random() < 0.4} for r in range(6) for c in range(7)}
    # Some pixels aren't listed at all.
    pixels = yearly_pixels(spark, marked).where("(row * 5 + col * 3) % 7 <> 1")
    return pair_rows(spark, pairs, "t1_year", "t2_year"), pixels


def test_rule_equals_the_native_overlay(spark):
    pairs, pixels = cases(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = overlay_by_rule(pairs, pixels, tiles(spark), ["vals"], yearly, ADDS)
        native = overlay_yearly(pairs, pixels, tiles(spark), YEARS)
        assert got.columns == [*pairs.columns, "tile", *NAMES]
        assert collect_hits(got, 4) == collect_hits(native, 4) != {}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert overlay_by_rule(pairs.limit(0), pixels, tiles(spark), ["vals"], yearly, ADDS).count() == 0
    # Without any pixel every window is empty, and every event year that before the first map.
    none = overlay_by_rule(pairs, pixels.limit(0), tiles(spark), ["vals"], yearly, ADDS)
    assert collect_hits(none, 4) == collect_hits(overlay_yearly(pairs, pixels.limit(0), tiles(spark), YEARS), 4)


def test_rule_on_three_by_three_windows(spark):
    pairs, pixels = cases(spark, 60)
    plain = pixels.select("tile", "row", "col", (F.col("row") * 10 + F.col("col")).alias("value"))
    got = overlay_by_rule(pairs, plain, tiles(spark), ["value"], lambda b: {"most": window_array(b.column("value"), (9,), -1).max(axis=1)}, "most int", 3)
    assert {r.most for r in got.collect()} <= set(range(57)) and got.count() > 10


def test_rule_that_is_wrong_fails(spark):
    pairs, pixels = cases(spark, 20)
    with pytest.raises(Exception, match="values in every column"):
        overlay_by_rule(pairs, pixels, tiles(spark), ["vals"], lambda b: {"a": np.zeros(b.num_rows + 1)}, "a double").collect()
    with pytest.raises(ValueError, match="both inputs"):
        overlay_by_rule(pairs, pixels, tiles(spark), ["vals"], yearly, "t1_year int")
    with pytest.raises(ValueError, match="2 x 2 or 3 x 3"):
        overlay_by_rule(pairs, pixels, tiles(spark), ["vals"], yearly, ADDS, window=5)


def test_windows_as_arrays():
    one = pa.array([[1, None], None, [3, 4]], pa.list_(pa.int32()))
    assert window_array(one, (2,), -1).tolist() == [[1, -1], [-1, -1], [3, 4]]
    assert window_array(one.slice(1), (2,), -1).tolist() == [[-1, -1], [3, 4]]
    two = pa.array([[[1, 2], None], [[5, 6], [7, None]]], pa.list_(pa.list_(pa.int32())))
    assert window_array(two, (2, 2)).tolist() == [[[1, 2], [0, 0]], [[5, 6], [7, 0]]]
    assert window_array(two.slice(0, 0), (2, 2)).shape == (0, 2, 2)
    with pytest.raises(ValueError, match="3 expected"):
        window_array(one, (3,))
