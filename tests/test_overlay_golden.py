"""Hand-derived overlay cases (FIXTURES.md part 1)."""

import pytest
from pyspark.sql import functions as F

from rasters import COLS, ROWS, collect_hits, pair_rows, tiles, yearly_pixels
from twinshot.operators.overlay import overlay_alerts, overlay_intensity, overlay_yearly

YEARS = [2019, 2020, 2021, 2022]

D20, D21 = {2020: 2}, {2021: 2}
YEARLY = {
    "treat_1px": (
        {(2, 2): {**D20, **D21}},
        [(2019, 2021, 2.5, 2.5), (2019, 2021, 5.1, 1.1), (2019, 2021, 5.7, 4.5)],
        {0: (1, 0, {1: 2020}), 1: (0, 0, {})},
    ),
    "treat_2px": (
        {(2, 2): {**D20, **D21}, (3, 3): D21},
        [(2019, 2021, 2.5, 2.5), (2019, 2021, 3.9, 4.2), (2019, 2022, 3.1, 3.1)],
        {0: (1, 0, {1: 2020}), 1: (0, 0, {}), 2: (2, 0, {1: 2021, 4: 2020})},
    ),
    "control_1px": (
        {(2, 2): D21},
        [(2019, 2020, 2.5, 2.5), (2019, 2021, 2.5, 2.1), (2019, 2021, 5.7, 4.5)],
        {0: (0, 1, {1: 2021}), 1: (0, 0, {})},
    ),
    "control_2px": (
        {(2, 2): {**D20, **D21}, (3, 3): {2019: 2}, (2, 3): D21},
        [(2021, 2022, 2.5, 2.5), (2019, 2021, 3.9, 4.2), (2022, 2022, 3.1, 3.1)],
        {0: (0, 1, {1: 2020}), 1: (0, 0, {}), 2: (0, 2, {2: 2021, 4: 2020})},
    ),
}


@pytest.mark.parametrize("case", YEARLY)
def test_yearly(spark, case):
    marked, pairs, expected = YEARLY[case]
    out = overlay_yearly(pair_rows(spark, pairs, "t1_year", "t2_year"), yearly_pixels(spark, marked), tiles(spark), YEARS)
    assert collect_hits(out, 4) == expected


DAYS = {
    "treat_1px": (
        {(2, 2): 20001},
        [(19001, 20002, 2.5, 2.5), (19001, 19002, 5.1, 1.1), (19001, 22000, 4.3, 4.5)],
        {0: (1, 0, {5: 20001}), 2: (0, 0, {})},
    ),
    "treat_2px": (
        {(2, 2): 20001, (2, 3): 19364},
        [(19001, 20002, 2.5, 2.5), (19001, 19002, 5.1, 1.1), (19001, 22000, 5.7, 4.5)],
        {0: (2, 0, {5: 20001, 8: 19364})},
    ),
    "control_1px": (
        {(2, 2): 20001},
        [(19001, 19002, 2.5, 2.5), (19001, 19002, 5.1, 1.1), (19001, 22000, 5.7, 4.5)],
        {0: (0, 1, {5: 20001})},
    ),
    "control_2px": (
        {(2, 2): 20001, (2, 3): 19001},
        [(19002, 19364, 2.5, 2.5), (19002, 19364, 5.1, 1.1), (19002, 22000, 5.7, 4.5)],
        {0: (0, 2, {5: 20001, 8: 19001})},
    ),
    "control_treat": (
        {(2, 2): 20001, (2, 3): 21001, (2, 4): 22001, (3, 4): 19364},
        [(19001, 20002, 2.5, 2.5), (19001, 19002, 3.1, 3.0), (19001, 22000, 2.7, 4.5)],
        {
            0: (1, 1, {5: 20001, 8: 21001}),
            1: (0, 4, {1: 20001, 4: 21001, 7: 22001, 8: 19364}),
            2: (2, 1, {1: 21001, 4: 22001, 5: 19364}),
        },
    ),
}


@pytest.mark.parametrize("case", DAYS)
def test_days(spark, case):
    marked, pairs, expected = DAYS[case]
    alerts = spark.createDataFrame(
        [("t", r, c, 1, d) for (r, c), d in marked.items()], "tile string, row int, col int, confidence int, day int"
    )
    out = overlay_alerts(
        pair_rows(spark, pairs, "a", "b"), alerts, tiles(spark), buffer_days=0, confidence=None, start="a", end="b"
    )
    assert collect_hits(out, 9) == expected


def test_intensity(spark):
    observed = {(2, 2): ([0, 12, 12, 12], [0, 32, 32, 32]), (3, 3): ([0, 0, 10, 0], [0, 0, 25, 0]), (1, 2): ([0, 0, 0, 4], [0, 0, 0, 8])}
    pixels = spark.createDataFrame(
        [("t", r, c, *observed.get((r, c), ([0] * 4, [0] * 4))) for r in range(ROWS) for c in range(COLS)],
        "tile string, row int, col int, disrupt array<int>, valid array<int>",
    )
    cases = [((2020, 0, 2022, 0), 2.4, 2.4, 0.875), ((2021, 0, 0, 2020), 3.1, 3.1, 0.775), ((0, 2020, 0, 2022), 2.1, 1.5, 0.875)]
    pairs = spark.createDataFrame(
        [(i, 1000 + i, lon, lat, *ps) for i, (ps, lat, lon, _) in enumerate(cases)],
        "t1_shot_number long, t2_shot_number long, t2_lon double, t2_lat double, "
        + ", ".join(f"p{i}_disturb_date int" for i in (1, 2, 3, 4)),
    )
    out = overlay_intensity(pairs, pixels, tiles(spark), 2019, pixel_order="yx").orderBy("t1_shot_number").collect()
    assert [round(r["disturb_intensity"] * 4, 5) for r in out] == [c[3] for c in cases]
    # In producer order p2 and p3 trade places.
    swapped = pairs.withColumns({"p2_disturb_date": F.col("p3_disturb_date"), "p3_disturb_date": F.col("p2_disturb_date")})
    out = overlay_intensity(swapped, pixels, tiles(spark), 2019).orderBy("t1_shot_number").collect()
    assert [round(r["disturb_intensity"] * 4, 5) for r in out] == [c[3] for c in cases]
