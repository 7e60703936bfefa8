"""Small rasters for the hand-derived fixtures: 6 rows, 7 columns, integer coordinates."""

from pyspark.sql import functions as F

ROWS, COLS = 6, 7


def tiles(spark, anchor="edge", name="t"):
    return spark.createDataFrame(
        # The extent is wider than the pixels so that points beyond the border reach the edge test.
        [(name, 0.0, 0.0, 1.0, 1.0, COLS, ROWS, -1.0, -1.0, 8.0, 7.0)],
        "tile string, x0 double, y0 double, dx double, dy double, nx int, ny int, "
        "xmin double, ymin double, xmax double, ymax double",
    )


def pair_rows(spark, pairs, start, end):
    rows = [(i, 1000 + i, float(lon), float(lat), int(a), int(b)) for i, (a, b, lat, lon) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, f"t1_shot_number long, t2_shot_number long, t2_lon double, t2_lat double, {start} int, {end} int"
    )


def yearly_pixels(spark, marked, years=(2019, 2020, 2021, 2022), default=1):
    rows = [
        ("t", r, c, [marked.get((r, c), {}).get(y, default) for y in years]) for r in range(ROWS) for c in range(COLS)
    ]
    return spark.createDataFrame(rows, "tile string, row int, col int, vals array<int>")


def collect_hits(df, n):
    cols = ["measured_disturbance", "control_disturbance", *[f"p{i + 1}_disturb_date" for i in range(n)]]
    out = {}
    for r in df.orderBy("t1_shot_number").collect():
        dates = {i + 1: r[f"p{i + 1}_disturb_date"] for i in range(n) if r[f"p{i + 1}_disturb_date"]}
        out[r["t1_shot_number"]] = (r[cols[0]], r[cols[1]], dates)
    return out
