"""Readers, writers, raster tables, regions and the end-to-end jobs on small files."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rasters import tiles, yearly_pixels
from twinshot import schemas
from twinshot.functions import geo as G
from twinshot.operators import raster as R
from twinshot.operators import region as Z
from twinshot.operators.keys import join_groups, materialise
from twinshot.plans import jobs
from twinshot.sources import ingest


def test_wkb(spark):
    values = [(-60.25, -4.5), (0.0, -0.0), (1e-310, 180.0), (math.pi, -math.e)]
    rows = []
    for i, (x, y) in enumerate(values):
        rows.append((4 * i, bytearray(struct.pack("<BIdd", 1, 1, x, y)), x, y))
        rows.append((4 * i + 1, bytearray(struct.pack(">BIdd", 0, 1, x, y)), x, y))
        rows.append((4 * i + 2, bytearray(struct.pack("<BIIdd", 1, 0x20000001, 4326, x, y)), x, y))
        rows.append((4 * i + 3, bytearray(struct.pack("<BIddd", 1, 1001, x, y, 9.0)), x, y))
    rows.append((100, bytearray(struct.pack("<BI", 1, 2)), None, None))
    rows.append((101, bytearray(struct.pack("<BIdd", 1, 1, math.nan, math.nan)), None, None))
    df = spark.createDataFrame(rows, "i int, geometry binary, x double, y double")
    for r in ingest.points_from_wkb(df).collect():
        assert (r.lon, r.lat) == (r.x, r.y)


def test_csv_metrics(spark, tmp_path):
    names = [f.name for f in schemas.METRIC_SCHEMA.fields]
    shuffled = names[1:] + names[:1] + ["extra"]
    value = {n: "3" for n in shuffled}
    (tmp_path / "m.csv").write_text(",".join(shuffled) + "\n" + ",".join(value[n] for n in shuffled) + "\n")
    df = ingest.read_metrics(spark, str(tmp_path))
    assert df.schema.simpleString() == schemas.METRIC_SCHEMA.simpleString()
    assert df.first()["shot_num"] == 3 and df.first()["pai_50"] == 3.0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "m.csv").write_text("shot_num\n1\n")
    with pytest.raises(ValueError):
        ingest.read_metrics(spark, str(tmp_path / "bad"))


def test_jdbc_options():
    good = {"numPartitions": 56, "partitionColumn": "geo_partition", "lowerBound": 0, "upperBound": 1000}
    options = ingest.jdbc_options("jdbc:x", "(select 1) as q", good)
    assert options["dbtable"] == "(select 1) as q" and options["numPartitions"] == "56" and "query" not in options
    with pytest.raises(ValueError):
        ingest.jdbc_options("jdbc:x", "t", {"numPartitions": 3})


def test_sinks(spark, tmp_path):
    df = spark.range(25)
    ingest.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exist"):
        ingest.write_table(df, str(tmp_path / "t"))
    ingest.write_table(df, str(tmp_path / "t"), overwrite=True)
    ingest.write_chunks(df.coalesce(1), str(tmp_path / "c"), rows=10)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3
    assert materialise(df, str(tmp_path / "m")).count() == 25
    assert materialise(df.where("id > 3")).count() == 21


def test_contracts(spark):
    df = spark.createDataFrame([], schemas.YEARLY_IN)
    assert schemas.require(df, schemas.YEARLY_IN) is df
    with pytest.raises(ValueError):
        schemas.require(df.drop("t1_year"), schemas.YEARLY_IN)


def test_join_groups_keeps_null_groups(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "g string, v int")
    groups = spark.createDataFrame([("a", 10), (None, 20)], "g string, n int")
    assert sorted(map(tuple, join_groups(rows, groups, ["g"]).collect()), key=str) == [("a", 1, 10), (None, 2, 20)]


def test_csv_folder_of_differing_headers(spark, tmp_path):
    """Two orders of the columns, and a file with a quoted column of its own, each value in its column."""
    names = [f.name for f in schemas.METRIC_SCHEMA.fields]
    orders = (names, names[:1] + names[1:][::-1], [*names[3:], '"more, or less"', *names[:3]])
    for i, order in enumerate(orders):
        cells = ["x" if '"' in n else "b" if n == "beam" else str(names.index(n) + i) for n in order]
        (tmp_path / f"m{i}.csv").write_text(",".join(order) + "\n" + ",".join(cells) + "\n")
    got = sorted(ingest.read_metrics(spark, str(tmp_path)).collect(), key=lambda r: r.shot_num)
    assert [[r[n] for n in names if n != "beam"] for r in got] == [[names.index(n) + i for n in names if n != "beam"] for i in range(3)]


def test_work_folder_is_gone_afterwards(spark):
    from pathlib import Path

    from twinshot.operators.keys import work_folder

    with work_folder(spark) as at:
        assert materialise(spark.range(5)).count() == 5
        folder = Path(at.removeprefix("file:"))
        assert len(list(folder.iterdir())) == 1
    assert not folder.exists()
    with pytest.raises(ValueError), work_folder(spark) as at:
        materialise(spark.range(5))
        raise ValueError
    assert not Path(at.removeprefix("file:")).exists()


def test_tiles_of_very_different_sizes(spark):
    """Tiles of 1 degree, one of 100 degrees over them and a sliver: each point finds all of its tiles."""
    side = 6
    boxes = {f"{i},{j}": (float(i), float(j), i + 1.0, j + 1.0) for i in range(side) for j in range(side)}
    boxes |= {"wide": (-50.0, -50.0, 50.0, 50.0), "sliver": (2.0, -3.0, 2.001, 9.0), "far": (170.0, 10.0, 170.5, 10.25)}
    grid = spark.createDataFrame(
        [(t, x0, y0, 0.1, 0.1, 10, 10, x0, y0, x1, y1) for t, (x0, y0, x1, y1) in boxes.items()],
        "tile string, x0 double, y0 double, dx double, dy double, nx int, ny int, xmin double, ymin double, xmax double, ymax double",
    )
    rnd = random.Random(8)
    spots = [(k, rnd.uniform(-1, 7), rnd.uniform(-1, 7)) for k in range(200)] + [(900, 1.0, 1.5), (901, 2.0005, -1.0), (902, -20.0, 49.0), (903, 170.2, 10.1), (904, None, 1.0)]
    points = spark.createDataFrame(spots, "k int, t2_lon double, t2_lat double")
    got = sorted((r.k, r.tile) for r in R.assign_tile(points, grid).collect())
    want = sorted((k, t) for k, x, y in spots if x is not None for t, (x0, y0, x1, y1) in boxes.items() if x0 < x < x1 and y0 < y < y1)
    assert got == want and any(t == "sliver" for _, t in want)
    assert R.assign_tile(points, grid.limit(0)).count() == 0


def _inside(p, ring):
    hit = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            hit = not hit
    return hit


def test_region(spark):
    rnd = random.Random(12)
    star = [(math.cos(k / 40 * math.tau) * r, math.sin(k / 40 * math.tau) * r) for k, r in enumerate([10, 4] * 20)]
    hole = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    points = [(i, rnd.uniform(-11, 11), rnd.uniform(-11, 11)) for i in range(1500)]
    df = spark.createDataFrame(points, "i int, lon double, lat double")
    got = {r.i for r in Z.within_region(df, star).collect()}
    assert got == {i for i, *p in points if _inside(p, star)}
    got = {r.i for r in Z.within_region(df, [star, hole]).collect()}
    assert got == {i for i, *p in points if _inside(p, star) and not _inside(p, hole)}
    chunks = Z.chunk_region(spark, star, 2, 2).collect()
    boxes = {(r.xmin, r.ymin) for r in chunks}
    # Every inside point lies in a kept chunk; chunks are named by their top left corner.
    for i, x, y in points:
        if _inside((x, y), star):
            low = math.floor(min(p[0] for p in star)), math.floor(min(p[1] for p in star))
            assert ((x - low[0]) // 2 * 2 + low[0], (y - low[1]) // 2 * 2 + low[1]) in boxes
    assert "N2_W2" in {r.name for r in chunks if (r.xmin, r.ymin) == (-2, 0)} or (-2, 0) not in boxes


def test_raster_tables(spark):
    px = yearly_pixels(spark, {(1, 1): {2020: 2}})
    long = px.select("tile", "row", "col", F.posexplode("vals").alias("i", "value")).withColumn("year", F.col("i") + 2019)
    stacked = R.stack_bands(long, [2019, 2020, 2021, 2022])
    assert stacked.exceptAll(px).count() == 0 and stacked.count() == px.count()
    code = px.select("tile", "row", "col", F.when(F.col("row") == 1, 31234).otherwise(0).alias("value"))
    mask = px.select("tile", "row", "col", (F.col("col") != 2).cast("int").alias("mask"))
    alerts = R.split_alerts(code, mask)
    assert {(r.confidence, r.day) for r in alerts.collect()} == {(3, 1234)} and alerts.count() == 6
    index = R.tile_index(px, tiles(spark).select("tile", "x0", "y0", "dx", "dy")).first()
    assert (index.nx, index.ny, index.xmax, index.ymin) == (7, 6, 7.0, 0.0)
    box = R.crop_pixels(code, R.tile_index(px, tiles(spark).select("tile", "x0", "y0", "dx", "dy")), (0.0, 0.0, 2.0, 2.0), nodata=0)
    assert sorted((r.row, r.col, r.value) for r in box.collect()) == [(0, 0, None), (0, 1, None), (1, 0, 31234), (1, 1, 31234)]


def test_indices_match_their_definition(spark):
    axes = [(0.0, 1.0, 6), (5.0, -1.0, 6), (-60.0, 0.25, 9)]
    for x0, dx, n in axes:
        values = [x0 + dx * k / 4 for k in range(-8, 4 * n + 8)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        args = (F.col("v"), F.lit(x0), F.lit(dx), F.lit(n))
        got = df.select("v", G.nearest_index(*args).alias("a"), G.two_nearest_index(*args).alias("b")).collect()
        for r in got:
            at = [abs(x0 + dx * i - r.v) for i in range(n)]
            assert r.a == at.index(min(at))
            centre = [abs(x0 + dx * (i + 0.5) - r.v) for i in range(n)]
            i = centre.index(min(centre))
            toward = (r.v - (x0 + dx * (i + 0.5))) / dx
            assert list(r.b) == [i, i - 1 if toward < 0 else i + 1]


def test_jobs(spark, tmp_path):
    rnd = random.Random(21)
    p = lambda name: str(tmp_path / name)
    times = ["2019-03-01", "2020-07-01", "2021-08-01", "2022-05-01"]
    shots = []
    for i in range(400):
        k = i % 25
        lon, lat = 1.5 + (k % 5) * 0.8 + rnd.uniform(0, 2e-4), 1.5 + (k // 5) * 0.6 + rnd.uniform(0, 2e-4)
        shots.append((i, lon, lat, times[i // 100], int(rnd.random() > 0.1)))
    spark.createDataFrame(shots, "shot_number long, lon double, lat double, t string, l4_quality_flag int").withColumn(
        "absolute_time", F.to_timestamp("t")
    ).drop("t").write.parquet(p("shots"))
    ring = [(1.0, 1.0), (6.0, 1.0), (6.0, 4.5), (1.0, 4.5)]
    jobs.find_pairs(jobs.configure(spark), p("shots"), p("pairs"), ring)
    pairs = spark.read.parquet(p("pairs"))
    assert pairs.count() > 100 and pairs.where("geo_partition not between 0 and 999").count() == 0

    names = [f.name for f in schemas.METRIC_SCHEMA.fields]
    metrics = spark.range(400).select(*[(F.col("id") if n == "shot_num" else F.lit(0) if n == "outlier_umd" else (F.col("id") % 17 + 1)).alias(n) for n in names])
    metrics.write.option("header", True).csv(p("metrics"))
    jobs.add_metrics(spark, p("pairs"), p("metrics"), p("enriched"))
    assert spark.read.parquet(p("enriched")).count() == pairs.count()

    marked = {(r, c): {2020: 2, 2021: rnd.choice([2, 3])} for r in range(6) for c in range(7) if (r + c) % 3 == 0}
    yearly_pixels(spark, marked).write.parquet(p("yearly_px"))
    jobs.yearly_degradation(spark, p("enriched"), p("yearly_px"), tiles(spark), p("yearly"), [2019, 2020, 2021, 2022])
    yearly = spark.read.parquet(p("yearly"))
    assert yearly.count() > 0
    schemas.require(yearly, schemas.YEARLY_OUT)

    px = yearly_pixels(spark, {}).select("tile", "row", "col", F.array(*[F.lit(2)] * 4).alias("disrupt"), F.array(*[F.lit(4)] * 4).alias("valid"))
    px.write.parquet(p("intensity_px"))
    jobs.disturbance_intensity(spark, p("yearly"), p("intensity_px"), tiles(spark), p("intensity"), 2019)
    for r in spark.read.parquet(p("intensity")).collect():
        dates = [r[f"p{i}_disturb_date"] for i in range(1, 5)]
        assert r.disturb_intensity == pytest.approx(0.5 * sum(d > 0 for d in dates) / 4)

    alerts = spark.createDataFrame([("t", r, c, 3, 2100) for r, c in marked], "tile string, row int, col int, confidence int, day int")
    alerts.write.parquet(p("alerts"))
    jobs.alert_degradation(spark, p("enriched"), p("alerts"), tiles(spark), p("alerted"), buffer_days=30)
    schemas.require(spark.read.parquet(p("alerted")), schemas.ALERT_OUT)
    jobs.intact_controls(spark, p("enriched"), p("yearly_px"), tiles(spark), p("intact"))
    assert spark.read.parquet(p("intact")).count() == 0  # every 3 x 3 window meets a marked pixel
    frame = jobs.analysis_frame(yearly)
    assert frame.groupBy("sample_grp", "t1_shot_number").count().where("count > 1").count() == 0
