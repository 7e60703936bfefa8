"""Overlays are one static join per pair, so pairs may also arrive as a stream."""

from rasters import collect_hits, pair_rows, tiles, yearly_pixels
from twinshot.operators.overlay import overlay_yearly

YEARS = [2019, 2020, 2021, 2022]


def test_overlay_of_a_stream(spark, tmp_path):
    pairs = pair_rows(spark, [(2019, 2021, 2.5, 2.5), (2019, 2022, 3.1, 3.1)], "t1_year", "t2_year")
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    px = yearly_pixels(spark, {(2, 2): {2020: 2}, (3, 3): {2021: 2}})
    out = overlay_yearly(stream, px, tiles(spark), YEARS)
    query = (
        out.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = collect_hits(spark.read.parquet(str(tmp_path / "out")), 4)
    assert got == collect_hits(overlay_yearly(pairs, px, tiles(spark), YEARS), 4) and len(got) == 2
