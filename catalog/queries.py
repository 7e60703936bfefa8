"""Registered queries: each composes library operators over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import data as D
from twinshot.functions import geo as G
from twinshot.functions import scalar as S
from twinshot.operators import cohort as C
from twinshot.operators import inference as I
from twinshot.operators import overlay as O
from twinshot.operators import pairs as P
from twinshot.operators import profiles as V
from twinshot.operators import raster as R
from twinshot.operators import region as Z
from twinshot.operators import stats as A
from twinshot.operators.colocated import buckets_for, store_bucketed
from twinshot.operators.keys import materialise, new_folder
from twinshot.operators.vectorised import overlay_by_rule, window_array
from twinshot.plans import jobs
from twinshot.schemas import METRIC_SCHEMA
from twinshot.sources.ingest import points_from_wkb, read_metrics, read_pairs, write_chunks, write_table

Query = DataFrame
KEYS = P.PAIR_KEYS
QUERIES: dict = {}

# Bin edges and lag bands.
INTENSITY_BINS = [0, 0.025, 0.05, 0.075, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
COARSE_BINS = [0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
LAGS_ALL = [1100, 1000, 900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 100, 50, 0]
LAGS_CONTROL = [1200, 1000, 900, 800, 700, 600, 500, 400, 300, 200, 100, 50, 0]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or c)


# ----- sources, projections, filters ------------------------------------------------


@query
def points_from_wkb_bytes(spark: SparkSession, sf: str) -> Query:
    """WKB points assembled from md5 digits, in both byte orders, decoded to lon and lat."""
    o = D.table(spark, sf, "orders", "o_orderkey")

    def digits(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.substring(F.md5(F.concat(F.lit(key), F.col("o_orderkey").cast("string")).cast("binary")), 1, 13))

    def swap(h: Column) -> Column:
        return F.concat(*[F.substring(h, 1 + 2 * (7 - b), 2) for b in range(8)])

    x, y = digits("c04", "x"), digits("c01", "y")
    little = F.concat(F.lit("0101000000"), swap(x), swap(y))
    big = F.concat(F.lit("0000000001"), x, y)
    with_srid = F.concat(F.lit("0101000020e6100000"), swap(x), swap(y))
    kind = F.col("o_orderkey") % 3
    wkb = F.unhex(F.when(kind == 0, little).when(kind == 1, big).otherwise(with_srid))
    decoded = points_from_wkb(o.withColumn("geometry", wkb))
    return decoded.select("o_orderkey", r6("lon", digits=9), r6("lat", digits=9))


@query
def tile_tokens_from_paths(spark, sf):
    c = D.table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    paths = c.withColumn(
        "path",
        F.when(
            F.col("c_nationkey") % 2 == 0,
            F.concat(F.lit("maps/yearly_2021_SAM_ID"), F.col("c_nationkey").cast("string"), F.lit("_"), "c_mktsegment", F.lit(".tif")),
        ).otherwise(F.concat(F.lit("maps/valid_obs_S9_W"), (F.col("c_nationkey") + 60).cast("string"), F.lit("-0000016384-0000000000.tif"))),
    )
    yearly = R.tile_tokens(paths, r"SAM_(.*)\.tif")
    both = yearly.withColumn(
        "tile", F.when(F.col("tile") != "", F.col("tile")).otherwise(F.regexp_extract("path", r"([a-z]+_obs)_([SN]\d+_[WE]\d+(-\d+-\d+)?)", 2))
    )
    return R.duplicate_tiles(both)


@query
def tile_index(spark, sf):
    t = R.tile_index(D.grid(spark, sf), D.geo(spark, sf))
    return t.select("tile", "nx", "ny", *[r6(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query
def stack_yearly_bands(spark, sf):
    px = D.yearly_pixels(spark, sf)
    long = px.select("tile", "row", "col", F.posexplode("vals").alias("i", "value")).withColumn("year", F.col("i") + 1996)
    stacked = R.stack_bands(long, D.YEARS)
    return stacked.select("tile", "row", "col", *[F.get("vals", F.lit(i)).alias(f"y{y}") for i, y in enumerate(D.YEARS)])


@query
def prefixed_shots(spark, sf):
    s = P.quality_shots(D.shots(spark, sf)).select("shot_number", "lon", "lat", "l4_quality_flag")
    return P.prefixed(s, "t1_").select("t1_shot_number", r6("t1_lon"), r6("t1_lat"), "t1_l4_quality_flag")


@query
def shots_in_region(spark, sf):
    s = D.shots(spark, sf).select("shot_number", "lon", "lat")
    return Z.within_region(s, D.REGION).select("shot_number")


@query
def shots_per_chunk(spark, sf):
    chunks = Z.chunk_region(spark, D.CHUNK_REGION)
    x, y = Z.chunk_key(F.col("lon"), F.col("lat"), D.CHUNK_REGION)
    n = D.shots(spark, sf).groupBy(x.alias("xmin"), y.alias("ymin")).agg(F.count("*").alias("shots"))
    return chunks.join(n, ["xmin", "ymin"], "left").select("name", "xmin", "ymin", F.coalesce("shots", F.lit(0)).alias("shots"))


@query
def utm_zones(spark, sf):
    """Zones and corner names of points spread over the globe."""
    o = D.table(spark, sf, "orders", "o_orderkey")
    p = o.select((D.unit("x", "o_orderkey") * 360 - 180).alias("lon"), (D.unit("y", "o_orderkey") * 180 - 90).alias("lat"))
    return p.groupBy(G.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg")).agg(F.count("*").alias("n"))


@query
def corner_names(spark, sf):
    o = D.table(spark, sf, "orders", "o_orderkey")
    lon, lat = D.unit("x", "o_orderkey") * 360 - 180, D.unit("y", "o_orderkey") * 180 - 90
    name = G.corner_name(F.floor(lon / 10) * 10, F.floor(lat / 10) * 10 + 10)
    return o.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query
def geo_partition_cells(spark, sf):
    """Partition ids depend on the 2-degree cell only and lie in range."""
    o = D.table(spark, sf, "orders", "o_orderkey")
    p = o.select((D.unit("x", "o_orderkey") * 360 - 180).alias("lon"), (D.unit("y", "o_orderkey") * 180 - 90).alias("lat"))
    cell = (F.col("lon") / 2).cast("int") * 360 + (F.col("lat") / 2).cast("int")
    part = G.geo_partition(F.col("lon"), F.col("lat"))
    return p.groupBy(cell.alias("cell")).agg(
        F.count("*").alias("n"), F.count_distinct(part).alias("partitions"), F.count_if((part < 0) | (part > 999)).alias("out_of_range")
    )


@query
def raster_indices(spark, sf):
    """Nearest, two nearest and floor index of every shot on its tile."""
    s = R.assign_tile(D.shots(spark, sf).select("shot_number", "lon", "lat"), D.tiles(spark, sf), "lon", "lat")
    x = (F.col("lon"), F.col("x0"), F.col("dx"))
    two = G.two_nearest_index(*x, F.col("nx"))
    return s.select(
        "shot_number",
        "tile",
        G.nearest_index(*x, F.col("nx")).alias("nearest"),
        two[0].alias("first"),
        two[1].alias("second"),
        G.floor_index(*x).alias("floor"),
    )


@query
def cropped_pixels(spark, sf):
    """Pixels of a box, with one class treated as nodata."""
    px = D.alert_codes(spark, sf).withColumn("value", (F.col("value") % 7).cast("double"))
    out = R.crop_pixels(px, D.tiles(spark, sf), (-59.99, -4.99, -59.98, -4.985), nodata=0.0)
    return out.select("tile", "row", "col", r6("lon"), r6("lat"), "value")


@query
def sampled_pairs(spark, sf):
    return C.hash_sample(D.pairs(spark, sf), fraction=0.1, hash="md5").select(*KEYS)


@query
def event_days(spark, sf):
    """Floored day differences, negative ones included."""
    e = D.table(spark, sf, "events", "event_id", "ts")
    pivot = F.lit("2024-01-15 12:30:00").cast("timestamp")
    return e.select("event_id", S.days_between(pivot, F.col("ts").cast("timestamp")).alias("days"))


@query
def shot_dates(spark, sf):
    s = D.shots(spark, sf).select("shot_number", F.col("absolute_time").alias("t1_absolute_time"), F.col("absolute_time").alias("t2_absolute_time"))
    d = O.with_year_days(O.with_years(O.with_days(s, D.EPOCH)))
    return d.select("shot_number", "t1_days", "t1_year", "t1_yyyydoy")


@query
def safe_ratio_means(spark, sf):
    """Relative differences with empty denominators left out."""
    li = D.table(spark, sf, "lineitem", "l_returnflag", "l_discount", "l_tax")
    q = S.ratio(F.col("l_tax") - F.col("l_discount"), F.col("l_tax") + F.col("l_discount"))
    return li.groupBy("l_returnflag").agg(F.count(q).alias("n"), r6(F.avg(q), "rel_diff"))


# ----- pairs ------------------------------------------------------------------------


@query
def near_pairs(spark, sf):
    return D.found_pairs(spark, sf).select(*KEYS, r6("distance_m", digits=4))


@query
def near_pairs_of_region(spark, sf):
    s = P.quality_shots(D.wide_shots(spark, sf)).select("shot_number", "lon", "lat")
    s = materialise(Z.within_region(s, D.REGION))
    return P.near_pairs(s, partition_col="geo_partition").select(*KEYS, r6("distance_m", digits=4))


@query
def enriched_pairs(spark, sf):
    p = D.pairs(spark, sf).select(*KEYS)
    e = P.enrich_pairs(p, D.shot_metrics(spark, sf))
    return e.select(*KEYS, *[r6(f"{t}_{m}") for t in ("t1", "t2") for m in ("agbd_a0", "rh_98_a0")])


@query
def enriched_pairs_colocated(spark, sf):
    """Pairs and metrics in buckets of their shots: the metrics stay where they are in both joins."""
    buckets = buckets_for(0, spark.sparkContext.defaultParallelism)
    metrics = store_bucketed(D.shot_metrics(spark, sf), "shot_num", buckets)
    p = store_bucketed(D.pairs(spark, sf).select(*KEYS), "t1_shot_number", buckets)
    e = P.enrich_pairs(p, metrics)
    return e.select(*KEYS, *[r6(f"{t}_{m}") for t in ("t1", "t2") for m in ("agbd_a0", "rh_98_a0")])


@query
def closer_than_30m(spark, sf):
    return P.closer_than(D.pairs(spark, sf), 30.0).select(*KEYS)


@query
def placed_pairs(spark, sf):
    return R.assign_tile(D.pairs(spark, sf), D.tiles(spark, sf)).select(*KEYS, "tile")


# ----- overlays ---------------------------------------------------------------------


@D.plan
def yearly(spark, sf, *columns: str) -> DataFrame:
    p = O.with_years(D.timed_pairs(spark, sf, *columns))
    return O.overlay_yearly(p, D.yearly_raster(spark, sf), D.tiles(spark, sf), D.YEARS, asked=D.asked(spark, sf, 2))


def alert_overlay(spark, sf, *columns: str, buffer: int = 0, sparse: bool = False) -> DataFrame:
    p = O.with_days(D.timed_pairs(spark, sf, *columns), D.EPOCH)
    return O.overlay_alerts(p, D.alert_raster(spark, sf), D.tiles(spark, sf), buffer, asked=D.asked(spark, sf, 3), sparse=sparse)


def _hits(n: int) -> list[str]:
    return ["measured_disturbance", "control_disturbance", *[f"p{i}_disturb_date" for i in range(1, n + 1)]]


@query
def overlay_yearly(spark, sf):
    return yearly(spark, sf).select(*KEYS, "tile", *_hits(4))


def yearly_rule(years: list[int], cls: int, names: list[str]):
    """The yearly rule on arrays."""

    def rule(batch):
        met = window_array(batch.column("vals"), (4, len(years))) == cls
        first = np.where(met.any(axis=2), years[0] + met.argmax(axis=2), years[0] - 1)
        t1, t2 = (batch.column(c).to_numpy()[:, None] for c in ("t1_year", "t2_year"))
        inside = (t1 < first) & (first < t2)
        outside = ((t2 < first) | (t1 > first)) & (first > years[0]) & ~inside
        dates = np.where(inside | outside, first, 0).astype("int32")
        counts = [hits.sum(axis=1).astype("int32") for hits in (inside, outside)]
        return dict(zip(names, [*counts, *dates.T]))

    return rule


@query
def overlay_yearly_by_rule(spark, sf):
    p = O.with_years(D.timed_pairs(spark, sf))
    rule, adds = yearly_rule(D.YEARS, O.DEGRADATION, _hits(4)), ", ".join(f"{c} int" for c in _hits(4))
    out = overlay_by_rule(p, D.yearly_raster(spark, sf), D.tiles(spark, sf), ["vals"], rule, adds, asked=D.asked(spark, sf, 2))
    return out.select(*KEYS, "tile", *_hits(4))


@query
def overlay_yearly_no_deforestation(spark, sf):
    p = O.with_years(D.timed_pairs(spark, sf))
    px = D.yearly_raster(spark, sf, deforestation=True)
    out = O.overlay_yearly(p, px, D.tiles(spark, sf), D.YEARS, exclude_class=O.DEFORESTATION, asked=D.asked(spark, sf, 2))
    return out.select(*KEYS, *_hits(4))


@query
def overlay_alerts_buffered(spark, sf):
    return O.disturbed(alert_overlay(spark, sf, buffer=30, sparse=True)).select(*KEYS, *_hits(9))


@query
def overlay_alerts_any_confidence(spark, sf):
    p = O.with_days(D.timed_pairs(spark, sf), D.EPOCH)
    out = O.overlay_alerts(p, D.alert_raster(spark, sf), D.tiles(spark, sf), 0, confidence=None, asked=D.asked(spark, sf, 3))
    return out.select(*KEYS, *_hits(9))


@query
def split_alert_codes(spark, sf):
    return R.split_alerts(D.alert_codes(spark, sf), D.alert_mask(spark, sf))


@query
def unmatched_tiles(spark, sf):
    """Two products' tiles by equal bounds: every third tile is missing from one, shifted in the other."""
    t = D.tiles(spark, sf)
    n = F.substring("tile", 2, 9).cast("int")
    a = t.where(n % 3 != 1)
    b = t.withColumn("xmax", F.when(n % 3 == 2, F.col("xmax") + 1).otherwise(F.col("xmax")))
    return R.pair_tiles(a, b).select(r6("xmin"), "a_tile", "b_tile", "status")


@query
def window_lookup(spark, sf):
    """2 x 2 windows in long form, joined to the pixels: how often each class is met at each position."""
    placed = R.window2(R.assign_tile(D.pairs(spark, sf).select(*KEYS, "t2_lon", "t2_lat"), D.tiles(spark, sf)))
    cells = R.window_pixels(placed, 2).select("tile", "row", "col", "p")
    px = D.yearly_pixels(spark, sf).select("tile", "row", "col", F.get("vals", F.lit(3)).alias("class"))
    return R.join_pixels(cells, px).groupBy("p", "class").agg(F.count("*").alias("n"))


def intact(spark, sf, mod: int) -> DataFrame:
    p = D.timed_pairs(spark, sf, "agbd_a0")
    return O.intact_pairs(p, D.yearly_raster(spark, sf, mod), D.tiles(spark, sf), asked=D.asked(spark, sf, 3))


@query
def intact_pairs(spark, sf):
    return intact(spark, sf, 97).select(*KEYS)


@query
def intact_in_both(spark, sf):
    return P.intersect_pairs(intact(spark, sf, 97), intact(spark, sf, 89)).select(*KEYS)


def intensity(spark, sf, *columns: str) -> DataFrame:
    y = materialise(O.disturbed(yearly(spark, sf, *columns)))
    return O.overlay_intensity(y, D.intensity_raster(spark, sf), D.tiles(spark, sf), D.YEARS[0], asked=D.asked(spark, sf, 2))


@query
def overlay_intensity(spark, sf):
    return intensity(spark, sf).select(*KEYS, r6(F.col("disturb_intensity").cast("double"), "disturb_intensity", 4))


@query
def overlay_burn(spark, sf):
    b = O.overlay_burn(D.timed_pairs(spark, sf), D.burn_raster(spark, sf), D.tiles(spark, sf), D.YEARS)
    return b.select(*KEYS, *[f"burn_bool_{y}" for y in D.YEARS], "interceding_burn")


# ----- jobs and sinks: tables written, a job run on them, its result read back ------------


@query
def job_find_pairs(spark, sf):
    at = new_folder(spark)
    write_table(D.shots(spark, sf), f"{at}/shots")
    jobs.find_pairs(spark, f"{at}/shots", f"{at}/pairs", D.REGION)
    return read_pairs(spark, f"{at}/pairs").select(*KEYS, r6("distance_m", digits=4), r6("t2_agbd_a0"))


@query
def job_add_metrics(spark, sf):
    at = new_folder(spark)
    write_table(D.pairs(spark, sf).select(*KEYS), f"{at}/pairs")
    known = D.shot_metrics(spark, sf)
    whole = known.select(*[F.col(n) if n in known.columns else F.lit(0).alias(n) for n in METRIC_SCHEMA.fieldNames()])
    whole.write.option("header", True).csv(f"{at}/metrics")
    jobs.add_metrics(spark, f"{at}/pairs", f"{at}/metrics", f"{at}/out")
    return read_pairs(spark, f"{at}/out").select(*KEYS, *[r6(f"{t}_{m}") for t in ("t1", "t2") for m in ("agbd_a0", "rh_98_a0")])


@query
def metrics_from_csv(spark, sf):
    """Metric files whose headers differ in order, and one with a column of its own."""
    at = new_folder(spark)
    known = D.shot_metrics(spark, sf)
    whole = known.select(*[F.col(n) if n in known.columns else F.lit(0).alias(n) for n in METRIC_SCHEMA.fieldNames()])
    names = whole.columns
    for i, order in enumerate((names, names[::-1], [*names[5:], "extra", *names[:5]])):
        part = whole.withColumn("extra", F.lit("x")).where(F.col("shot_num") % 3 == i).select(*order)
        part.write.mode("append").option("header", True).csv(f"{at}/metrics")
    return read_metrics(spark, f"{at}/metrics").select("shot_num", r6("agbd_a0"), r6("rh_98_a0"), "outlier_umd")


def _pairs_and_raster(spark, sf, raster, *args, **kw) -> str:
    """Folder with the pairs and a raster of ``catalog/data.py``."""
    at = new_folder(spark)
    write_table(D.pairs(spark, sf, "absolute_time"), f"{at}/pairs")
    raster.write(spark, sf, *args, path=f"{at}/raster", **kw)
    return at


@query
def job_yearly_degradation(spark, sf):
    at = _pairs_and_raster(spark, sf, D.yearly_raster, deforestation=True)
    jobs.yearly_degradation(spark, f"{at}/pairs", f"{at}/raster", D.tiles(spark, sf), f"{at}/out", D.YEARS)
    return spark.read.parquet(f"{at}/out").select(*KEYS, *_hits(4))


@query
def job_alert_degradation(spark, sf):
    at = _pairs_and_raster(spark, sf, D.alert_raster)
    jobs.alert_degradation(spark, f"{at}/pairs", f"{at}/raster", D.tiles(spark, sf), f"{at}/out", epoch=D.EPOCH)
    return spark.read.parquet(f"{at}/out").select(*KEYS, *_hits(9))


@query
def job_disturbance_intensity(spark, sf):
    at = _pairs_and_raster(spark, sf, D.yearly_raster)
    jobs.yearly_degradation(spark, f"{at}/pairs", f"{at}/raster", D.tiles(spark, sf), f"{at}/yearly", D.YEARS, exclude_class=None)
    D.intensity_raster.write(spark, sf, path=f"{at}/counts")
    jobs.disturbance_intensity(spark, f"{at}/yearly", f"{at}/counts", D.tiles(spark, sf), f"{at}/out", D.YEARS[0])
    out = spark.read.parquet(f"{at}/out")
    return out.select(*KEYS, r6(F.col("disturb_intensity").cast("double"), "disturb_intensity", 4))


@query
def job_intact_controls(spark, sf):
    at = _pairs_and_raster(spark, sf, D.yearly_raster, 97)
    jobs.intact_controls(spark, f"{at}/pairs", f"{at}/raster", D.tiles(spark, sf), f"{at}/out")
    return spark.read.parquet(f"{at}/out").select(*KEYS)


@query
def chunked_pairs(spark, sf):
    """Pairs written in files of 1000 rows at most: all of them, and how many files are too large."""
    at = new_folder(spark)
    write_chunks(D.pairs(spark, sf).select(*KEYS), at, rows=1000)
    files = spark.read.parquet(at).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    return files.agg(F.sum("rows").alias("n"), F.count_if(F.col("rows") > 1000).alias("too_large"))


@query
def treatment_hand_off(spark, sf):
    """Treatment pairs written for the burn analysis and read back."""
    at = new_folder(spark)
    write_table(C.treatment_rows(cohort(spark, sf, "agbd_a0")), at, partition_by=["tile"])
    return read_pairs(spark, at).select(*KEYS, r6("t1_agbd_a0"), "measured_disturbance")


# ----- cohorts ----------------------------------------------------------------------


def labelled(spark, sf, *columns: str) -> DataFrame:
    """Labelled pairs, written once: cohort operators read them more than once."""
    return materialise(C.label_groups(yearly(spark, sf, *columns)))


def cohort(spark, sf, *columns: str) -> DataFrame:
    """Labelled pairs, each shot once. Pairs without a label, which are in none, aren't stored."""
    return C.dedup_pairs(materialise(C.label_groups(yearly(spark, sf, *columns)).where("sample_grp is not null")))


def matched(spark, sf, *columns: str, both: bool = False) -> DataFrame:
    return C.match_strata(materialise(cohort(spark, sf, *columns)), both=both, hash="md5")


@query
def group_counts(spark, sf):
    return C.group_counts(C.label_groups(yearly(spark, sf)))


@query
def dedup_pairs(spark, sf):
    return cohort(spark, sf).select("sample_grp", *KEYS)


@query
def duplicate_counts(spark, sf):
    return C.duplicate_counts(C.label_groups(yearly(spark, sf)))


@query
def matched_controls(spark, sf):
    return matched(spark, sf).select("sample_grp", *KEYS)


@query
def matched_both(spark, sf):
    return matched(spark, sf, both=True).select("sample_grp", *KEYS)


@query
def treatment_rows(spark, sf):
    t = C.treatment_rows(cohort(spark, sf, "agbd_a0")).where("t1_agbd_a0 != 0")
    return t.select(*KEYS, r6(S.pct_loss("agbd_a0"), "agbd_pct_loss"))


# ----- statistics -------------------------------------------------------------------


@query
def pair_statistics(spark, sf):
    p = P.drop_same_day(D.timed_pairs(spark, sf, *D.METRICS))
    st = A.pair_stats(p, D.METRICS)
    return st.select("metric", "n", *[r6(c) for c in st.columns[2:]])


@query
def pair_statistics_by_group(spark, sf):
    st = A.pair_stats(matched(spark, sf, *D.METRICS, both=True), D.METRICS, ["sample_grp"])
    return st.select("sample_grp", "metric", "n", *[r6(c) for c in st.columns[3:]])


@query
def sma_fit(spark, sf):
    li = D.table(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    return A.sma_fit(li, "l_quantity", "l_extendedprice", ["l_returnflag"]).select(
        "l_returnflag", "n", *[r6(c) for c in ("slope", "intercept", "r")]
    )


def _lags(df: DataFrame, edges: list[int], min_n: int) -> DataFrame:
    st = A.lag_stats(df, edges, {"agbd": S.difference("agbd_a0"), "rh98": S.difference("rh_98_a0")}, min_n)
    return st.select("lag_lo", "lag_hi", "n", *[r6(c) for c in st.columns[3:]])


@query
def lag_profile(spark, sf):
    return _lags(D.timed_pairs(spark, sf, "agbd_a0", "rh_98_a0"), LAGS_ALL, 0)


@query
def lag_profile_of_controls(spark, sf):
    c = cohort(spark, sf, "agbd_a0", "rh_98_a0").where("sample_grp = 'control'")
    return _lags(c, LAGS_CONTROL, 40)


@query
def buffer_sweep(spark, sf):
    p = O.with_days(D.timed_pairs(spark, sf, "agbd_a0"), D.EPOCH)
    out = O.buffer_sweep(p, D.alert_raster(spark, sf), D.tiles(spark, sf), list(range(0, 181, 30)), asked=D.asked(spark, sf, 3))
    return out.select("buffer_days", "n", r6("bias"))


def long_table(spark, sf, quantity=S.rel_diff) -> DataFrame:
    everyone = C.hash_sample(P.drop_same_day(D.timed_pairs(spark, sf, *D.METRICS)), hash="md5")
    control = cohort(spark, sf, *D.METRICS).where("sample_grp = 'control'")
    return C.long_metrics(
        {"All pairs": everyone, "Disturbed": control}, {"AGBD": "agbd_a0", "RH 98": "rh_98_a0", "RH 50": "rh_50_a0"}, quantity
    )


@query
def long_metric_means(spark, sf):
    t = long_table(spark, sf, S.pct_diff)
    return t.groupBy("control_group", "metric").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))


@query
def metric_quartiles(spark, sf):
    q = A.quartiles(materialise(long_table(spark, sf)), "value", ["control_group", "metric"])
    return q.select("control_group", "metric", "n", *[r6(c) for c in ("q25", "q50", "q75")])


@query
def quartiles_with_unlabelled(spark, sf):
    """Pairs without a label are a group of their own."""
    q = A.quartiles(labelled(spark, sf).select("sample_grp", "time_diff"), "time_diff", ["sample_grp"])
    return q.select("sample_grp", "n", *[r6(c) for c in ("q25", "q50", "q75")])


@query
def event_box_stats(spark, sf):
    e = D.table(spark, sf, "events", "event_type", "value")
    b = A.box_stats(e, "value", ["event_type"])
    return b.select("event_type", "n", *[r6(c) for c in ("q25", "q50", "q75", "whisker_lo", "whisker_hi")])


@query
def price_quartiles(spark, sf):
    li = D.table(spark, sf, "lineitem", "l_extendedprice")
    return A.quartiles(li, "l_extendedprice", []).select("n", *[r6(c) for c in ("q25", "q50", "q75")])


@query
def value_histogram(spark, sf):
    e = D.table(spark, sf, "events", "event_type", "value")
    return A.histogram(e, "value", 50, ["event_type"]).select("event_type", "bin", r6("bin_lo"), "n")


@query
def time_histogram(spark, sf):
    e = D.table(spark, sf, "events", "ts")
    return A.histogram(e, "ts", 20).select("bin", "n")


@query
def hexbin_density(spark, sf):
    p = D.pairs(spark, sf, "rh_98_a0")
    return A.hexbin(p, "t1_rh_98_a0", "t2_rh_98_a0", 100, 6).select(r6("cx"), r6("cy"), "n")


@query
def kernel_density(spark, sf):
    e = D.table(spark, sf, "events", "event_type", "value")
    return A.kde(e, "value", ["event_type"]).select("event_type", "point", r6("x"), r6("density", digits=8))


@query
def disturbance_bins(spark, sf):
    d = binned(spark, sf, INTENSITY_BINS)
    return A.value_counts(d, "disturb_bin")


@query
def largest_extents(spark, sf):
    return A.max_by_group(C.label_groups(yearly(spark, sf)), "measured_disturbance", ["sample_grp"])


def treated(spark, sf, *columns: str) -> DataFrame:
    """Treatment pairs of the alert overlay, each shot once: ages and burns are taken from these."""
    return C.treatment_rows(C.dedup_pairs(materialise(C.label_groups(alert_overlay(spark, sf, *columns)))))


def aged(spark, sf, *columns: str) -> DataFrame:
    t = treated(spark, sf, *columns)
    t = t.withColumn("mode_disturb_days", S.row_mode([F.col(f"p{i}_disturb_date") for i in range(1, 10)]))
    t = t.withColumn("days_since_disturbance", F.col("t2_days") - F.col("mode_disturb_days"))
    return t.where("days_since_disturbance >= 0").withColumn("months", S.months(F.col("days_since_disturbance")))


@query
def disturbance_age(spark, sf):
    return aged(spark, sf).select(*KEYS, "mode_disturb_days", "days_since_disturbance", "months")


def burned(spark, sf) -> DataFrame:
    columns = ["rh_98_a0", "rh_50_a0"]
    t = treated(spark, sf, *columns).select(D.timed_pairs(spark, sf, *columns).columns)
    b = O.overlay_burn(t, D.burn_raster(spark, sf), D.tiles(spark, sf), D.YEARS)
    return b.where("interceding_burn and t1_rh_98_a0 >= 5 and t1_rh_50_a0 >= 2.5").withColumn("canopy_lost", S.canopy_lost())


@query
def burned_shares(spark, sf):
    kept = ~F.col("canopy_lost")
    under = F.col("t2_rh_50_a0") <= 2.5
    out = A.shares(
        burned(spark, sf),
        {"canopy_kept": (kept, F.lit(True)), "under_lost_of_kept": (under, kept), "kept_under_lost": (kept & under, F.lit(True))},
    )
    return out.select("n", *[r6(c) for c in out.columns[1:]])


@query
def profile_split(spark, sf):
    """Upper and lower plant area of every shot, on both sides of a third of its height."""
    s = D.shots(spark, sf).select(F.col("shot_number").alias("shot_num"), "rh_98_a0")
    p = V.split_profiles(D.shot_profiles(spark, sf).join(s, "shot_num"), "rh_98_a0", prefixes=("",), bucket="bucket")
    return p.select("o_orderkey", "bucket", r6("upper_pai"), r6("lower_pai"))


def split_pairs(spark, sf, pairs: DataFrame) -> DataFrame:
    profiles = D.shot_profiles(spark, sf).drop("o_orderkey")
    return V.split_profiles(P.enrich_pairs(pairs, profiles, outlier=None))


@query
def profile_split_pairs(spark, sf):
    """Both times' upper and lower plant area of the treatment pairs, split at a third of the first height."""
    split = split_pairs(spark, sf, treated(spark, sf, "rh_98_a0").select(*KEYS, "t1_rh_98_a0"))
    return split.select(*KEYS, "t1_mid_tch_bucket", *[r6(f"{t}_{part}_pai") for t in ("t1", "t2") for part in ("upper", "lower")])


@query
def profile_density(spark, sf):
    """Densities of plant area before and after a burn, by story and by whether the canopy was lost."""
    b = burned(spark, sf).select(*KEYS, "t1_rh_98_a0", "canopy_lost")
    series = materialise(V.split_series(split_pairs(spark, sf, b)))
    return A.kde(series, "value", ["story", "series"]).select("story", "series", "point", r6("x"), r6("density", digits=8))


# ----- inference --------------------------------------------------------------------


def _welch(df: DataFrame) -> DataFrame:
    w = I.welch_t(df, S.difference("agbd_a0"))
    return w.select("n1", "n2", *[r6(c, digits=5) for c in w.columns[2:]])


@query
def welch_test(spark, sf):
    return _welch(matched(spark, sf, "agbd_a0"))


@query
def welch_test_single_pixel(spark, sf):
    m = matched(spark, sf, "agbd_a0")
    return _welch(m.where("sample_grp = 'control' or measured_disturbance = 1"))


@query
def welch_test_prices(spark, sf):
    li = D.table(spark, sf, "lineitem", "l_returnflag", "l_extendedprice")
    w = I.welch_t(li, F.col("l_extendedprice"), "l_returnflag", "A", "R")
    return w.select("n1", "n2", *[r6(c, digits=5) for c in w.columns[2:]])


def _boot(df: DataFrame, group: list[str], n: int = 100) -> DataFrame:
    lossy = df.where("t1_agbd_a0 != 0").withColumn("loss", S.pct_loss("agbd_a0"))
    return I.bootstrap_median(lossy, "loss", group, KEYS, n, hash="md5")


def _ci(replicates: DataFrame, group: list[str]) -> DataFrame:
    ci = I.replicate_ci(replicates, group)
    return ci.select(*group, "replicates", *[r6(c) for c in ("mean", "ci_lo", "ci_hi")])


def by_extent(spark, sf) -> DataFrame:
    c = cohort(spark, sf, "agbd_a0")
    extent = F.when(F.col("sample_grp") == "control", F.lit(0)).otherwise(F.col("measured_disturbance"))
    return _boot(c.withColumn("extent", extent), ["extent"])


@query
def bootstrap_by_extent(spark, sf):
    return _ci(by_extent(spark, sf), ["extent"])


@query
def extent_fit(spark, sf):
    fits = I.fit_by_replicate(by_extent(spark, sf).where("extent > 0"), F.col("extent"))
    out = I.mean_fit(fits, ["slope", "intercept", "r2", "p"])
    return out.select(*[r6(c) for c in out.columns])


def by_month(spark, sf) -> DataFrame:
    return _boot(aged(spark, sf, "agbd_a0").where("months < 23"), ["months"])


@query
def bootstrap_by_month(spark, sf):
    return _ci(by_month(spark, sf), ["months"])


@query
def month_quadratic_fit(spark, sf):
    fits = I.quad_fit(by_month(spark, sf), F.col("months"), F.col("median"), ["replicate"])
    return fits.select("replicate", "n", *[r6(c, digits=5) for c in fits.columns[2:]])


def binned(spark, sf, edges, *columns: str) -> DataFrame:
    t = C.treatment_rows(C.label_groups(intensity(spark, sf, *columns)))
    scaled = S.rescaled_intensity(F.col("disturb_intensity").cast("double"), F.col("measured_disturbance"))
    # Unfolded, as the cut names it once per edge, and so does every filter on the cut.
    return t.withColumn("intensity", F.explode(F.array(scaled))).withColumn("disturb_bin", S.cut(F.col("intensity"), edges))


def by_intensity(spark, sf) -> DataFrame:
    return _boot(binned(spark, sf, INTENSITY_BINS, "agbd_a0"), ["disturb_bin"])


@query
def bootstrap_by_intensity(spark, sf):
    return _ci(by_intensity(spark, sf), ["disturb_bin"])


@query
def intensity_sqrt_fit(spark, sf):
    fits = I.fit_by_replicate(by_intensity(spark, sf), F.sqrt("disturb_bin"))
    out = I.mean_fit(fits, ["slope", "intercept", "r2", "p"])
    return out.select(*[r6(c) for c in out.columns])


@query
def intensity_correlation_by_extent(spark, sf):
    boot = _boot(binned(spark, sf, COARSE_BINS, "agbd_a0"), ["measured_disturbance", "disturb_bin"])
    means = I.replicate_ci(boot, ["measured_disturbance", "disturb_bin"])
    out = I.correlation_test(means, F.col("disturb_bin"), F.col("mean"), ["measured_disturbance"])
    return out.select("measured_disturbance", "n", r6("r"), r6("p"))


@query
def bootstrap_event_values(spark, sf):
    e = D.table(spark, sf, "events", "event_id", "event_type", "value")
    return _ci(I.bootstrap_median(e, "value", ["event_type"], ["event_id"], 100, hash="md5"), ["event_type"])


@query
def disturbance_summary(spark, sf):
    """Flagship: pairs, yearly overlay, groups, de-duplication, bias per group."""
    return (
        cohort(spark, sf, "agbd_a0", "rh_98_a0")
        .groupBy("sample_grp")
        .agg(
            F.count("*").alias("n_pairs"),
            r6(F.avg(S.difference("agbd_a0")), "bias_agbd"),
            r6(F.avg(S.difference("rh_98_a0")), "bias_rh98"),
            r6(F.corr("t1_agbd_a0", "t2_agbd_a0"), "corr_agbd"),
        )
    )
