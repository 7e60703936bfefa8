"""The distance join against brute force, on sphere positions that are easy to get wrong."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinshot.functions.geo import EARTH_RADIUS_M
from twinshot.operators.colocated import buckets_for, bucketed_names, forget_bucketed, store_bucketed
from twinshot.operators.pairs import closer_than, enrich_pairs, intersect_pairs, near_pairs, prefixed
from twinshot.operators.quadtree import in_reached_leaves, leaves


def distance(a, b):
    dlat, dlon = math.radians(b[2] - a[2]), math.radians(b[1] - a[1])
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(dlon / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def brute(points, radius):
    return {
        (a[0], b[0]) for i, a in enumerate(points) for b in points[i + 1 :] if distance(a, b) <= radius
    }


def clusters(seed, centres, per=40, spread_m=80):
    rnd = random.Random(seed)
    points = []
    for lon, lat in centres:
        for _ in range(per):
            dlat = rnd.uniform(-spread_m, spread_m) / 111_000
            dlon = rnd.uniform(-spread_m, spread_m) / 111_000 / max(math.cos(math.radians(lat)), 0.05)
            x = (lon + dlon + 180) % 360 - 180
            points.append((len(points), x, max(-90.0, min(90.0, lat + dlat))))
    return points


CENTRES = [(-60.0, -5.0), (0.0, 0.0), (12.3, 51.9), (-71.0, -51.9), (180.0, 10.0), (-180.0, -33.0), (100.0, 78.0), (5.0, 90.0), (0.0, -89.9995)]


@pytest.mark.parametrize("factor,hot", [(1.0, None), (4.0, None), (4.0, 5), (8.0, 20_000)])
def test_matches_brute_force(spark, factor, hot):
    points = clusters(7, CENTRES)
    shots = spark.createDataFrame(points, "shot_number long, lon double, lat double")
    pairs = near_pairs(shots, 40.0, cell_factor=factor, hot_cell_rows=hot)
    rows = [(r.t1_shot_number, r.t2_shot_number) for r in pairs.select("t1_shot_number", "t2_shot_number").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(points, 40.0)


def test_one_spot_holds_a_third(spark):
    """A hot spot is cut into blocks, and no pair is lost or repeated."""
    points = clusters(3, CENTRES[:3], per=60) + [(1000 + i, 20.0, 20.0) for i in range(90)]
    shots = spark.createDataFrame(points, "shot_number long, lon double, lat double")
    pairs = near_pairs(shots, hot_cell_rows=7)
    rows = [(r.t1_shot_number, r.t2_shot_number) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(points, 40.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_thousand_full_cells(spark):
    """Every full cell is split, however many there are, and no pair is lost or repeated."""
    per, limit = 16, 6
    centres = [(-60 + 0.02 * (i % 40), -5 + 0.02 * (i // 40)) for i in range(1000)]
    points = clusters(13, centres, per=per, spread_m=15)
    shots = spark.createDataFrame(points, "shot_number long, lon double, lat double").cache()
    want = set()
    for i in range(0, len(points), per):
        want |= brute(points[i : i + per], 40.0)
    rows = [(r[0], r[1]) for r in near_pairs(shots, hot_cell_rows=limit).select("t1_shot_number", "t2_shot_number").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_leaves_of_full_cells(spark):
    rnd = random.Random(4)
    rows = [(c, rnd.randint(0, 7), rnd.randint(0, 3)) for c in range(1200) for _ in range(rnd.randint(8, 30))] + [(7777, 0, 0)] * 5
    rows += [(8888, 3, 3)] * 25
    found = {}
    for r in leaves(spark.createDataFrame(rows, "_cell long, _x int, _y int"), 7).collect():
        found.setdefault(r.full_cell, []).append(r)
    assert set(found) == {c for c, _, _ in rows} - {7777}
    held = Counter()
    for c, x, y in rows:
        if c in found:
            of = [k for k, l in enumerate(found[c]) if l.x <= x < l.x + l.size and l.y <= y < l.y + l.size]  # noqa: E741
            assert len(of) == 1
            held[c, of[0]] += 1
    for c, pieces in found.items():
        for k, l in enumerate(pieces):  # noqa: E741
            assert held[c, k] > 0 and l.splits == -(-held[c, k] // 7)
            # Only what can't be quartered any more is cut, and only full cells are quartered.
            assert l.splits == 1 or l.size == 1
    assert [tuple(p) for p in found[8888]] == [(8888, 3, 3, 1, 4)]


def test_copies_reach_pieces(spark):
    """A copy goes to those pieces of a full cell that its box meets, and once to any other cell."""
    full = spark.createDataFrame([(5, 0, 0, 4, 1), (5, 4, 4, 1, 2)], "full_cell long, x int, y int, size int, splits int")
    rows = [(1, 5, 0.0, 0.1, 0.0, 0.1), (2, 5, 0.45, 0.55, 0.45, 0.5), (3, 5, 0.8, 0.9, 0.0, 0.1), (4, 6, 0.0, 0.1, 0.0, 0.1)]
    frame = spark.createDataFrame(rows, "id long, _cell long, a double, b double, c double, d double")
    x, y = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    got = Counter((r.id, r._leaf) for r in in_reached_leaves(frame, full, x, y, "id").collect())
    assert got == {(1, 0): 1, (2, 0): 1, (2, 36): 2, (3, -1): 1, (4, -1): 1}


def test_no_job_before_an_action(spark):
    points = clusters(3, CENTRES[:1])
    shots = spark.createDataFrame(points, "shot_number long, lon double, lat double")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan only", "plan only")
    near_pairs(shots, hot_cell_rows=5)
    assert not before.getJobIdsForGroup("plan only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_enrich_with_hot_shot(spark):
    from twinshot.operators.keys import hot_keys

    pairs = spark.createDataFrame([(1, i) for i in range(2, 60)] + [(70, 71)], "t1_shot_number long, t2_shot_number long")
    metrics = spark.createDataFrame([(i, float(i), int(i == 5)) for i in range(80)], "shot_num long, m double, outlier_umd int")
    plain = enrich_pairs(pairs, metrics)
    hot = hot_keys(pairs, F.xxhash64("t1_shot_number"), 10)
    assert hot.count() == 1
    salted = enrich_pairs(pairs, metrics, hot=(hot, None))
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert key(plain) == key(salted) and len(key(plain)) == 58  # one pair has an outlier
    with pytest.raises(ValueError):
        enrich_pairs(pairs.withColumn("t1_m", F.lit(0)), metrics)


def test_small_pair_operators(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0)], "shot_number long, lon double, lat double")
    assert prefixed(s, "t1_").columns == ["t1_shot_number", "t1_lon", "t1_lat"]
    p = spark.createDataFrame(
        [(1, 2, 0.0, 0.0, 0.0002, 0.0), (3, 4, 0.0, 0.0, 0.0003, 0.0)],
        "t1_shot_number long, t2_shot_number long, t1_lon double, t1_lat double, t2_lon double, t2_lat double",
    )
    assert [r.t1_shot_number for r in closer_than(p, 30).collect()] == [1]
    twice = p.union(p)
    assert intersect_pairs(p, twice).count() == 2


def test_bucketed_tables_join_without_moving_the_metrics(spark):
    rnd = random.Random(9)
    pairs = spark.createDataFrame([(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(300)], "t1_shot_number long, t2_shot_number long")
    metrics = spark.createDataFrame([(i, float(i), int(i % 7 == 5)) for i in range(50)] + [(None, 1.0, 0)], "shot_num long, m double, outlier_umd int")
    want = sorted(map(tuple, enrich_pairs(pairs, metrics).select("t1_shot_number", "t2_shot_number", "t1_m", "t2_m").collect()))
    try:
        stored = store_bucketed(metrics, "shot_num", 4)
        near = store_bucketed(pairs, "t1_shot_number", 4)
        assert stored.count() == 51 and len(stored.inputFiles()) <= 4 and len(bucketed_names(spark)) >= 2
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = enrich_pairs(near, stored).select("t1_shot_number", "t2_shot_number", "t1_m", "t2_m")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == want and len(want) > 100
        # Joined to their first shots, the pairs move once, for their second ones; the stored metrics never do.
        moves = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(moves) == 1 and "hashpartitioning(t2_shot_number" in moves[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        forget_bucketed(spark)
    assert not bucketed_names(spark)
    assert [buckets_for(b, n) for b, n in ((0, 1), (0, 5), (3 << 28, 1), ((1 << 28) + 1, 2))] == [1, 8, 4, 2]
