"""Order statistics, matching, resampling and tests against plain Python."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinshot.functions import scalar as S
from twinshot.operators import cohort as C
from twinshot.operators import inference as I
from twinshot.operators import stats as A
from twinshot.operators import ranks
from twinshot.operators.ranks import exact_percentiles, select_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups; one holds most rows and a third of all rows share one value."""
    rnd = random.Random(1)
    rows = [("big", 0.0) for _ in range(2000)] + [("big", rnd.gauss(0, 10)) for _ in range(3500)]
    rows += [("small", rnd.random()) for _ in range(499)] + [("one", 3.5)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(8)


@pytest.mark.parametrize("small", [ranks.SMALL, 3])
def test_every_rank_is_selected(skewed, monkeypatch, small):
    """Also when buckets must be cut again and again, and with a value that most rows share."""
    monkeypatch.setattr(ranks, "SMALL", small)
    rows, df = skewed
    every = lambda groups: groups.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    got = {(r.g, r.k): (r.v, r.n) for r in select_ranks(df, "v", ["g"], every).collect()}
    for g in ("big", "small", "one"):
        values = sorted(v for k, v in rows if k == g)
        assert [got[g, k] for k in range(1, len(values) + 1)] == [(v, len(values)) for v in values]


def test_a_heavy_value_and_close_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 2)
    values = [5.0] * 4000 + [5.0 - 1e-9 * i for i in range(1, 40)] + [float("nan"), float("inf"), -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    wanted = lambda groups: groups.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 20, 40, 41, 4040, 4041, 4042)])))
    got = {r.k: r.v for r in select_ranks(df, "v", [], wanted).collect()}
    ordered = sorted(values[:-3] + values[-2:]) + [float("nan")]
    assert [repr(got[k]) for k in sorted(got)] == [repr(ordered[k - 1]) for k in sorted(got)] and len(got) == 8


def test_percentiles(skewed):
    rows, df = skewed
    got = exact_percentiles(df, "v", ["g"], {"a": 0.25, "b": 0.9}).toPandas().set_index("g")
    for g in ("big", "small", "one"):
        values = [v for k, v in rows if k == g]
        assert np.allclose(got.loc[g, ["a", "b"]].astype(float), np.percentile(values, [25, 90]))
    every = exact_percentiles(df, "v", [], {"m": 0.5}).first()
    assert every.n == len(rows) and every.m == pytest.approx(np.percentile([v for _, v in rows], 50))


def test_bootstrap_is_the_median_of_the_drawn_rows(spark):
    rnd = random.Random(4)
    rows = [("a", i, rnd.choice([1.0, 2.0, rnd.gauss(5, 2)])) for i in range(301)] + [("b", i, float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    n = 12
    got = {(r.g, r.replicate): r.median for r in I.bootstrap_median(df, "v", ["g"], ["k"], n).collect()}
    draws = df.select("g", "k", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("r")).withColumn("h", F.xxhash64(F.lit(0), "r", "k"))
    for g in ("a", "b"):
        values = sorted(v for k, _, v in rows if k == g)
        for r in range(1, n + 1):
            picked = [values[d.h % len(values)] for d in draws.where((F.col("g") == g) & (F.col("r") == r)).collect()]
            assert got[(g, r)] == pytest.approx(statistics.median(picked))


def test_match_strata(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        grp = rnd.choices(["control", "treatment", None], [6, 3, 1])[0]
        # One bin holds most of the rows, some lie outside all bins.
        rows.append((i, i + 1, rnd.choice([30, 30, 30, 30, 100, 500, 0, 1300]), grp))
    df = spark.createDataFrame(rows, "t1_shot_number long, t2_shot_number long, time_diff int, sample_grp string")
    bin_of = lambda d: -(-d // 60) - 1 if 0 < d <= 1140 else None
    count = lambda rs: pd.Series([(g, bin_of(d)) for *_, d, g in rs]).value_counts().to_dict()
    before = count([r for r in rows if r[3]])
    one = [tuple(r) for r in C.match_strata(df).select(df.columns).collect()]
    after = count(one)
    assert len(set(one)) == len(one)
    for b in (0, 1, 8):
        nt, nc = before.get(("treatment", b), 0), before.get(("control", b), 0)
        assert after.get(("control", b), 0) == min(nt, nc)
        assert after[("treatment", b)] == nt
    assert after[("treatment", None)] == before[("treatment", None)] and ("control", None) not in after
    both = count([tuple(r) for r in C.match_strata(df, both=True).select(df.columns).collect()])
    for b in (0, 1, 8):
        least = min(before.get(("treatment", b), 0), before.get(("control", b), 0))
        assert both[("treatment", b)] == both[("control", b)] == least
    assert ("treatment", None) not in both


def test_dedup_keeps_first_like_a_sorted_frame(spark):
    rnd = random.Random(6)
    pairs = {(rnd.randint(0, 40), rnd.randint(50, 90)) for _ in range(400)} | {(7, b) for b in range(50, 91)}
    rows = [(a, b, rnd.choice(["control", "treatment"])) for a, b in pairs]
    df = spark.createDataFrame(rows, "t1_shot_number long, t2_shot_number long, sample_grp string")
    expected = set()
    frame = pd.DataFrame(rows, columns=["a", "b", "g"]).sort_values(["a", "b"])
    for g, part in frame.groupby("g"):
        kept = part.drop_duplicates("a").sort_values(["b", "a"]).drop_duplicates("b")
        expected |= {(r.a, r.b, g) for r in kept.itertuples()}
    assert {tuple(r) for r in C.dedup_pairs(df).collect()} == expected


def test_student_tail_and_welch(spark):
    # Critical values from printed t tables.
    table = [(1.0, 6.314, 0.05), (2.0, 2.920, 0.05), (5.0, 2.571, 0.025), (30.0, 2.750, 0.005), (1e6, 1.959964, 0.025)]
    df = spark.createDataFrame([(a, b) for a, b, _ in table], "df double, t double")
    got = [r.p for r in df.select(I.student_upper_tail(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got == pytest.approx([p for *_, p in table], rel=2e-3)
    sample = spark.createDataFrame([("control", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("treatment", v) for v in (2.0, 2.0, 5.0, 9.0, 7.0)], "sample_grp string, v double")
    w = I.welch_t(sample, F.col("v")).first()
    assert w.t == pytest.approx(-2.5 / (5 / 12 + 1.9) ** 0.5) and w.p_greater == pytest.approx(1 - w.p_two_sided / 2)


def test_quadratic_fit(spark):
    rnd = np.random.default_rng(3)
    x = np.arange(23)
    y = 4 + 1.5 * x - 0.2 * x**2 + rnd.normal(0, 2, 23)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "replicate int, x double, y double")
    fit = I.quad_fit(df, F.col("x"), F.col("y"), ["replicate"]).first()
    design = np.column_stack([np.ones(23), x**2, x])
    beta, sse, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert [fit.b0, fit.b_sq, fit.b_lin] == pytest.approx(list(beta))
    r2 = 1 - sse[0] / ((y - y.mean()) ** 2).sum()
    assert fit.adj_r2 == pytest.approx(1 - (1 - r2) * 22 / 20)
    se = np.sqrt(sse[0] / 20 * np.diag(np.linalg.inv(design.T @ design)))
    tails = spark.createDataFrame([(float(abs(b / s)),) for b, s in zip(beta, se)], "t double").select(
        (2 * I.student_upper_tail(F.col("t"), F.lit(20.0))).alias("p")
    )
    assert [fit.p0, fit.p_sq, fit.p_lin] == pytest.approx([r.p for r in tails.collect()], rel=1e-5, abs=1e-12)


def test_scalars(spark):
    df = spark.sql("select timestamp('2020-01-02 00:00:00') a, timestamp('2020-01-01 23:00:00') b, array(0,0,5,5,3,3) d, 0.0D z, 60 e")
    r = df.select(
        S.days_between(F.col("a"), F.col("b")).alias("days"),
        S.row_mode([F.col("d")[i] for i in range(6)]).alias("mode"),
        S.row_mode([F.lit(0), F.lit(0)]).alias("none"),
        S.ratio(F.lit(1.0), F.col("z")).alias("ratio"),
        S.bin_index(F.col("e"), [0, 60, 120]).alias("closed"),
        S.bin_index(F.col("e"), [0, 60, 120], right=False).alias("open"),
        S.cut(F.lit(0), [0, 60]).alias("outside"),
        S.third_height_bucket(F.lit(34.9)).alias("bucket"),
    ).first()
    assert tuple(r) == (-1, 3, None, None, 0, 1, None, 10)


def test_histogram_and_hexbin_count_every_row(skewed):
    rows, df = skewed
    h = A.histogram(df, "v", 20, ["g"]).toPandas()
    assert h.n.sum() == len(rows) and h.bin.between(0, 19).all()
    x = A.hexbin(df.withColumn("w", F.col("v") * 2 + 1), "v", "w", 30).toPandas()
    assert x.n.sum() == len(rows)
    d = A.kde(df.where("g = 'small'"), "v").toPandas().sort_values("point")
    assert np.trapezoid(d.density, d.x) == pytest.approx(1, abs=5e-3)


def test_lag_bands_without_rows_stay(spark):
    df = spark.createDataFrame([(5, 1.0), (5, 3.0), (25, 2.0)], "time_diff int, v double")
    got = [tuple(r) for r in A.lag_stats(df, [30, 20, 10, 0], {"v": F.col("v")}, 2).orderBy("lag_lo").collect()]
    assert got == [(0, 10, 2, pytest.approx(2**0.5), 2.0), (10, 20, 0, None, None), (20, 30, 1, None, None)]


def test_dedup_gives_one_row_for_a_pair_in_two_tiles(spark):
    rows = [(1, 2, "B", "treatment", [1]), (1, 2, "A", "treatment", [2]), (1, 3, "A", "treatment", [3]), (4, 5, None, "control", None)]
    df = spark.createDataFrame(rows, "t1_shot_number long, t2_shot_number long, tile string, sample_grp string, v array<int>")
    out = C.dedup_pairs(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, 2, "A", "treatment", [2]), (4, 5, None, "control", None)]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "g string, v double")
    assert sorted((str(r.g), r.n, r.q50) for r in A.quartiles(df, "v", ["g"]).collect()) == [("None", 2, 7.0), ("a", 2, 2.0)]
    assert {r.g for r in A.box_stats(df, "v", ["g"]).collect()} == {"a", None}
    assert {r.g for r in A.histogram(df, "v", 2, ["g"]).collect()} == {"a", None}
    assert {r.g for r in A.kde(df, "v", ["g"], points=5).collect()} == {"a", None}
