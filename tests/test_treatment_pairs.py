"""Ages, burn shares and profiles come from treatment pairs in which every shot occurs once."""

from collections import Counter

import pytest
from conftest import TESTDATA

from catalog import data as D
from catalog import queries as Q
from twinshot.operators import overlay as O

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in Q.alert_overlay(spark, SF, "rh_98_a0", "rh_50_a0").collect()]


@pytest.fixture(scope="module")
def treatment(rows):
    """As the reference does it: first pair of each t1 shot, then of each t2 shot, in order of ids."""
    out = sorted((r for r in rows if r["measured_disturbance"] > 0), key=lambda r: (r["t1_shot_number"], r["t2_shot_number"]))
    for shot in ("t1_shot_number", "t2_shot_number"):
        seen = set()
        out = [r for r in out if not (r[shot] in seen or seen.add(r[shot]))]
    return out


def key(r):
    return r["t1_shot_number"], r["t2_shot_number"]


def test_age_of_each_shot_once(spark, rows, treatment):
    want = {}
    for r in treatment:
        days = Counter(d for d in (r[f"p{i}_disturb_date"] for i in range(1, 10)) if d)
        mode = min(d for d, n in days.items() if n == max(days.values()))
        if r["t2_days"] >= mode:
            want[key(r)] = (mode, r["t2_days"] - mode, (r["t2_days"] - mode) // 30)
    assert 0 < len(treatment) < sum(r["measured_disturbance"] > 0 for r in rows)
    got = [tuple(r) for r in Q.disturbance_age(spark, SF).collect()]
    assert len(got) == len(want) and {g[:2]: g[2:] for g in got} == want


def test_burns_of_treatment_pairs_only(spark, treatment):
    burnt = O.overlay_burn(D.timed_pairs(spark, SF, "rh_98_a0", "rh_50_a0"), D.burn_raster(spark, SF), D.tiles(spark, SF), D.YEARS)
    burnt = {(r[0], r[1]) for r in burnt.where("interceding_burn").select("t1_shot_number", "t2_shot_number").collect()}
    rows = [r for r in treatment if key(r) in burnt and r["t1_rh_98_a0"] >= 5 and r["t1_rh_50_a0"] >= 2.5]
    kept = [r for r in rows if r["t2_rh_98_a0"] >= 0.65 * r["t1_rh_98_a0"]]
    under = [r for r in kept if r["t2_rh_50_a0"] <= 2.5]
    got = Q.burned_shares(spark, SF).first()
    assert rows and got.n == len(rows) and {key(r) for r in rows} == {(r[0], r[1]) for r in Q.burned(spark, SF).select(*Q.KEYS).collect()}
    assert got.canopy_kept == pytest.approx(100 * len(kept) / len(rows), abs=1e-5)
    assert got.kept_under_lost == pytest.approx(100 * len(under) / len(rows), abs=1e-5)


def test_profiles_split_at_a_third_of_the_first_height(spark, treatment):
    profiles = {r.shot_num: [r[f"pai_{h}"] for h in range(0, 101, 5)] for r in D.shot_profiles(spark, SF).collect()}
    heights = {r.shot_number: r.rh_98_a0 for r in D.shots(spark, SF).collect()}
    got = {key(r): r for r in Q.profile_split_pairs(spark, SF).collect()}
    assert set(got) == {key(r) for r in treatment}
    for (a, b), r in got.items():
        bucket = int(heights[a] / 3 // 5 * 5)
        assert r.t1_mid_tch_bucket == bucket
        for shot, upper, lower in ((a, r.t1_upper_pai, r.t1_lower_pai), (b, r.t2_upper_pai, r.t2_lower_pai)):
            pai = profiles[shot]
            assert (upper, lower) == pytest.approx((pai[bucket // 5] - pai[20], pai[0] - pai[bucket // 5]), abs=2e-6)
    single = Q.profile_split(spark, SF).collect()
    assert len(single) == len(profiles) and all(r.upper_pai is not None for r in single)
    series = {(r.story, r.series) for r in Q.profile_density(spark, SF).collect()}
    assert {s for _, s in series} <= {"before", "after, lost", "after, kept"} and {t for t, _ in series} == {"upper", "lower"}


def test_profile_outside_its_heights_is_null(spark):
    from twinshot.operators.profiles import split_profiles

    columns = ", ".join(f"{21 - i}.0D as pai_{h}" for i, h in enumerate(range(0, 101, 5)))
    df = spark.sql(f"select {columns}, h from values (60.0D), (330.0D), (-9.0D), (cast(null as double)) t(h)")
    out = split_profiles(df, "h", prefixes=("",), bucket="b").collect()
    assert [(r.b, r.upper_pai, r.lower_pai) for r in out] == [(20, 16.0, 4.0), (110, None, None), (-5, None, None), (None, None, None)]
