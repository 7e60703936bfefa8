"""The registered queries restated in plain SQL, with brute-force joins and no operators."""

from __future__ import annotations

R_EARTH = "6371008.7714e0"


def u(k: str, col: str = "o_orderkey") -> str:
    return f"(('0x'||substr(md5('{k}'||{col}::varchar),1,8))::bigint/4294967296e0)"


def hav(a: str, b: str) -> str:
    return (
        f"2*{R_EARTH}*asin(sqrt(pow(sin(radians({b}_lat-{a}_lat)/2),2)"
        f"+cos(radians({a}_lat))*cos(radians({b}_lat))*pow(sin(radians({b}_lon-{a}_lon)/2),2)))"
    )


def hash15(*cols: str) -> str:
    return "('0x'||substr(md5(" + "||'|'||".join(f"{c}::varchar" for c in cols) + "),1,15))::bigint"


def deg(row: str, col: str, mod: int) -> str:
    c = f"(({row})*31+({col})*17)%{mod}"
    return f"(case {c} when 0 then 1997 when 1 then 1998 when 2 then 1996 when 3 then 1997 else 9999 end)"


def defo(row: str, col: str) -> str:
    return f"(case (({row})*13+({col})*29)%17 when 0 then 1997 when 1 then 1999 else 9999 end)"


def alert(row: str, col: str, confidence: int | None = 3) -> str:
    """Day of the alert at a pixel, 0 if none, masked or of another confidence."""
    conf = "" if confidence is None else f"and (({row})*3+({col})*5)%5 = {confidence}"
    return (
        f"(case when (({row})*7+({col})*11)%6=0 and (({row})+({col})*3)%10<>0 {conf} "
        f"then (({row})*37+({col})*101)%2500+1 else 0 end)"
    )


PAIR_COLS = ("shot_number", "lon", "lat", "absolute_time", "agbd_a0", "rh_98_a0", "rh_50_a0")


def _both(t: str, cols=PAIR_COLS) -> str:
    return ", ".join(f"{t}.{c} as {t}_{c}" for c in cols)


def _cells2() -> str:
    """The 2 x 2 cells of a pair at p = 1..4 (x offset outer)."""
    return """
      select *, case when i=0 then x0i else x1i end as col, case when tile_n%10=4 then null when j=0 then y0i else y1i end as row from (
        select *, x0i + case when ux < x0i+0.5e0 then -1 else 1 end as x1i, y0i + case when uy < y0i+0.5e0 then -1 else 1 end as y1i from (
          select *, greatest(0, least(127, ceil(ux)::bigint-1)) as x0i, greatest(0, least(67, ceil(uy)::bigint-1)) as y0i from (
            select *, (t2_lon-(-60.001e0+tile_n*0.04e0))/0.00025e0 as ux, (t2_lat-(-5.001e0))/0.00025e0 as uy from pairs where tile_n%10<>7)))
      , (values (1,0,0),(2,0,1),(3,1,0),(4,1,1)) w(p,i,j)
      where x1i between 0 and 127 and y1i between 0 and 67"""


def _yearly_rows(f: str, g: str | None) -> str:
    clear = "" if g is None else " and (y2 < g or y1 > g)"
    gcol = "" if g is None else f", {g} as g"
    return f"""
      select t1_shot_number, t2_shot_number,
        sum(case when y1 < f and f < y2{clear} then 1 else 0 end)::int as measured_disturbance,
        sum(case when (y2 < f or y1 > f) and f > 1996{clear} then 1 else 0 end)::int as control_disturbance,
        {", ".join(f"max(case when p={p} and ((y1 < f and f < y2) or ((y2 < f or y1 > f) and f > 1996)){clear} then f else 0 end)::int as p{p}_disturb_date" for p in (1,2,3,4))}
      from (select *, {f} as f{gcol}, year(t1_absolute_time) as y1, year(t2_absolute_time) as y2 from cells2)
      group by 1, 2"""


def _first(d: str) -> str:
    return f"(case when {d} = 9999 then 1995 else {d} end)"


def _alert_rows(buffer: str, confidence: int | None, source: str = "cells3", extra: str = "") -> str:
    treat = f"(d - {buffer} > s1 and d < s2)"
    ctrl = f"(d <> 0 and (d < s1 or d - {buffer} > s2))"
    return f"""
      select t1_shot_number, t2_shot_number{extra},
        sum(case when {treat} then 1 else 0 end)::int as measured_disturbance,
        sum(case when {ctrl} then 1 else 0 end)::int as control_disturbance,
        {", ".join(f"max(case when p={p} and ({treat} or {ctrl}) then d else 0 end)::int as p{p}_disturb_date" for p in range(1, 10))}
      from (select *, {alert("row", "col", confidence)} as d,
              date_diff('day', date '1994-12-31', t1_absolute_time::date) as s1,
              date_diff('day', date '1994-12-31', t2_absolute_time::date) as s2 from {source})
      group by 1, 2{", 3" if extra else ""}"""


def _shots(orders: str, step: str, spread: str) -> str:
    return f"""select date_diff('day', date '1995-01-01', o_orderdate::date)::bigint*1000000+o_orderkey as shot_number,
          -60e0+floor(o_orderkey/{orders})*{step}+{u('x')}*{spread} as lon, -5e0+{u('y')}*{spread} as lat,
          o_orderdate as absolute_time, case when o_orderstatus='P' then 0 else 1 end as l4_quality_flag,
          o_totalprice/1000 as agbd_a0, o_totalprice/10000 as rh_98_a0,
          o_totalprice/10000*(0.2e0+{u('h')}*0.6e0) as rh_50_a0 from orders"""


CTES: dict[str, tuple[list[str], str]] = {
    "shots": ([], _shots("1500", "0.04e0", "0.016e0")),
    "wide": ([], _shots("15000", "0.1e0", "0.05e0")),
    "pairs": (
        ["shots"],
        f"""select *, (t2_shot_number%1000000)//1500 as tile_n,
          date_diff('day', t1_absolute_time::date, t2_absolute_time::date) as time_diff, {hav('t1', 't2')} as distance_m
          from (select {_both('t1')}, {_both('t2')} from shots t1 join shots t2 on t1.shot_number < t2.shot_number
            and t2.lat between t1.lat-0.0004e0 and t1.lat+0.0004e0) where {hav('t1', 't2')} <= 40e0""",
    ),
    "cells2": (["pairs"], _cells2()),
    "cells3": (
        ["pairs"],
        """select *, xc+i as col, case when tile_n%10=4 then null else yc+j end as row, (i+1)*3+(j+1)+1 as p from (
             select *, greatest(0, least(127, ceil(ux-0.5e0)::bigint)) as xc, greatest(0, least(67, ceil(uy-0.5e0)::bigint)) as yc from (
               select *, (t2_lon-(-60.001e0+tile_n*0.04e0))/0.00025e0 as ux, (t2_lat-(-5.001e0))/0.00025e0 as uy from pairs where tile_n%10<>7))
           , (values (-1),(0),(1)) a(i), (values (-1),(0),(1)) b(j)
           where xc between 1 and 126 and yc between 1 and 66""",
    ),
    "yearly": (["cells2"], _yearly_rows(_first(deg("row", "col", 11)), None)),
    "labelled": (
        ["yearly", "pairs"],
        """select p.*, y.* exclude (t1_shot_number, t2_shot_number),
             case when measured_disturbance>0 then 'treatment' when control_disturbance>0 then 'control' end as sample_grp
           from yearly y join pairs p using (t1_shot_number, t2_shot_number)""",
    ),
    "cohort": (
        ["labelled"],
        """select * exclude (r1, r2) from (select *, row_number() over (partition by sample_grp, t2_shot_number order by t1_shot_number) as r2 from (
             select *, row_number() over (partition by sample_grp, t1_shot_number order by t2_shot_number) as r1 from labelled
             where sample_grp is not null) where r1=1) where r2=1""",
    ),
    "strata": (
        ["cohort"],
        f"""select *, count(case when sample_grp='treatment' then 1 end) over (partition by bin) as nt,
              count(case when sample_grp='control' then 1 end) over (partition by bin) as nc,
              row_number() over (partition by bin, sample_grp order by h, t1_shot_number, t2_shot_number) as rn
            from (select *, case when time_diff > 0 and time_diff <= 1140 then ceil(time_diff/60)::int end as bin,
              {hash15('t1_shot_number', 't2_shot_number')} as h from cohort)""",
    ),
    "matched": (
        ["strata"],
        "select * from strata where sample_grp='treatment' or (bin is not null and rn <= least(nc, nt))",
    ),
    "matched2": (["strata"], "select * from strata where bin is not null and rn <= least(nc, nt)"),
    "alerts0": (["cells3"], _alert_rows("0", 3)),
    "treated": (
        ["alerts0"],
        """select * exclude (r1, r2) from (select *, row_number() over (partition by t2_shot_number order by t1_shot_number) as r2 from (
             select *, row_number() over (partition by t1_shot_number order by t2_shot_number) as r1 from alerts0
             where measured_disturbance > 0) where r1=1) where r2=1""",
    ),
    "aged": (
        ["treated", "pairs"],
        """select *, days_since_disturbance//30 as months from (
             select p.*, m as mode_disturb_days, date_diff('day', date '1994-12-31', t2_absolute_time::date) - m as days_since_disturbance
             from (select t1_shot_number, t2_shot_number, min(d) as m from (
               select *, max(c) over (partition by t1_shot_number, t2_shot_number) as top from (
                 select t1_shot_number, t2_shot_number, d, count(*) as c from (
                   select t1_shot_number, t2_shot_number, unnest([p1_disturb_date,p2_disturb_date,p3_disturb_date,p4_disturb_date,p5_disturb_date,p6_disturb_date,p7_disturb_date,p8_disturb_date,p9_disturb_date]) as d
                   from treated) where d <> 0 group by 1,2,3)) where c = top group by 1,2)
             join pairs p using (t1_shot_number, t2_shot_number)) where days_since_disturbance >= 0""",
    ),
    "intensity": (
        ["yearly", "cells2"],
        """select t1_shot_number, t2_shot_number,
             (sum(case when d=0 then 0 else least(valid, (row+col*2+b)%6)/(case when valid=0 then 1 else valid end) end)/4)::float::double as disturb_intensity
           from (select *, (row*3+col*5+b*7)%12 as valid from (
             select c.t1_shot_number, c.t2_shot_number, c.row, c.col, d, d-1996 as b from cells2 c join (
               select *, case q when 1 then p1_disturb_date when 2 then p2_disturb_date when 3 then p3_disturb_date else p4_disturb_date end as d
               from yearly, (values (1),(2),(3),(4)) w(q) where measured_disturbance+control_disturbance > 0) y
             on c.t1_shot_number=y.t1_shot_number and c.t2_shot_number=y.t2_shot_number and c.p=y.q)) group by 1,2""",
    ),
    "burn": (
        ["pairs"],
        """select *, """
        + " or ".join(f"burn_bool_{y}" for y in (1996, 1997, 1998, 1999))
        + " as interceding_burn from (select *, "
        + ", ".join(
            f"(v{b}<>0 and v{b}+{y}*1000 > year(t1_absolute_time)*1000+dayofyear(t1_absolute_time)"
            f" and v{b}+{y}*1000 < year(t2_absolute_time)*1000+dayofyear(t2_absolute_time)) as burn_bool_{y}"
            for b, y in enumerate((1996, 1997, 1998, 1999))
        )
        + " from (select *, "
        + ", ".join(f"case when (row*11+col*5+{b * 131})%730<=365 then (row*11+col*5+{b * 131})%730 else 0 end as v{b}" for b in range(4))
        + """ from (select *, greatest(0, least(127, ceil((t2_lon-(-60.001e0+tile_n*0.04e0))/0.00025e0-0.5e0)::bigint)) as col,
               case when tile_n%10=4 then null else greatest(0, least(67, ceil((t2_lat-(-5.001e0))/0.00025e0-0.5e0)::bigint)) end as row from pairs where tile_n%10<>7)))""",
    ),
    "grid": (
        [],
        """select 'T'||k::varchar as tile, k, r::int as row, c::int as col from
             (select distinct o_orderkey//1500 as k from orders where (o_orderkey//1500)%10 not in (4, 7)), range(68) a(r), range(128) b(c)""",
    ),
    "burned": (
        ["burn", "treated"],
        """select *, not (t2_rh_98_a0 >= 0.65e0*t1_rh_98_a0) as canopy_lost from burn
           semi join treated using (t1_shot_number, t2_shot_number) where interceding_burn and t1_rh_98_a0 >= 5 and t1_rh_50_a0 >= 2.5e0""",
    ),
    "profiles": (
        [],
        f"""select *, -- plant area above h, at the ground, at a third of the height and at the top
            p as pai_0, p*(1-b/100e0)*(1-q*(b/100e0)) as pai_b, 0e0 as pai_100 from (
          select o_orderkey, date_diff('day', date '1995-01-01', o_orderdate::date)::bigint*1000000+o_orderkey as shot,
            {u('p')}*6 as p, {u('q')} as q, (floor(o_totalprice/10000/3/5)*5)::int as b from orders)""",
    ),
    "split": (
        ["profiles", "treated", "pairs"],
        """select t.t1_shot_number, t.t2_shot_number, a.b as t1_mid_tch_bucket, a.pai_b-a.pai_100 as t1_upper, a.pai_0-a.pai_b as t1_lower,
             b.p*(1-a.b/100e0)*(1-b.q*(a.b/100e0))-b.pai_100 as t2_upper, b.pai_0-b.p*(1-a.b/100e0)*(1-b.q*(a.b/100e0)) as t2_lower
           from treated t join profiles a on a.shot=t1_shot_number join profiles b on b.shot=t2_shot_number""",
    ),
    "globe": (
        [],
        f"select o_orderkey, {u('x')}*360-180 as lon, {u('y')}*180-90 as lat from orders",
    ),
    "long": (
        ["pairs", "cohort"],
        "select control_group, metric, (t2-t1)/nullif(t1+t2,0) as value, (t2-t1)/nullif(t1+0.1e0,0)*100 as pct from ("
        + " union all ".join(
            f"select '{g}' as control_group, '{label}' as metric, t1_{m} as t1, t2_{m} as t2 from {src}"
            for g, src in (
                ("All pairs", "(select * from pairs where time_diff<>0 and ('0x'||substr(md5(t1_shot_number::varchar||'|'||t2_shot_number::varchar),1,8))::bigint < 429496729)"),
                ("Disturbed", "(select * from cohort where sample_grp='control')"),
            )
            for label, m in (("AGBD", "agbd_a0"), ("RH 98", "rh_98_a0"), ("RH 50", "rh_50_a0"))
        )
        + ")",
    ),
}


def _case_bins(x: str, edges: list[float]) -> str:
    return "case " + " ".join(f"when {x} > {a} and {x} <= {b} then {float(a)}e0" for a, b in zip(edges, edges[1:])) + " end"


# Bin edges.
INTENSITY_BINS = [0, 0.025, 0.05, 0.075, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
COARSE_BINS = [0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


def _binned(edges: list[float]) -> str:
    x = "disturb_intensity*4/measured_disturbance"
    return f"""select l.*, {_case_bins(x, edges)} as disturb_bin from intensity i
        join labelled l using (t1_shot_number, t2_shot_number) where sample_grp='treatment'"""


CTES["binned"] = (["intensity", "labelled"], _binned(INTENSITY_BINS))
CTES["binned2"] = (["intensity", "labelled"], _binned(COARSE_BINS))


def _boot_ctes(source: str, group: str, value: str, key: str, n: int) -> str:
    """CTEs ``boot`` (medians of resamples drawn by md5) over a source with groups ``grp``."""
    return f"""bs as (select {group}, {value} as v, {key} as k from {source}),
      brank as (select *, row_number() over (partition by {_names(group)} order by v) as rk, count(*) over (partition by {_names(group)}) as n from bs),
      draws as (select {_names(group)}, r as replicate, 1 + ('0x'||substr(md5('0|'||r::varchar||'|'||k),1,15))::bigint % n as rk
        from brank, range(1, {n + 1}) t(r)),
      boot as (select d.* exclude (rk), quantile_cont(b.v, 0.5) as median from draws d join brank b using ({_names(group)}, rk)
        group by all)"""


def _names(group: str) -> str:
    return ", ".join(g.strip().split(" as ")[-1] for g in group.split(","))


PAIR_KEY = "t1_shot_number::varchar||'|'||t2_shot_number::varchar"
LOSS = "(t1_agbd_a0-t2_agbd_a0)/t1_agbd_a0*100"

CTES["extent_src"] = (["cohort"], "select *, case when sample_grp='control' then 0 else measured_disturbance end as extent from cohort where t1_agbd_a0<>0")
CTES["month_src"] = (["aged"], "select * from aged where months < 23 and t1_agbd_a0<>0")
CTES["bin_src"] = (["binned"], "select * from binned where disturb_bin is not null and t1_agbd_a0<>0")
CTES["bin2_src"] = (["binned2"], "select * from binned2 where disturb_bin is not null and t1_agbd_a0<>0")


def sql(body: str, *needs: str, extra: str = "") -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} as materialized ({CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


HITS4 = "measured_disturbance, control_disturbance, " + ", ".join(f"p{i}_disturb_date" for i in range(1, 5))
HITS9 = "measured_disturbance, control_disturbance, " + ", ".join(f"p{i}_disturb_date" for i in range(1, 10))
METRIC3 = (("agbd_a0", "agbd_a0"), ("rh_98_a0", "rh_98_a0"), ("rh_50_a0", "rh_50_a0"))


def _pair_stats(source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    grp = f"group by {by}" if by else ""
    return " union all ".join(
        f"""select {g}'{m}' as metric, count(*) as n, round(avg(t2_{m}-t1_{m}),6) as bias,
          round(avg((t2_{m}-t1_{m})/nullif(t1_{m}+t2_{m},0)),6) as rel_diff, round(corr(t1_{m},t2_{m}),6) as corr,
          round(avg(t1_{m}),6) as mean_t1, round(avg(t2_{m}-t1_{m})/avg(t1_{m})*100,6) as pct_bias,
          round(sign(corr(t1_{m},t2_{m}))*stddev_samp(t2_{m})/stddev_samp(t1_{m}),6) as sma_slope,
          round(avg(t2_{m})-sign(corr(t1_{m},t2_{m}))*stddev_samp(t2_{m})/stddev_samp(t1_{m})*avg(t1_{m}),6) as sma_intercept
          from {source} {grp}"""
        for m, _ in METRIC3
    )


def _lags(source: str, edges: list[int], min_n: int) -> str:
    edges = sorted(edges)
    bands = ", ".join(f"({a},{b})" for a, b in zip(edges, edges[1:]))
    stats = ", ".join(
        f"round(case when count(x.t1_shot_number)>={min_n} then {fn}(t2_{m}-t1_{m}) end,6) as {k}_{name}"
        for name, m in (("agbd", "agbd_a0"), ("rh98", "rh_98_a0"))
        for k, fn in (("sd", "stddev_samp"), ("bias", "avg"))
    )
    return f"""select lo::bigint as lag_lo, hi::bigint as lag_hi, count(x.t1_shot_number) as n, {stats}
        from (values {bands}) b(lo, hi) left join {source} x on time_diff >= lo and time_diff < hi group by 1, 2"""


def t_tail(t: str, df: str) -> str:
    """Upper tail of Student's t by the midpoint rule on tan-transformed angles, normalised by gammas."""
    m = 20000
    return (
        f"(select sum(exp(lgamma(({df}+1)/2)-lgamma({df}/2)-0.5e0*ln(pi()))*pow(cos(a), {df}-1))*w from (select atan({t}/sqrt({df}))"
        f" + (least(pi()/2, atan({t}/sqrt({df}))+40e0/sqrt({df}))-atan({t}/sqrt({df})))*(s+0.5e0)/{m} as a,"
        f" (least(pi()/2, atan({t}/sqrt({df}))+40e0/sqrt({df}))-atan({t}/sqrt({df})))/{m} as w from range({m}) z(s)) group by w)"
    )


def _welch(value: str, source: str, group: str, a: str, b: str) -> str:
    return f"""select n1, n2, round(mean1,5) as mean1, round(mean2,5) as mean2, round(t,5) as t, round(df,5) as df,
        round(2*{t_tail('abs(t)', 'df')},5) as p_two_sided,
        round(case when t>=0 then {t_tail('abs(t)', 'df')} else 1-{t_tail('abs(t)', 'df')} end,5) as p_greater from (
        select *, (mean1-mean2)/sqrt(v1/n1+v2/n2) as t,
          pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)) as df from (
        select count(case when {group}='{a}' then {value} end) as n1, count(case when {group}='{b}' then {value} end) as n2,
          avg(case when {group}='{a}' then {value} end) as mean1, avg(case when {group}='{b}' then {value} end) as mean2,
          var_samp(case when {group}='{a}' then {value} end) as v1, var_samp(case when {group}='{b}' then {value} end) as v2
        from {source}))"""


CI = "count(*) as replicates, round(avg(median),6) as mean, round(quantile_cont(median,0.025),6) as ci_lo, round(quantile_cont(median,0.975),6) as ci_hi"


def _line_fit(x: str, where: str = "true") -> str:
    p = f"case when n > 2 then case when r2 < 1 then 2*{t_tail('(sqrt(r2)*sqrt((n-2)/(1-r2)))', '(n-2)')} else 0 end end"
    return f"""select round(avg(slope),6) as slope, round(avg(intercept),6) as intercept, round(avg(r2),6) as r2, round(avg(p),6) as p from (
        select *, {p} as p from (
        select replicate, count(*) as n, regr_slope(median, {x}) as slope, regr_intercept(median, {x}) as intercept,
          regr_r2(median, {x}) as r2 from boot where {where} group by replicate))"""


QUAD = f"""select replicate, n, round(b0,5) as b0, round(b_sq,5) as b_sq, round(b_lin,5) as b_lin,
    round(1-sse/sst*(n-1)/nullif(n-3,0),5) as adj_r2, round(case when n>3 then 2*{t_tail("abs(b0/sqrt(sse/(n-3)*i00))", "(n-3)")} end,5) as p0,
    round(case when n>3 then 2*{t_tail("abs(b_sq/sqrt(sse/(n-3)*i22))", "(n-3)")} end,5) as p_sq,
    round(case when n>3 then 2*{t_tail("abs(b_lin/sqrt(sse/(n-3)*i11))", "(n-3)")} end,5) as p_lin
  from (select replicate, any_value(n) as n, any_value(b0) as b0, any_value(b_lin) as b_lin, any_value(b_sq) as b_sq,
      any_value(i00) as i00, any_value(i11) as i11, any_value(i22) as i22,
      sum(pow(median-(b0+b_lin*months+b_sq*months*months),2)) as sse, any_value(sst) as sst
    from boot join (
      select *, i00*y0+i01*y1+i02*y2 as b0, i01*y0+i11*y1+i12*y2 as b_lin, i02*y0+i12*y1+i22*y2 as b_sq from (
      select *, (s2*s4-s3*s3)/det as i00, (s2*s3-s1*s4)/det as i01, (s1*s3-s2*s2)/det as i02,
        (n*s4-s2*s2)/det as i11, (s1*s2-n*s3)/det as i12, (n*s2-s1*s1)/det as i22 from (
      select *, n*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) as det from (
      select replicate, count(*) as n, sum(months)::double as s1, sum(pow(months,2)) as s2, sum(pow(months,3)) as s3, sum(pow(months,4)) as s4,
        sum(median) as y0, sum(median*months) as y1, sum(median*months*months) as y2, var_pop(median)*count(*) as sst
      from boot group by replicate)))) using (replicate) group by replicate)"""


def build(region: list, chunk_region: list) -> dict[str, str]:
    closed = [*region, region[0]]
    inside = "(" + "+".join(
        f"(case when ({a[1]}>lat)<>({b[1]}>lat) and lon < ({b[0]}-({a[0]}))*(lat-({a[1]}))/({b[1]}-({a[1]}))+({a[0]}) then 1 else 0 end)"
        for a, b in ((tuple(f"{v}e0" for v in p), tuple(f"{v}e0" for v in q)) for p, q in zip(closed, closed[1:]))
    ) + ")%2=1"
    chunk_rows = _chunks(chunk_region)
    q: dict[str, str] = {}
    q["points_from_wkb_bytes"] = """select o_orderkey,
        round(-32e0*(1+('0x'||substr(md5('x'||o_orderkey::varchar),1,13))::bigint/4503599627370496e0),9) as lon,
        round(-4e0*(1+('0x'||substr(md5('y'||o_orderkey::varchar),1,13))::bigint/4503599627370496e0),9) as lat from orders"""
    q["tile_tokens_from_paths"] = """select case when c_nationkey%2=0 then 'ID'||c_nationkey::varchar||'_'||c_mktsegment
        else 'S9_W'||(c_nationkey+60)::varchar||'-0000016384-0000000000' end as tile, count(*) as n from customer group by 1 having count(*)>1"""
    q["tile_index"] = """select 'T'||k::varchar as tile, 128::int as nx, 68::int as ny, round(-60.001e0+k*0.04e0,6) as xmin, -5.001e0 as ymin,
        round(-60.001e0+k*0.04e0+128*0.00025e0,6) as xmax, round(-5.001e0+68*0.00025e0,6) as ymax from (select distinct o_orderkey//1500 as k from orders where (o_orderkey//1500)%10 not in (4, 7))"""
    q["stack_yearly_bands"] = sql(
        "select tile, row, col, " + ", ".join(f"case when {y} >= {deg('row','col',11)} then 2 else 1 end::int as y{y}" for y in (1996, 1997, 1998, 1999)) + " from grid", "grid")
    q["prefixed_shots"] = sql("""select shot_number as t1_shot_number, round(lon,6) as t1_lon, round(lat,6) as t1_lat,
        l4_quality_flag as t1_l4_quality_flag from shots where l4_quality_flag=1""", "shots")
    q["shots_in_region"] = sql(f"select shot_number from shots where {inside}", "shots")
    q["shots_per_chunk"] = sql(f"""select name, xmin::int as xmin, ymin::int as ymin, count(shot_number) as shots from (values {chunk_rows}) c(name, xmin, ymin)
        left join shots on lon >= xmin and lon < xmin+2 and lat >= ymin and lat < ymin+2 group by 1,2,3""", "shots")
    q["utm_zones"] = sql("""select 'epsg:'||case when lat>=0 then '326' else '327' end||lpad(((floor((lon+180)/6)::int)%60+1)::varchar,2,'0') as epsg,
        count(*) as n from globe group by 1""", "globe")
    q["corner_names"] = sql("""select case when y<0 then 'S' else 'N' end||abs(y)::int::varchar||'_'||case when x<0 then 'W' else 'E' end||abs(x)::int::varchar as name,
        count(*) as n from (select floor(lon/10)*10 as x, floor(lat/10)*10+10 as y from globe) group by 1""", "globe")
    q["geo_partition_cells"] = sql("""select (trunc(lon/2)*360+trunc(lat/2))::int as cell, count(*) as n, 1::bigint as partitions, 0::bigint as out_of_range
        from globe group by 1""", "globe")
    q["raster_indices"] = sql("""select shot_number, 'T'||k::varchar as tile, greatest(0,least(127,ceil(ux-0.5e0)::bigint)) as nearest, i0 as first,
        i0+case when ux < i0+0.5e0 then -1 else 1 end as second, floor(ux)::bigint as floor from (
        select *, greatest(0,least(127,ceil(ux)::bigint-1)) as i0 from (
        select shot_number, k, (lon-(-60.001e0+k*0.04e0))/0.00025e0 as ux from (select *, (shot_number%1000000)//1500 as k from shots) where k%10<>7))""", "shots")
    q["cropped_pixels"] = sql("""select tile, row, col, round(lon,6) as lon, round(lat,6) as lat, nullif(v%7,0)::double as value from (
        select tile, row, col, case when (row*7+col*11)%6=0 then ((row*3+col*5)%5)*10000+(row*37+col*101)%2500+1 else 0 end as v,
          -60.001e0+k*0.04e0+(col+0.5e0)*0.00025e0 as lon, -5.001e0+(row+0.5e0)*0.00025e0 as lat from grid)
        where lon between -59.99e0 and -59.98e0 and lat between -4.99e0 and -4.985e0""", "grid")
    q["sampled_pairs"] = sql("""select t1_shot_number, t2_shot_number from pairs
        where ('0x'||substr(md5(t1_shot_number::varchar||'|'||t2_shot_number::varchar),1,8))::bigint < 429496729""", "pairs")
    q["event_days"] = "select event_id, floor((epoch_us(ts)-epoch_us(timestamp '2024-01-15 12:30:00'))/86400000000)::bigint as days from events"
    q["shot_dates"] = sql("""select shot_number, date_diff('day', date '1994-12-31', absolute_time::date)::int as t1_days, year(absolute_time)::int as t1_year,
        (year(absolute_time)*1000+dayofyear(absolute_time))::int as t1_yyyydoy from shots""", "shots")
    q["safe_ratio_means"] = """select l_returnflag, count(v) as n, round(avg(v),6) as rel_diff from (
        select l_returnflag, (l_tax-l_discount)/nullif(l_tax+l_discount,0) as v from lineitem) group by 1"""
    q["near_pairs"] = sql("select t1_shot_number, t2_shot_number, round(distance_m,4) as distance_m from pairs", "pairs")
    def of_region(shots: str) -> str:
        return sql(f"""select t1_shot_number, t2_shot_number, round({hav('t1','t2')},4) as distance_m from (
        select {_both('t1')}, {_both('t2')} from s t1 join s t2 on t1.shot_number<t2.shot_number and t2.lat between t1.lat-0.0004e0 and t1.lat+0.0004e0)
        where {hav('t1','t2')} <= 40e0""", shots, extra=f"s as (select * from {shots} where l4_quality_flag=1 and {inside})")

    q["near_pairs_of_region"] = of_region("wide")
    q["enriched_pairs"] = sql("""select t1_shot_number, t2_shot_number, round(a.agbd,6) as t1_agbd_a0, round(a.rh,6) as t1_rh_98_a0,
        round(b.agbd,6) as t2_agbd_a0, round(b.rh,6) as t2_rh_98_a0 from pairs
        join m a on a.k=t1_shot_number join m b on b.k=t2_shot_number""", "pairs",
        extra="""m as (select date_diff('day', date '1995-01-01', o_orderdate::date)::bigint*1000000+o_orderkey as k, o_totalprice/1000 as agbd,
          o_totalprice/10000 as rh from orders join customer on o_custkey=c_custkey where not c_acctbal<0)""")
    q["closer_than_30m"] = sql("select t1_shot_number, t2_shot_number from pairs where distance_m < 30", "pairs")
    q["placed_pairs"] = sql("select t1_shot_number, t2_shot_number, 'T'||tile_n::varchar as tile from pairs where tile_n%10<>7", "pairs")
    q["overlay_yearly"] = sql(f"""select t1_shot_number, t2_shot_number, 'T'||((t2_shot_number%1000000)//1500)::varchar as tile, {HITS4} from yearly""", "yearly")
    q["overlay_yearly_by_rule"] = q["overlay_yearly"]
    # Deforestation wins from its year on, so degradation shows only if it starts earlier.
    d, g = deg("row", "col", 11), defo("row", "col")
    q["overlay_yearly_no_deforestation"] = sql(
        "select * from (" + _yearly_rows(f"(case when {d}=9999 or {g}<={d} then 1995 else {d} end)", _first(g)) + ")", "cells2")
    q["overlay_alerts_buffered"] = sql(f"select t1_shot_number, t2_shot_number, {HITS9} from ({_alert_rows('30', 3)}) where measured_disturbance+control_disturbance>0", "cells3")
    q["overlay_alerts_any_confidence"] = sql(f"select t1_shot_number, t2_shot_number, {HITS9} from ({_alert_rows('0', None)})", "cells3")
    q["split_alert_codes"] = sql("""select tile, row, col, ((row*3+col*5)%5)::int as confidence, ((row*37+col*101)%2500+1)::int as day from grid
        where (row*7+col*11)%6=0 and (row+col*3)%10<>0""", "grid")
    q["unmatched_tiles"] = """select round(-60.001e0+k*0.04e0,6) as xmin, case when k%3<>1 and side<>'b' then 'T'||k::varchar end as a_tile,
        case when side<>'a' then 'T'||k::varchar end as b_tile,
        case side when 'a' then 'a_only' when 'b' then 'b_only' else 'both' end as status from (
        select k, unnest(case when k%3=1 then ['b'] when k%3=2 then ['a','b'] else ['ab'] end) as side from (select distinct o_orderkey//1500 as k from orders where (o_orderkey//1500)%10<>7))"""
    q["window_lookup"] = sql(f"select p, (case when 1999 >= {deg('row','col',11)} then 2 else 1 end)::int as class, count(*) as n from cells2 where row is not null group by 1,2", "cells2")
    for name, mods in (("intact_pairs", (97,)), ("intact_in_both", (97, 89))):
        ok = " and ".join(f"sum(case when {deg('row','col',m)}<>9999 then 1 else 0 end)=0" for m in mods)
        q[name] = sql(f"select t1_shot_number, t2_shot_number from cells3 group by 1,2 having {ok} and count(row)=9", "cells3")
    q["job_find_pairs"] = of_region("shots").replace("as distance_m from", "as distance_m, round(t2_agbd_a0,6) as t2_agbd_a0 from")
    q["job_add_metrics"] = q["enriched_pairs"]
    q["enriched_pairs_colocated"] = q["enriched_pairs"]
    q["metrics_from_csv"] = """select date_diff('day', date '1995-01-01', o_orderdate::date)::bigint*1000000+o_orderkey as shot_num, round(o_totalprice/1000,6) as agbd_a0,
        round(o_totalprice/10000,6) as rh_98_a0, (c_acctbal < 0)::int as outlier_umd from orders join customer on o_custkey=c_custkey"""
    q["job_yearly_degradation"] = f"select * from ({q['overlay_yearly_no_deforestation']}) where measured_disturbance+control_disturbance>0"
    q["job_alert_degradation"] = q["overlay_alerts_buffered"]
    q["job_intact_controls"] = q["intact_pairs"]
    q["chunked_pairs"] = sql("select count(*) as n, 0::bigint as too_large from pairs", "pairs")
    q["treatment_hand_off"] = sql("select t1_shot_number, t2_shot_number, round(t1_agbd_a0,6) as t1_agbd_a0, measured_disturbance from cohort where sample_grp='treatment'", "cohort")
    q["overlay_intensity"] = sql("select t1_shot_number, t2_shot_number, round(disturb_intensity, 4) as disturb_intensity from intensity", "intensity")
    q["job_disturbance_intensity"] = q["overlay_intensity"]
    q["overlay_burn"] = sql("select t1_shot_number, t2_shot_number, burn_bool_1996, burn_bool_1997, burn_bool_1998, burn_bool_1999, interceding_burn from burn", "burn")
    q["group_counts"] = sql("select sample_grp, count(*) as n from labelled group by 1", "labelled")
    q["dedup_pairs"] = sql("select sample_grp, t1_shot_number, t2_shot_number from cohort", "cohort")
    q["duplicate_counts"] = sql("""select sample_grp, count(*) as n, count(*)-count(distinct t1_shot_number) as s1_duplicates,
        count(*)-count(distinct t2_shot_number) as s2_duplicates from labelled group by 1""", "labelled")
    q["matched_controls"] = sql("select sample_grp, t1_shot_number, t2_shot_number from matched", "matched")
    q["matched_both"] = sql("select sample_grp, t1_shot_number, t2_shot_number from matched2", "matched2")
    q["treatment_rows"] = sql(f"select t1_shot_number, t2_shot_number, round({LOSS},6) as agbd_pct_loss from cohort where sample_grp='treatment' and t1_agbd_a0<>0", "cohort")
    q["pair_statistics"] = sql(_pair_stats("(select * from pairs where time_diff<>0)"), "pairs")
    q["pair_statistics_by_group"] = sql(_pair_stats("matched2", "sample_grp"), "matched2")
    q["sma_fit"] = """select l_returnflag, count(*) as n, round(s,6) as slope, round(my-s*mx,6) as intercept, round(r,6) as r from (
        select *, sign(r)*sy/sx as s from (select l_returnflag, corr(l_quantity,l_extendedprice) as r, stddev_samp(l_quantity) as sx, stddev_samp(l_extendedprice) as sy,
          avg(l_quantity) as mx, avg(l_extendedprice) as my, count(*) as n from lineitem group by 1)) group by all""".replace("count(*) as n, round(s", "any_value(n) as n, round(s").replace(" group by all", " group by l_returnflag, s, my, mx, r")
    q["lag_profile"] = sql(_lags("pairs", [1100, 1000, 900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 100, 50, 0], 0), "pairs")
    q["lag_profile_of_controls"] = sql(_lags("c", [1200, 1000, 900, 800, 700, 600, 500, 400, 300, 200, 100, 50, 0], 40), "cohort",
        extra="c as (select * from cohort where sample_grp='control')")
    q["buffer_sweep"] = sql(f"""select buffer_days, count(*) as n, round(avg(t2_agbd_a0-t1_agbd_a0),6) as bias from
        ({_alert_rows('buffer_days', 3, '(select * from cells3, (values (0),(30),(60),(90),(120),(150),(180)) b(buffer_days))', ', buffer_days')})
        join pairs using (t1_shot_number, t2_shot_number) where measured_disturbance=0 and control_disturbance>0 group by 1""", "cells3")
    q["long_metric_means"] = sql("select control_group, metric, count(*) as n, round(avg(pct),6) as mean from long group by 1,2", "long")
    q["metric_quartiles"] = sql("""select control_group, metric, count(*) as n, round(quantile_cont(value,0.25),6) as q25, round(quantile_cont(value,0.5),6) as q50,
        round(quantile_cont(value,0.75),6) as q75 from long group by 1,2""", "long")
    q["quartiles_with_unlabelled"] = sql("""select sample_grp, count(*) as n, round(quantile_cont(time_diff,0.25),6) as q25,
        round(quantile_cont(time_diff,0.5),6) as q50, round(quantile_cont(time_diff,0.75),6) as q75 from labelled group by 1""", "labelled")
    q["event_box_stats"] = """with q as (select event_type, count(value) as n, quantile_cont(value,0.25) as q25, quantile_cont(value,0.5) as q50, quantile_cont(value,0.75) as q75
          from events group by 1)
        select event_type, n, round(q25,6) as q25, round(q50,6) as q50, round(q75,6) as q75, round(min(value),6) as whisker_lo, round(max(value),6) as whisker_hi
        from events join q using (event_type) where value between q25-1.5e0*(q75-q25) and q75+1.5e0*(q75-q25) group by all"""
    q["price_quartiles"] = """select count(*) as n, round(quantile_cont(l_extendedprice,0.25),6) as q25, round(quantile_cont(l_extendedprice,0.5),6) as q50,
        round(quantile_cont(l_extendedprice,0.75),6) as q75 from lineitem"""
    q["value_histogram"] = """with m as (select event_type, min(value) as lo, (max(value)-min(value))/50 as w from events group by 1)
        select event_type, least(49, floor((value-lo)/w))::int as bin, round(lo+least(49, floor((value-lo)/w))::int*w,6) as bin_lo, count(*) as n
        from events join m using (event_type) group by event_type, bin, lo, w"""
    q["time_histogram"] = """with m as (select min(epoch_us(ts)/1e6) as lo, (max(epoch_us(ts)/1e6)-min(epoch_us(ts)/1e6))/20 as w from events)
        select least(19, floor((epoch_us(ts)/1e6-lo)/w))::int as bin, count(*) as n from events, m group by 1"""
    q["hexbin_density"] = sql("""select round(cu*sx+xl,6) as cx, round(cv*sy+yl,6) as cy, count(*) as n from (
        select *, case when near then round_even(u,0) else floor(u)+0.5e0 end as cu, case when near then round_even(v,0) else floor(v)+0.5e0 end as cv from (
        select *, pow(u-round_even(u,0),2)+3*pow(v-round_even(v,0),2) < pow(u-floor(u)-0.5e0,2)+3*pow(v-floor(v)-0.5e0,2) as near from (
        select *, (t1_rh_98_a0-xl)/sx as u, (t2_rh_98_a0-yl)/sy as v from pairs, (select min(t1_rh_98_a0)-1e-9*(max(t1_rh_98_a0)-min(t1_rh_98_a0)) as xl,
          min(t2_rh_98_a0)-1e-9*(max(t2_rh_98_a0)-min(t2_rh_98_a0)) as yl,
          (max(t1_rh_98_a0)-min(t1_rh_98_a0))*(1+2e-9)/100 as sx, (max(t2_rh_98_a0)-min(t2_rh_98_a0))*(1+2e-9)/57 as sy from pairs) m)))
        group by cu, cv, sx, sy, xl, yl having count(*) >= 6""", "pairs")
    q["kernel_density"] = """with m as (select event_type, count(*) as n, stddev_samp(value)*pow(count(*),-0.2e0) as bw, min(value) as lo, max(value) as hi from events group by 1)
        select event_type, point::int as point, round(x,6) as x, round(sum(exp(-0.5e0*pow((x-value)/bw,2)))/(any_value(n)*any_value(bw)*sqrt(2*pi())),8) as density from (
          select e.event_type, value, n, bw, point, lo-3*bw+point*((hi-lo+6*bw)/199) as x from events e join m using (event_type), range(200) g(point)) group by event_type, point, x"""
    q["disturbance_bins"] = sql("select disturb_bin, count(*) as n from binned where disturb_bin is not null group by 1", "binned")
    q["largest_extents"] = sql("select sample_grp, max(measured_disturbance) as max_measured_disturbance from labelled group by 1", "labelled")
    q["disturbance_age"] = sql("select t1_shot_number, t2_shot_number, mode_disturb_days, days_since_disturbance::int as days_since_disturbance, months::bigint as months from aged", "aged")
    q["burned_shares"] = sql("""select count(*) as n, round(100.0e0*count(case when not canopy_lost then 1 end)/count(*),6) as canopy_kept,
        round(100.0e0*count(case when not canopy_lost and t2_rh_50_a0<=2.5e0 then 1 end)/nullif(count(case when not canopy_lost then 1 end),0),6) as under_lost_of_kept,
        round(100.0e0*count(case when not canopy_lost and t2_rh_50_a0<=2.5e0 then 1 end)/count(*),6) as kept_under_lost from burned""", "burned")
    q["profile_split"] = sql("select o_orderkey, b as bucket, round(pai_b-pai_100,6) as upper_pai, round(pai_0-pai_b,6) as lower_pai from profiles", "profiles")
    q["profile_split_pairs"] = sql("""select t1_shot_number, t2_shot_number, t1_mid_tch_bucket, round(t1_upper,6) as t1_upper_pai, round(t1_lower,6) as t1_lower_pai,
        round(t2_upper,6) as t2_upper_pai, round(t2_lower,6) as t2_lower_pai from split""", "split")
    q["profile_density"] = sql("""select story, series, point::int as point, round(x,6) as x,
        round(sum(exp(-0.5e0*pow((x-value)/bw,2)))/(any_value(n)*any_value(bw)*sqrt(2*pi())),8) as density from (
          select *, lo-3*bw+point*((hi-lo+6*bw)/199) as x from series join (
            select story, series, count(*) as n, stddev_samp(value)*pow(count(*),-0.2e0) as bw, min(value) as lo, max(value) as hi from series group by 1, 2) using (story, series), range(200) g(point))
        group by story, series, point, x""", "split", "burned", extra="""series as (
          select unnest(['upper', 'upper', 'lower', 'lower']) as story, unnest(['before', 'after', 'before', 'after']) || unnest(['', late, '', late]) as series,
            unnest([t1_upper, t2_upper, t1_lower, t2_lower]) as value
          from (select split.*, case when canopy_lost then ', lost' else ', kept' end as late from split join burned using (t1_shot_number, t2_shot_number)))""")
    q["welch_test"] = sql(_welch("t2_agbd_a0-t1_agbd_a0", "matched", "sample_grp", "control", "treatment"), "matched")
    q["welch_test_single_pixel"] = sql(_welch("t2_agbd_a0-t1_agbd_a0", "(select * from matched where sample_grp='control' or measured_disturbance=1)", "sample_grp", "control", "treatment"), "matched")
    q["welch_test_prices"] = _welch("l_extendedprice", "lineitem", "l_returnflag", "A", "R")
    ext = _boot_ctes("extent_src", "extent", LOSS, PAIR_KEY, 100)
    q["bootstrap_by_extent"] = sql(f"select extent, {CI} from boot group by 1", "extent_src", extra=ext)
    q["extent_fit"] = sql(_line_fit("extent", "extent>0"), "extent_src", extra=ext)
    mon = _boot_ctes("month_src", "months", LOSS, PAIR_KEY, 100)
    q["bootstrap_by_month"] = sql(f"select months, {CI} from boot group by 1", "month_src", extra=mon)
    q["month_quadratic_fit"] = sql(QUAD, "month_src", extra=mon)
    bins = _boot_ctes("bin_src", "disturb_bin", LOSS, PAIR_KEY, 100)
    q["bootstrap_by_intensity"] = sql(f"select disturb_bin, {CI} from boot group by 1", "bin_src", extra=bins)
    q["intensity_sqrt_fit"] = sql(_line_fit("sqrt(disturb_bin)"), "bin_src", extra=bins)
    bins2 = _boot_ctes("bin2_src", "measured_disturbance, disturb_bin", LOSS, PAIR_KEY, 100)
    q["intensity_correlation_by_extent"] = sql(f"""select measured_disturbance, n, round(r,6) as r,
        round(case when n>2 and r is not null then case when abs(r)<1 then 2*{t_tail('(abs(r)*sqrt((n-2)/(1-r*r)))', '(n-2)')} else 0 end end,6) as p from (
        select measured_disturbance, count(*) as n, case when count(*)>1 then corr(disturb_bin, mean) end as r from (
        select measured_disturbance, disturb_bin, avg(median) as mean from boot group by 1,2) group by 1)""", "bin2_src", extra=bins2)
    ev = _boot_ctes("events", "event_type", "value", "event_id::varchar", 100)
    q["bootstrap_event_values"] = f"with {ev} select event_type, {CI} from boot group by 1"
    q["disturbance_summary"] = sql("""select sample_grp, count(*) as n_pairs, round(avg(t2_agbd_a0-t1_agbd_a0),6) as bias_agbd, round(avg(t2_rh_98_a0-t1_rh_98_a0),6) as bias_rh98,
        round(corr(t1_agbd_a0,t2_agbd_a0),6) as corr_agbd from cohort group by 1""", "cohort")
    return q


def _chunks(ring: list) -> str:
    """Chunks of the test polygon, listed by hand from a drawing of it."""
    rows = [
        ("S4_W61", -61, -6), ("S4_W59", -59, -6), ("S2_W61", -61, -4),
    ]
    return ", ".join(f"('{n}', {x}, {y})" for n, x, y in rows)
