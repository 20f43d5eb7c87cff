"""Queries over landmark stacks and metrics, each with its SQL twin.

Risks are fixed expressions of a row's price, so that both engines score the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import rounded
from hazardframe.operators import estimators as est
from hazardframe.operators import landmark as lm
from hazardframe.operators import metrics as mt
from hazardframe.plans.basic import POOLED, WINDOWS
from hazardframe.plans.cohort import CAUSES, CP_SQL, orders_cp
from hazardframe.plans.registry import query

LANDMARKS = [0.0, 365.0, 730.0, 1095.0, 1460.0]
HORIZON = 365.0

#: DuckDB: ids at risk at each landmark (ids), and their known rows (h).
STACK = (
    CP_SQL
    + """, lms as (select unnest([0.0, 365.0, 730.0, 1095.0, 1460.0])::double as s),
 sub as (select id, min(start) as entry, max(stop) as u, max(event) as lab from cp group by id),
 h as (select lms.s, cp.id, sub.u, sub.lab, cp.start, cp.price from cp join sub using (id) join lms on cp.start <= lms.s and sub.entry <= lms.s and lms.s < sub.u)"""
)
#: The same with the last price as a feature and the outcome within the horizon.
LAST = STACK + """, y as (select id, s as landmark, least(u, s + 365) - s as stop, case when u <= s + 365 then lab else 0 end as event, arg_max(price, start) as price from h group by id, s, u, lab)"""
AGG_SQL = {
    "last": "arg_max(price, start)",
    "first": "arg_min(price, start)",
    "mean": "avg(price)",
    "min": "min(price)",
    "max": "max(price)",
    "sum": "coalesce(sum(price), 0)",
    "count": "cast(count(*) as double)",
    "slope": "case when count(distinct start) < 2 then null else regr_slope(price, start) end",
    "std": "stddev_samp(price)",
}


@query(
    "landmark_stack",
    STACK
    + " select id, s as landmark, 0.0::double as start, least(u, s + 365) - s as stop, case when u <= s + 365 then lab else 0 end as event, "
    + ", ".join(f"round({x}, 6) as {'price' if a == 'last' else 'price_' + a}" for a, x in AGG_SQL.items())
    + " from h group by id, s, u, lab",
)
def landmark_stack(spark, sf_dir):
    specs = ["price" if a == "last" else ("price", a) for a in AGG_SQL]
    return rounded(lm.landmark_stack(orders_cp(spark, sf_dir), HORIZON, specs, LANDMARKS), 6)


def _one_aggregation(name):
    @query(f"landmark_{name}", STACK + f" select id, s as landmark, round({AGG_SQL[name]}, 6) as price_{name} from h group by id, s")
    def run(spark, sf_dir):
        out = lm.landmark_stack(orders_cp(spark, sf_dir), HORIZON, [("price", name)], LANDMARKS)
        return rounded(out.select("id", "landmark", f"price_{name}"), 6)

    return run


for _name in AGG_SQL:
    _one_aggregation(_name)


@query(
    "landmark_features_s365",
    CP_SQL
    + """, sub as (select id, min(start) as entry, max(stop) as u, max(event) as lab from cp group by id)
select cp.id, 365.0::double as landmark, arg_max(price, start) as price, cast(count(*) as double) as price_count from cp join sub using (id)
where start <= 365 and entry <= 365 and 365 <= u and not (u <= 365 and lab != 0) group by cp.id""",
)
def landmark_features_s365(spark, sf_dir):
    return lm.landmark_features(orders_cp(spark, sf_dir), 365.0, ["price", ("price", "count")])


@query("landmark_grid_step_500", CP_SQL + ", b as (select min(start) as a, max(stop) as z from cp) select cast(unnest(generate_series(cast(a as bigint), cast(z - 1 as bigint), 500)) as double) as landmark from b")
def landmark_grid(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in lm.landmark_times(orders_cp(spark, sf_dir), step=500.0)], "landmark double")


RISK = "floor(price / 20000)"


def _risk_rows(spark, sf_dir):
    return orders_cp(spark, sf_dir).df.withColumn("risk", F.floor(F.col("price") / 20000).cast("double"))


TYPE_A = """select 1.0 as w, i.risk as r, j.risk as r2 from x i join x j on j.start < i.stop and i.stop <= j.stop
 and not (j.event != 0 and j.stop = i.stop) and j.id != i.id where {case}"""
TYPE_B = "select 1.0, i.risk, j.risk from x i join x j on j.event != 0 and j.event != 1 and j.stop <= i.stop and j.id != i.id where i.event = 1"
AGREE = "round(sum(w * (case when r > r2 then 1 when r = r2 then 0.5 else 0 end)) / sum(w), 9) as concordance, round(cast(sum(w) as double), 6) as pairs"


@query("concordance_cp", CP_SQL + f", x as (select id, start, stop, event, {RISK} as risk from cp), p as ({TYPE_A.format(case='i.event != 0')}) select {AGREE} from p")
def concordance_cp(spark, sf_dir):
    return rounded(mt.concordance(_risk_rows(spark, sf_dir)))


@query("concordance_cr", CP_SQL + f", x as (select id, start, stop, event, {RISK} as risk from cp), p as ({TYPE_A.format(case='i.event = 1')} union all {TYPE_B}) select {AGREE} from p")
def concordance_cr(spark, sf_dir):
    return rounded(mt.concordance_competing(_risk_rows(spark, sf_dir), 1))


#: DuckDB: outcomes at landmark 365 with a risk, the censoring survival just before each time, and weights at horizon 200.
S365 = LAST + ", z as (select id, 0.0::double as start, stop, event, least(0.99, price / 400000) as risk from y where landmark = 365)"
WEIGHTS = (
    S365
    + """, ct as (select stop as t, count(*) filter (event = 0) as c, count(*) filter (event != 0) as d from z group by 1),
 gg as (select t, product(1 - c / ((select count(*) from z where z.stop >= ct.t) - d)) over (order by t) as g from ct where c > 0),
 cl as (select *, event != 0 and stop <= 200 and ({case}) as kase, event != 0 and stop <= 200 and not ({case}) as comp,
   stop >= 200 and not (event != 0 and stop <= 200) as ctrl from z),
 gw as (select *, coalesce((select arg_max(g, t) from gg where gg.t < (case when kase or comp then cl.stop else 200 end)), 1) as g from cl),
 ww as (select *, case when (select bool_and(kase or comp or ctrl) from cl) then 1.0::double when kase or comp or ctrl then 1 / greatest(g, 0.05) else 0 end as w,
   not (select bool_and(kase or comp or ctrl) from cl) and (kase or comp or ctrl) and g < 0.05 as clip from gw)"""
)
ANY, ONE = WEIGHTS.format(case="true"), WEIGHTS.format(case="event = 1")
BRIER = """ select round(avg(w * pow(cast(kase as double) - risk, 2)), 9) as brier, count(*) as n, cast(sum(kase::int) as bigint) as n_cases, cast(sum(comp::int) as bigint) as n_competing,
 cast(sum(ctrl::int) as bigint) as n_controls, cast(sum((not (kase or comp or ctrl))::int) as bigint) as n_censored, cast(sum(clip::int) as bigint) as n_clipped from ww"""


def _s365(spark, sf_dir):
    rows = lm.landmark_stack(orders_cp(spark, sf_dir), HORIZON, ["price"], [365.0])
    return rows.select("id", "start", "stop", "event", F.least(F.lit(0.99), F.col("price") / 400000).alias("risk"))


@query("brier_landmark", ANY + BRIER)
def brier_landmark(spark, sf_dir):
    return rounded(mt.brier(_s365(spark, sf_dir), 200.0))


@query("brier_cause", ONE + BRIER)
def brier_cause(spark, sf_dir):
    return rounded(mt.brier(_s365(spark, sf_dir), 200.0, cause=1))


@query(
    "brier_by_landmark",
    LAST
    + """, z as (select landmark, stop, event, least(0.99, price / 400000) as risk from y),
 cls as (select *, event != 0 and stop <= 200 as kase, stop >= 200 and not (event != 0 and stop <= 200) as ctrl from z),
 ct as (select landmark, stop as t, count(*) filter (event = 0) as c, count(*) filter (event != 0) as d from z group by 1, 2),
 gg as (select landmark, t, product(1 - c / ((select count(*) from z where z.landmark = ct.landmark and z.stop >= ct.t) - d)) over (partition by landmark order by t) as g from ct where c > 0),
 ex as (select landmark, bool_and(kase or ctrl) as exact from cls group by 1),
 ww as (select cls.*, case when exact then 1.0::double when kase or ctrl then 1 / greatest(0.05,
   coalesce((select arg_max(g, t) from gg where gg.landmark = cls.landmark and gg.t < (case when kase then cls.stop else 200 end)), 1)) else 0 end as w from cls join ex using (landmark))
select landmark, round(avg(w * pow(cast(kase as double) - risk, 2)), 9) as brier, count(*) as n from ww group by 1""",
)
def brier_by_landmark(spark, sf_dir):
    rows = lm.landmark_stack(orders_cp(spark, sf_dir), HORIZON, ["price"], LANDMARKS)
    rows = rows.select("landmark", "id", "start", "stop", "event", F.least(F.lit(0.99), F.col("price") / 400000).alias("risk"))
    return rounded(mt.brier(rows, 200.0, by=["landmark"]).select("landmark", "brier", "n"))


IBS_TIMES = [50.0, 100.0, 200.0, 300.0]


@query(
    "integrated_brier",
    S365
    + """, tt as (select unnest([50.0, 100.0, 200.0, 300.0])::double as w0),
 ct as (select stop as t, count(*) filter (event = 0) as c, count(*) filter (event != 0) as d from z group by 1),
 gg as (select t, product(1 - c / ((select count(*) from z where z.stop >= ct.t) - d)) over (order by t) as g from ct where c > 0),
 cl as (select z.*, w0, exp(-risk * w0 / 365) as surv, event != 0 and stop <= w0 as kase, stop >= w0 and not (event != 0 and stop <= w0) as ctrl from z, tt),
 ex as (select w0, bool_and(kase or ctrl) as exact from cl group by 1),
 ww as (select cl.*, case when exact then 1.0::double when kase or ctrl then 1 / greatest(0.05, coalesce((select arg_max(g, t) from gg where gg.t < (case when kase then cl.stop else cl.w0 end)), 1)) else 0 end as w
   from cl join ex using (w0)),
 bs as (select w0, avg(w * pow(cast(kase as double) - (1 - surv), 2)) as b from ww group by 1),
 st as (select (w0 - lag(w0) over (order by w0)) * (b + lag(b) over (order by w0)) / 2 as s from bs)
select round(sum(s) / 250, 9) as ibs from st""",
)
def integrated_brier(spark, sf_dir):
    curve = F.array(*(F.exp(-F.col("risk") * t / 365) for t in IBS_TIMES))
    return rounded(mt.integrated_brier(_s365(spark, sf_dir).withColumn("curve", curve), "curve", IBS_TIMES))


AUC = """ select round(sum(i.w * j.w * (case when i.risk > j.risk then 1 when i.risk = j.risk then 0.5 else 0 end)) / sum(i.w * j.w), 9) as auc
 from ww i join ww j on i.kase and (j.ctrl or j.comp)"""


@query("auc_cumulative", ANY + AUC)
def auc_cumulative(spark, sf_dir):
    return rounded(mt.auc_cumulative(_s365(spark, sf_dir), 200.0))


@query("auc_cumulative_cr", ONE + AUC)
def auc_cumulative_cr(spark, sf_dir):
    return rounded(mt.auc_cumulative(_s365(spark, sf_dir), 200.0, cause=1))


INC_A = "select i.w * i.w as w, i.risk as r, j.risk as r2 from ww i join ww j on i.stop <= j.stop and not (j.event != 0 and j.stop = i.stop) where i.kase and 0 < i.stop"
INC_B = "select i.w * j.w, i.risk, j.risk from ww i join ww j on j.event != 0 and j.event != 1 and j.stop <= i.stop where i.kase"


@query("cindex_incident", ANY + f", p as ({INC_A}) select {AGREE} from p")
def cindex_incident(spark, sf_dir):
    return rounded(mt.cindex_incident(_s365(spark, sf_dir), 200.0)).withColumn("pairs", F.round("pairs", 6))


@query("cindex_incident_cr", ONE + f", p as ({INC_A} union all {INC_B}) select {AGREE} from p")
def cindex_incident_cr(spark, sf_dir):
    return rounded(mt.cindex_incident(_s365(spark, sf_dir), 200.0, cause=1)).withColumn("pairs", F.round("pairs", 6))


@query(
    "calibration_table",
    S365
    + """, q as (select list_sort(list_distinct(quantile_cont(risk, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as e from z),
 b as (select z.*, greatest(0, least(len(list_filter(e, lambda v: v <= risk)) - 1, len(e) - 2)) as bin from z, q),
 tt as (select distinct bin, stop as t from b where event != 0 and stop <= 200),
 ss as (select bin, product(1 - (select count(*) from b where b.bin = tt.bin and b.stop = tt.t and event != 0) / (select count(*) from b where b.bin = tt.bin and b.stop >= tt.t)) as s from tt group by bin)
select cast(bin as bigint) as bin, count(*) as n, count(*) filter (event != 0 and stop <= 200) as n_events, round(avg(risk), 9) as mean_risk, round(1 - coalesce(any_value(s), 1), 9) as observed_risk
from b left join ss using (bin) group by bin""",
)
def calibration_table(spark, sf_dir):
    from hazardframe.frame import CountingProcess

    return rounded(est.calibration(CountingProcess(_s365(spark, sf_dir)), "risk", 200.0, 10))


#: DuckDB: rows opened into windows and causes with a rate that follows the price.
PE = (
    POOLED
    + """, win as (select * from (values (0, 0.0::double, 300.0::double), (1, 300, 700), (2, 700, 1200), (3, 1200, 2000)) v(m, lo, hi)),
 na as (select t, sum(d1 / y) over (order by t) as h1, sum(d2 / y) over (order by t) as h2 from risk where d > 0),
 nul as (select m, lo, hi, j, (case when j = 1 then coalesce((select max(h1) from na where t <= hi), 0) - coalesce((select max(h1) from na where t <= lo), 0)
   else coalesce((select max(h2) from na where t <= hi), 0) - coalesce((select max(h2) from na where t <= lo), 0) end) as d0 from win, (values (1), (2)) c(j)),
 cell as (select cp.id, m as "window", j as cause, greatest(0, least(stop, hi) - greatest(start, lo)) as e, stop > lo and stop <= hi and event = j as hit,
   (0.99 * (price * j / 3e8 * hi - price * j / 3e8 * lo) + 0.01 * d0) / (hi - lo) as rate, price * j <= 0 as zero, d0 / (hi - lo) as rate0 from cp join nul on (least(stop, hi) > greatest(start, lo) or (stop > lo and stop <= hi and event = j)))"""
)
PE_SUMS = """round(sum((case when hit then ln(rate) else 0 end) - rate * e), 6) as score, round(sum((case when hit then ln(rate0) else 0 end) - rate0 * e), 6) as null_score,
 cast(sum(hit::int) as bigint) as n_events, cast(sum((hit and zero)::int) as bigint) as n_zero_rate, round(sum(e), 6) as exposure"""


def _pe(spark, sf_dir, by):
    cp = orders_cp(spark, sf_dir)
    na = est.nelson_aalen_by_cause(cp, CAUSES)
    asked = spark.createDataFrame([(w,) for w in WINDOWS], "t double")
    null = [[r[h] for r in est.step_lookup(asked, na, h, 0.0).orderBy("t").collect()] for h in ("h1", "h2")]
    curves = {f"H{j}": F.array(*(F.col("price") * j / 3e8 * w for w in WINDOWS)) for j in CAUSES}
    return rounded(mt.piecewise_exponential(cp.df.withColumns(curves), WINDOWS, ["H1", "H2"], null, CAUSES, by=by), 6)


@query("pe_score", PE + f" select {PE_SUMS} from cell")
def pe_score(spark, sf_dir):
    return _pe(spark, sf_dir, "total")


@query("pe_score_by_window", PE + f' select "window", {PE_SUMS} from cell group by 1')
def pe_score_by_window(spark, sf_dir):
    return _pe(spark, sf_dir, "window")


@query("pe_score_by_cause", PE + f" select cause, {PE_SUMS} from cell group by 1")
def pe_score_by_cause(spark, sf_dir):
    return _pe(spark, sf_dir, "cause")


@query("pe_score_by_id", PE + f" select id, {PE_SUMS} from cell group by 1")
def pe_score_by_id(spark, sf_dir):
    return _pe(spark, sf_dir, "id")
