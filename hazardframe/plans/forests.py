"""Queries over a fixed forest, hashed bags, folds and permutations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.forest import frames as fr
from hazardframe.functions import hash31_sql, rounded
from hazardframe.operators import effects, resample
from hazardframe.operators import estimators as est
from hazardframe.operators import landmark as lm
from hazardframe.plans.cohort import CP_SQL, orders_cp
from hazardframe.plans.registry import query
from hazardframe.plans.scoring import HORIZON, LANDMARKS, LAST

NODES = [
    (0, 0, "price", 100000.0, "right", 1, 2, None),
    (0, 1, None, None, None, None, None, 0),
    (0, 2, "acctbal", 4000.0, "left", 3, 4, None),
    (0, 3, None, None, None, None, None, 1),
    (0, 4, None, None, None, None, None, 2),
    (1, 0, "price", None, "alone", 1, 2, None),
    (1, 1, None, None, None, None, None, 0),
    (1, 2, "acctbal", 2000.0, "right", 3, 4, None),
    (1, 3, None, None, None, None, None, 1),
    (1, 4, None, None, None, None, None, 2),
]
LEAVES = [(tree, leaf, 200.0 * k, cause, round(0.01 * (1 + tree + 2 * leaf + k) / cause, 6)) for tree in (0, 1) for leaf in (0, 1, 2) for k in (1, 2, 3, 4) for cause in (1, 2) if (k + leaf + cause) % 3]
TIMES = [100.0, 400.0, 700.0, 900.0]

#: DuckDB: rows whose price is missing above 250000, their leaves in both trees, and the leaves' jumps.
FOREST = (
    CP_SQL
    + ", x as (select id, start, stop, event, case when price > 250000 then null else price end as price, acctbal from cp)"
    + """, routed as (select id, start, stop, 0 as tree, case when price <= 100000 then 0 when acctbal <= 4000 then 1 else 2 end as leaf from x
 union all select id, start, stop, 1, case when price is null then 0 when acctbal <= 2000 then 1 else 2 end from x),
 leaves as (select * from (values """
    + ", ".join(f"({a}, {b}, {t}::double, {c}, {j}::double)" for a, b, t, c, j in LEAVES)
    + ") v(tree, leaf, t, cause, jump)), tm as (select unnest([100.0, 400.0, 700.0, 900.0])::double as t)"
)


def _forest(spark):
    return spark.createDataFrame(NODES, fr.NODES), spark.createDataFrame(LEAVES, fr.LEAVES)


def _rows(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    return cp.with_df(cp.df.withColumn("price", F.when(F.col("price") <= 250000, F.col("price"))))


def _routed(spark, sf_dir, keep=("id", "start")):
    nodes, leaves = _forest(spark)
    return fr.route(_rows(spark, sf_dir).df, nodes, list(keep)), leaves


@query("route_fixed_forest", FOREST + " select id, start, tree, leaf from routed")
def route_fixed_forest(spark, sf_dir):
    return _routed(spark, sf_dir)[0]


@query(
    "cumhaz_fixed_forest",
    FOREST + ", s as (select id, start, tm.t, sum(case when l.t <= tm.t then jump else 0 end) / 2 as h from routed join leaves l using (tree, leaf) cross join tm group by 1, 2, 3) select id, start, t, round(h, 9) as cumhaz from s",
)
def cumhaz_fixed_forest(spark, sf_dir):
    routed, leaves = _routed(spark, sf_dir)
    return rounded(fr.cumulative_hazard(routed, leaves, TIMES, 2, ["id", "start"]))


@query(
    "cause_cumhaz_fixed_forest",
    FOREST
    + ", c as (select unnest([1, 2]) as cause), s as (select id, start, c.cause, tm.t, sum(case when l.t <= tm.t and l.cause = c.cause then jump else 0 end) / 2 as h from routed join leaves l using (tree, leaf) cross join tm cross join c group by 1, 2, 3, 4) select id, start, cause, t, round(h, 9) as cumhaz from s",
)
def cause_cumhaz_fixed_forest(spark, sf_dir):
    routed, leaves = _routed(spark, sf_dir)
    return rounded(fr.cumulative_hazard(routed, leaves, TIMES, 2, ["id", "start"], by_cause=True))


@query(
    "survival_fixed_forest",
    FOREST
    + ", s as (select id, start, tree, tm.t, sum(case when l.t <= tm.t then jump else 0 end) as h from routed join leaves l using (tree, leaf) cross join tm group by 1, 2, 3, 4) select id, start, t, round(-ln(avg(exp(-h))), 9) as cumhaz from s group by 1, 2, 3",
)
def survival_fixed_forest(spark, sf_dir):
    routed, leaves = _routed(spark, sf_dir)
    return rounded(fr.mean_survival(routed, leaves, TIMES, 2, ["id", "start"]))


@query(
    "mortality_fixed_forest",
    FOREST + ", s as (select id, start, tm.t, sum(case when l.t <= tm.t then jump else 0 end) / 2 as h from routed join leaves l using (tree, leaf) cross join tm group by 1, 2, 3) select id, start, round(sum(h), 9) as mortality from s group by 1, 2",
)
def mortality_fixed_forest(spark, sf_dir):
    routed, leaves = _routed(spark, sf_dir)
    return rounded(fr.mortality(routed, leaves, TIMES, 2, ["id", "start"]))


#: DuckDB: product limits over increments lim(key, t, l1, l2), read off at the asked times.
LIMITS = """ s0 as (select *, product(greatest(0, 1 - l1 - l2)) over (partition by {key} order by t) as surv from lim),
 s1 as (select *, lag(surv, 1, 1.0) over (partition by {key} order by t) as b from s0),
 s2 as (select *, sum(b * l1) over (partition by {key} order by t) as f1, sum(b * l2) over (partition by {key} order by t) as f2 from s1),
 s3 as (select {key}, tm.t as t, coalesce(arg_max(surv, s2.t) filter (s2.t <= tm.t), 1) as surv, coalesce(arg_max(f1, s2.t) filter (s2.t <= tm.t), 0) as f1,
   coalesce(arg_max(f2, s2.t) filter (s2.t <= tm.t), 0) as f2 from s2 cross join tm group by {key}, tm.t)"""
SUMS = "coalesce(sum(jump) filter (cause = 1), 0) as l1, coalesce(sum(jump) filter (cause = 2), 0) as l2"
MEANS = "round(avg(surv), 9) as surv, round(avg(f1), 9) as f1, round(avg(f2), 9) as f2"


@query("cif_fixed_forest", FOREST + f", lim as (select id, start, tree, t, {SUMS} from routed join leaves using (tree, leaf) group by 1, 2, 3, 4)," + LIMITS.format(key="id, start, tree") + f" select id, start, t, {MEANS} from s3 group by 1, 2, 3")
def cif_fixed_forest(spark, sf_dir):
    routed, leaves = _routed(spark, sf_dir)
    return rounded(fr.cumulative_incidence(routed, leaves, TIMES, 2, ["id", "start"], 2))


@query(
    "cif_hazard_fixed_forest",
    FOREST + f", lim0 as (select id, start, t, {SUMS} from routed join leaves using (tree, leaf) group by 1, 2, 3), lim as (select id, start, t, l1 / 2 as l1, l2 / 2 as l2 from lim0)," + LIMITS.format(key="id, start") + " select id, start, t, round(surv, 9) as surv, round(f1, 9) as f1, round(f2, 9) as f2 from s3",
)
def cif_hazard_fixed_forest(spark, sf_dir):
    routed, leaves = _routed(spark, sf_dir)
    return rounded(fr.cumulative_incidence(routed, leaves, TIMES, 2, ["id", "start"], 2, "hazard"))


#: DuckDB: paths on their own clock from entry, origin 50 days later, and the jumps they meet.
PATHS = (
    FOREST
    + """, e as (select id, min(start) as t0, max(stop) as tz from x group by 1),
 pr as (select routed.id, tree, leaf, start - t0 as start, stop - t0 as stop, 50.0 as origin, tz - t0 as tend from routed join e using (id) where tz - t0 >= 50),
 pj as (select pr.id, pr.tree, l.t, l.cause, l.jump from pr join leaves l on l.tree = pr.tree and l.leaf = pr.leaf and l.t > greatest(pr.start, origin) and l.t <= pr.stop)"""
)


def _paths(spark, sf_dir):
    from pyspark.sql.window import Window

    cp = _rows(spark, sf_dir)
    w = Window.partitionBy("id")
    rows = cp.df.withColumns({"_t0": F.min("start").over(w), "_tz": F.max("stop").over(w)}).where("_tz - _t0 >= 50")
    rows = rows.withColumns({"start": F.col("start") - F.col("_t0"), "stop": F.col("stop") - F.col("_t0")}).drop("_t0", "_tz")
    nodes, leaves = _forest(spark)
    return fr.route(rows, nodes, ["id", "start", "stop"]), leaves, rows.select("id").distinct().withColumn("origin", F.lit(50.0))


@query(
    "path_hazard_fixed_forest",
    PATHS + ", kk as (select distinct id, tend from pr) select kk.id, tm.t, case when tm.t >= 50 and tm.t <= tend then round(coalesce((select sum(jump) from pj where pj.id = kk.id and pj.t <= tm.t), 0) / 2, 9) end as cumhaz from kk cross join tm",
)
def path_hazard_fixed_forest(spark, sf_dir):
    routed, leaves, origins = _paths(spark, sf_dir)
    return rounded(fr.path_cumulative_hazard(routed, leaves, origins, TIMES, 2))


@query(
    "path_cif_fixed_forest",
    PATHS
    + f", lim as (select id, tree, t, {SUMS} from pj group by 1, 2, 3),"
    + LIMITS.format(key="id, tree")
    + """, kk as (select distinct id, tend, tree from pr), z as (select kk.id, kk.tree, tm.t, tend, coalesce(surv, 1) as surv, coalesce(f1, 0) as f1, coalesce(f2, 0) as f2 from kk cross join tm left join s3 on s3.id = kk.id and s3.tree = kk.tree and s3.t = tm.t)
select id, t, case when t >= 50 and t <= tend then round(sum(surv) / 2, 9) end as surv, case when t >= 50 and t <= tend then round(sum(f1) / 2, 9) end as f1, case when t >= 50 and t <= tend then round(sum(f2) / 2, 9) end as f2 from z group by id, t, tend""",
)
def path_cif_fixed_forest(spark, sf_dir):
    routed, leaves, origins = _paths(spark, sf_dir)
    return rounded(fr.path_cumulative_incidence(routed, leaves, origins, TIMES, 2, 2))


N_TREES, SEED = 5, 11
BAGS = (
    CP_SQL
    + f", un as (select distinct id from cp), tr as (select unnest(range(0, {N_TREES}))::int as tree), hh as (select tree, id, {hash31_sql(str(SEED), 'tree', 'id')} as hx from un, tr),"
    + " bags as (select tree, id from hh qualify row_number() over (partition by tree order by hx, id) <= (select count(*) * 632 // 1000 from un))"
)


def _bags(spark, sf_dir):
    units = orders_cp(spark, sf_dir).df.select("id").distinct()
    return fr.draw_bags(units, "id", N_TREES, units.count() * 632 // 1000, SEED)


@query("bag_membership", BAGS + " select tree, id, 1 as copies from bags")
def bag_membership(spark, sf_dir):
    return _bags(spark, sf_dir)


@query("oob_trees", BAGS + " select un.id, tr.tree from un cross join tr where not exists (select 1 from bags where bags.id = un.id and bags.tree = tr.tree)")
def oob_trees(spark, sf_dir):
    required = orders_cp(spark, sf_dir).df.select("id").distinct()
    return fr.out_of_bag(required, _bags(spark, sf_dir), N_TREES, ["id"], ["id"])


@query(
    "rolling_origin_folds",
    LAST
    + """, mx as (select max(landmark) as e from y), win as (select k::int as fold, e - (3 - k) * 365 as lo, e - (2 - k) * 365 as hi from mx, (select unnest(range(0, 3)) as k)),
 fs as (select fold, lo, hi, min(landmark) as f from win join y on landmark > lo and landmark <= hi group by 1, 2, 3)
select id, landmark, fold, case when landmark > lo and landmark <= hi then 'test' else 'train' end as role from y join fs on (landmark > lo and landmark <= hi) or landmark <= f - 365""",
)
def rolling_origin_folds(spark, sf_dir):
    rows = lm.landmark_stack(orders_cp(spark, sf_dir), HORIZON, ["price"], LANDMARKS).select("id", "landmark")
    return resample.rolling_origin(rows, "landmark", 3, 365.0, 365.0)


GROUPS = ", gf as (select id, cast((row_number() over (order by {h}, id) - 1) % 3 as int) as g from (select distinct id from {t}))"


@query("group_kfold", CP_SQL + GROUPS.format(h=hash31_sql("5", "id"), t="cp") + " select id, g as fold from gf")
def group_kfold(spark, sf_dir):
    return resample.group_folds(orders_cp(spark, sf_dir).df, "id", 3, 5)


@query(
    "group_time_folds",
    LAST
    + GROUPS.format(h=hash31_sql("5", "id"), t="y")
    + """, mx as (select max(landmark) as e from y), win as (select k::int as fold, e - (3 - k) * 365 as lo, e - (2 - k) * 365 as hi from mx, (select unnest(range(0, 3)) as k)),
 fs as (select fold, lo, hi, min(landmark) as f from win join y on landmark > lo and landmark <= hi group by 1, 2, 3),
 z as (select id, landmark, g, fold, landmark > lo and landmark <= hi as test from y join gf using (id) join fs on (landmark > lo and landmark <= hi) or landmark <= f - 365)
select id, landmark, cast(fold * 3 + k as int) as fold, case when test then 'test' else 'train' end as role from z, (select unnest(range(0, 3))::int as k) where test = (g = k)""",
)
def group_time_folds(spark, sf_dir):
    rows = lm.landmark_stack(orders_cp(spark, sf_dir), HORIZON, ["price"], LANDMARKS).select("id", "landmark")
    return resample.group_time_folds(rows, "landmark", "id", 3, 365.0, 365.0, 5)


@query(
    "permute_within_strata",
    CP_SQL
    + f""", b as (select id, min(segment) as segment from cp group by 1), rp as (select unnest(range(0, 2))::int as repeat), bb as (select repeat, id, segment, {hash31_sql('3', 'repeat', 'id')} as hx from b, rp),
 n as (select *, row_number() over (partition by repeat, segment order by id) as a, row_number() over (partition by repeat, segment order by hx, id) as z from bb)
select n.repeat, n.id, m.id as donor from n join n m on m.repeat = n.repeat and m.segment = n.segment and m.z = n.a""",
)
def permute_within_strata(spark, sf_dir):
    rows = orders_cp(spark, sf_dir).df.groupBy("id").agg(F.min("segment").alias("segment"))
    return resample.donors(rows, "id", ["segment"], 3, 2)


@query(
    "bootstrap_ids",
    CP_SQL
    + f""", n as (select id, row_number() over (order by id) - 1 as k, count(*) over () as total from (select distinct id from cp)), rp as (select unnest(range(0, 3))::int as rep),
 d as (select rep, k as draw, ({hash31_sql('9', 'rep', 'k')}) % total as pick from n, rp) select rep, draw, n.id from d join n on n.k = d.pick""",
)
def bootstrap_ids(spark, sf_dir):
    return resample.bootstrap_ids(orders_cp(spark, sf_dir).df, "id", 9, 3)


WINDOWS = [0.0, 300.0, 700.0, 1200.0]


@query(
    "hazard_effect_fixed_forest",
    FOREST
    + """, vv as (select unnest([1000.0, 5000.0])::double as value), win as (select * from (values (0, 0.0::double, 300.0::double), (1, 300, 700), (2, 700, 1200)) v(m, lo, hi)),
 rv as (select id, start, stop, value, 0 as tree, case when price <= 100000 then 0 when value <= 4000 then 1 else 2 end as leaf from x, vv
   union all select id, start, stop, value, 1, case when price is null then 0 when value <= 2000 then 1 else 2 end from x, vv),
 rt as (select rv.id, rv.start, rv.value, win.m, any_value(least(rv.stop, hi) - greatest(rv.start, lo)) as e, sum(case when l.t > lo and l.t <= hi then jump else 0 end) / 2 / any_value(hi - lo) as rate
   from rv join leaves l using (tree, leaf) cross join win where least(rv.stop, hi) > greatest(rv.start, lo) group by 1, 2, 3, 4),
 q as (select m, quantile_cont(acctbal, 0.05) as a, quantile_cont(acctbal, 0.95) as z from x join win on least(stop, hi) > greatest(start, lo) group by 1)
select value, m, round(sum(e * rate) / sum(e), 9) as hazard, any_value(value >= a and value <= z) as supported from rt join q using (m) group by 1, 2""",
)
def hazard_effect_fixed_forest(spark, sf_dir):
    nodes, leaves = _forest(spark)
    predict = lambda rows, key: fr.cumulative_hazard(fr.route(rows, nodes, key), leaves, WINDOWS, 2, key)
    return rounded(effects.hazard_effect(_rows(spark, sf_dir), "acctbal", [1000.0, 5000.0], WINDOWS, predict))


@query(
    "path_effect_fixed_forest",
    FOREST
    + """, e as (select id, min(start) as t0, max(stop) as tz from x group by 1),
 p as (select x.id, start - t0 as start, stop - t0 as stop, price, acctbal from x join e using (id) where tz - t0 >= 400),
 sh as (select id, start, stop, price, case when start >= 150 then acctbal + 3000 else acctbal end as acctbal from p where not (start < 150 and 150 < stop)
   union all select id, start, 150, price, acctbal from p where start < 150 and 150 < stop union all select id, 150, stop, price, acctbal + 3000 from p where start < 150 and 150 < stop),
 both_ as (select 'base' as kind, * from p union all select 'shifted', * from sh),
 rb as (select kind, id, start, stop, 0 as tree, case when price <= 100000 then 0 when acctbal <= 4000 then 1 else 2 end as leaf from both_
   union all select kind, id, start, stop, 1, case when price is null then 0 when acctbal <= 2000 then 1 else 2 end from both_),
 ho as (select unnest([250.0, 400.0])::double as t),
 hz as (select kind, rb.id, ho.t, sum(case when l.t > rb.start and l.t <= rb.stop and l.t <= ho.t then jump else 0 end) / 2 as h from rb join leaves l using (tree, leaf) cross join ho group by 1, 2, 3),
 rk as (select id, t, max(case when kind = 'base' then 1 - exp(-h) end) as base, max(case when kind = 'shifted' then 1 - exp(-h) end) as shifted from hz group by 1, 2)
select id, t, round(base, 9) as base, round(shifted, 9) as shifted, round(shifted - base, 9) as effect from rk""",
)
def path_effect_fixed_forest(spark, sf_dir):
    from pyspark.sql.window import Window

    nodes, leaves = _forest(spark)
    w = Window.partitionBy("id")
    rows = _rows(spark, sf_dir).df.withColumns({"_t0": F.min("start").over(w), "_tz": F.max("stop").over(w)}).where("_tz - _t0 >= 400")
    rows = rows.select("id", (F.col("start") - F.col("_t0")).alias("start"), (F.col("stop") - F.col("_t0")).alias("stop"), "price", "acctbal")

    def predict(paths):
        routed = fr.route(paths, nodes, ["id", "start", "stop"])
        origins = paths.groupBy("id").agg(F.min("start").alias("origin"))
        return fr.path_cumulative_hazard(routed, leaves, origins, [250.0, 400.0], 2).withColumn("risk", 1 - F.exp(-F.col("cumhaz")))

    return rounded(effects.path_effect(rows, "acctbal", 3000.0, 150.0, [250.0, 400.0], predict))


@query("depth0_forest", CP_SQL + """, ev as (select stop as t, count(*) as d from cp where event != 0 group by 1), rr as (select ev.t, ev.d, count(*) as y from ev join cp on cp.start < ev.t and ev.t <= cp.stop group by 1, 2)
select t, round(sum(d / y) over (order by t), 9) as cumhaz from rr""")
def depth0_forest(spark, sf_dir):
    """A tree without splits over all units: its one leaf is the pooled estimate."""
    from hazardframe.forest.estimator import SurvivalForestTV

    cp = orders_cp(spark, sf_dir)
    forest = SurvivalForestTV(n_estimators=1, max_depth=0, max_samples=1.0, min_ids_leaf=1, min_events_leaf=1)
    fitted = forest.fit(cp.with_df(cp.df, features=("price", "acctbal")))
    w = est.running([], "t")
    return rounded(fitted.leaves.groupBy("t").agg(F.sum("jump").alias("jump")).select("t", F.sum("jump").over(w).alias("cumhaz")))


def _stump_sql(causes: list[int]) -> str:
    """The best split of all rows on two coarse features, and the hazards of its two sides: up to ``best`` and ``jumps``.

    ``causes`` are scored one by one and added up; without any, events of all causes are one.
    """
    hits = [f"event = {c}" for c in causes] or ["event != 0"]
    counts = ", ".join(f"count(*) filter (s.stop = ev.t and {h}) as d{j}, count(*) filter (l and s.stop = ev.t and {h}) as e{j}" for j, h in enumerate(hits))
    sums = ", ".join(
        f"sum(case when y >= 2 and d{j} > 0 then e{j} - d{j} * yl / y end) as u{j}, sum(case when y >= 2 and d{j} > 0 then d{j} * (yl / y) * (1 - yl / y) * (y - d{j}) / (y - 1) end) as v{j}" for j in range(len(hits))
    )
    total = " + ".join(f"case when v{j} > 1e-12 then u{j} * u{j} / v{j} else 0 end" for j in range(len(hits)))
    split = ", ".join(f"count(*) filter (x.stop = ev.t and {h}) as d{j}" for j, h in enumerate(hits))
    return (
        CP_SQL
        + f""", x as (select id, start, stop, event, cast(floor(price / 50000) as double) as pband, cast(floor(acctbal / 2500) as double) as aband from cp),
 dv as (select 0 as feature_no, pband as v from x group by 1, 2 union all select 1, aband from x group by 1, 2),
 e as (select feature_no, v + (lead(v) over (partition by feature_no order by v) - v) / 2 as threshold from dv qualify threshold is not null),
 s as (select x.*, feature_no, threshold, case when feature_no = 0 then pband else aband end <= threshold as l from x cross join e),
 units as (select feature_no, threshold, least(count(distinct case when l then id end), count(distinct case when not l then id end)) as n_ids,
   least(count(*) filter (l and event != 0), count(*) filter (not l and event != 0)) as n_events from s group by 1, 2),
 ev as (select distinct stop as t from x where event != 0),
 rr as (select feature_no, threshold, ev.t, count(*) as y, count(*) filter (l) as yl, {counts} from s join ev on s.start < ev.t and ev.t <= s.stop group by 1, 2, 3),
 sc as (select feature_no, threshold, {sums} from rr group by 1, 2),
 best as (select feature_no, threshold from sc join units using (feature_no, threshold) where n_ids >= 15 and n_events >= 3 order by {total} desc, feature_no, threshold limit 1),
 routed as (select x.id, x.start, x.stop, x.event, case when feature_no = 0 then pband else aband end <= threshold as side from x cross join best),
 jumps as (select side, ev.t, count(*) as y, {split} from routed x join ev on x.start < ev.t and ev.t <= x.stop group by 1, 2)"""
    )


STUMP_TIMES = [200.0, 600.0, 1200.0, 2500.0]
_ASKED = f" asked as (select id, start, side, tt.t from routed cross join (select unnest({STUMP_TIMES}::double[]) as t) tt)"


def _stump(spark, sf_dir, kind: str):
    from hazardframe.forest import CompetingRisksForestTV, SurvivalForestTV

    cp = orders_cp(spark, sf_dir)
    bands = cp.df.withColumns({"pband": F.floor(F.col("price") / 50000).cast("double"), "aband": F.floor(F.col("acctbal") / 2500).cast("double")})
    cp = cp.with_df(bands, features=("pband", "aband"))
    made = (CompetingRisksForestTV if kind == "competing" else SurvivalForestTV)(n_estimators=1, max_depth=1, max_samples=1.0, min_ids_leaf=15, min_events_leaf=3, max_features=None)
    return made.fit(cp), cp.df


@query("stump_nodes", _stump_sql([]) + " select case feature_no when 0 then 'pband' else 'aband' end as feature, threshold from best")
def stump_nodes(spark, sf_dir):
    """A grown tree of one split: where it splits."""
    return _stump(spark, sf_dir, "survival")[0].nodes.where("feature is not null").select("feature", "threshold")


@query("stump_cumhaz", _stump_sql([]) + "," + _ASKED + """
select asked.id, asked.start, asked.t, round(coalesce(sum(d0 / y), 0), 9) as cumhaz from asked left join jumps on jumps.side = asked.side and jumps.t <= asked.t group by 1, 2, 3""")
def stump_cumhaz(spark, sf_dir):
    """Hazards that a grown tree predicts for every row."""
    forest, rows = _stump(spark, sf_dir, "survival")
    return rounded(forest.predict_cumulative_hazard(rows, ["id", "start"], STUMP_TIMES), 9)


@query("stump_risk", _stump_sql([]) + """ select r.id, r.start, round(1 - exp(-coalesce(sum(d0 / y), 0)), 9) as risk
from routed r left join jumps on jumps.side = r.side and jumps.t <= 600 group by 1, 2""")
def stump_risk(spark, sf_dir):
    """Risks by a horizon that a grown tree predicts for every row."""
    forest, rows = _stump(spark, sf_dir, "survival")
    return rounded(forest.predict_risk(rows, ["id", "start"], 600.0), 9)


@query("stump_cif", _stump_sql([1, 2]) + "," + _ASKED + """,
 aj as (select side, t, d0 / y as h1, d1 / y as h2, coalesce(product(1 - (d0 + d1) / y) over (partition by side order by t rows between unbounded preceding and 1 preceding), 1) as before from jumps),
 inc as (select side, t, cast(1 as bigint) as cause, before * h1 as f from aj union all select side, t, cast(2 as bigint), before * h2 from aj)
select asked.id, asked.start, asked.t, c.cause, round(coalesce(sum(f), 0), 9) as cif from asked cross join (select unnest([1, 2])::bigint as cause) c
  left join inc on inc.side = asked.side and inc.t <= asked.t and inc.cause = c.cause group by 1, 2, 3, 4""")
def stump_cif(spark, sf_dir):
    """Incidences that a grown competing-risks tree, split on the sum of both causes' statistics, predicts for every row."""
    forest, rows = _stump(spark, sf_dir, "competing")
    return rounded(forest.predict_cumulative_incidence(rows, ["id", "start"], STUMP_TIMES), 9)
