"""Queries over sources, validation, reshaping and estimators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe import frame
from hazardframe.functions import rounded
from hazardframe.operators import estimators as est
from hazardframe.operators import logrank, reshape
from hazardframe.plans.cohort import CAUSES, CP_SQL, orders_cp, read
from hazardframe.plans.registry import query
from hazardframe.sources import adapters

#: DuckDB: risk-set counts by time; {by} is a list of grouping columns that ends with a comma, {rows} the table.
SWEEP = """pts as (select {by} start as t, 1 as inn, 0 as out, 0 as d, 0 as c, 0 as d1, 0 as d2 from {rows}
   union all select {by} stop, 0, 1, cast(event != 0 as int), cast(event = 0 as int), cast(event = 1 as int), cast(event = 2 as int) from {rows}),
 agg as (select {by} t, sum(inn) as inn, sum(out) as out, sum(d) as d, sum(c) as c, sum(d1) as d1, sum(d2) as d2 from pts group by {by} t),
 risk as (select {by} t, coalesce(sum(inn - out) over ({part} order by t rows between unbounded preceding and 1 preceding), 0) as y, d, c, d1, d2 from agg)"""
POOLED = CP_SQL + ", " + SWEEP.format(by="", part="", rows="cp")
BY_SEGMENT = CP_SQL + ", " + SWEEP.format(by="segment,", part="partition by segment", rows="cp")


@query("cp_build", CP_SQL + " select id, start, stop, event, price, acctbal, segment from cp")
def cp_build(spark, sf_dir):
    return orders_cp(spark, sf_dir).df.select("id", "start", "stop", "event", "price", "acctbal", "segment")


@query(
    "cp_validate_summary",
    CP_SQL
    + """, w as (select *, lag(stop) over (partition by id order by start) as before, lead(start) over (partition by id order by start) as after from cp)
select count(*) as n_rows, count(distinct id) as n_ids, cast(0 as bigint) as n_null_id, cast(0 as bigint) as n_not_finite,
  cast(sum(cast(start >= stop as int)) as bigint) as n_empty, cast(0 as bigint) as n_bad_label, cast(sum(cast(event != 0 as int)) as bigint) as n_events,
  cast(sum(cast(coalesce(start < before, false) as int)) as bigint) as n_overlap, cast(sum(cast(coalesce(start > before, false) as int)) as bigint) as n_gap,
  cast(sum(cast(after is not null and event != 0 as int)) as bigint) as n_early_event, cast(0 as bigint) as n_look_ahead from w""",
)
def cp_validate_summary(spark, sf_dir):
    return frame.validation_summary(orders_cp(spark, sf_dir))


#: Rows that begin after a long pause lose their first half, which leaves gaps.
GAPPED = ", g as (select id, case when stop - start > 200 then start + floor((stop - start) / 2) else start end as start, stop, event from cp)"


def _gapped(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    length = F.col("stop") - F.col("start")
    moved = F.when(length > 200, F.col("start") + F.floor(length / 2)).otherwise(F.col("start"))
    return cp.with_df(cp.df.withColumn("start", moved.cast("double")))


@query(
    "cp_split_id_segments",
    CP_SQL + GAPPED + """, h as (select *, case when start > lag(stop) over (partition by id order by start) then 1 else 0 end as gap from g)
select id, start, stop, event, cast(sum(gap) over (partition by id order by start) as bigint) as segment from h""",
)
def cp_split_id_segments(spark, sf_dir):
    cp = _gapped(spark, sf_dir)
    return frame.split_segments(cp.with_df(cp.df.drop("segment"), features=())).select("id", "start", "stop", "event", "segment")


@query("cp_lookahead_violations", CP_SQL + ", m as (select *, start + floor(price / 1000) - 100 as measured from cp) select id, start, measured from m where measured > start")
def cp_lookahead(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    rows = cp.df.withColumn("measured", (F.col("start") + F.floor(F.col("price") / 1000) - 100).cast("double"))
    return frame.look_ahead(cp.with_df(rows, measured_at="measured")).select("id", "start", "measured")


@query("cause_vocabulary", CP_SQL + " select event as cause, row_number() over (order by event) as code, count(*) as n from cp where event != 0 group by event")
def cause_vocabulary(spark, sf_dir):
    return frame.cause_vocabulary(orders_cp(spark, sf_dir))


@query("encode_causes", CP_SQL + " select id, start, case event when 2 then 1 when 1 then 0 else 0 end as x, event as code from cp")
def encode_causes(spark, sf_dir):
    cp, _ = frame.encode_causes(orders_cp(spark, sf_dir))
    return cp.df.select("id", "start", (F.col("event") == 2).cast("int").alias("x"), F.col("event").alias("code"))


@query("unit_codes", CP_SQL + ", u as (select segment, min(id) as f from cp group by 1) select segment, row_number() over (order by f) - 1 as unit_code from u")
def unit_codes(spark, sf_dir):
    return frame.unit_codes(orders_cp(spark, sf_dir).df, "segment", "id").select("segment", "unit_code").distinct()


@query("make_survival_y", CP_SQL + " select start, stop, event != 0 as event from cp")
def make_survival_y(spark, sf_dir):
    rows = orders_cp(spark, sf_dir).df.withColumn("flag", (F.col("event") != 0).cast("int"))
    return frame.survival_target(rows, "stop", "flag", "start")


@query("event_times", CP_SQL + ", e as (select distinct stop as t from cp where event != 0) select row_number() over (order by t) - 1 as k, t from e")
def event_times(spark, sf_dir):
    return reshape.exact_grid(orders_cp(spark, sf_dir)).select(F.col("k").cast("long"), "t")


@query(
    "quantile_grid_20",
    CP_SQL
    + """, e as (select t, row_number() over (order by t) as r, count(*) over () as n from (select distinct stop as t from cp where event != 0)),
 j as (select unnest(range(1, 21)) as j), p as (select distinct t from e join j on e.r = (j.j * e.n + 19) // 20 or e.n <= 20)
select row_number() over (order by t) - 1 as k, t from p""",
)
def quantile_grid_20(spark, sf_dir):
    return reshape.quantile_grid(orders_cp(spark, sf_dir), 20).select(F.col("k").cast("long"), "t")


@query(
    "coarsen_ntime_20",
    CP_SQL
    + """, e as (select t, row_number() over (order by t) as r, count(*) over () as n from (select distinct stop as t from cp where event != 0)),
 j as (select unnest(range(1, 21)) as j), p0 as (select distinct t from e join j on e.r = (j.j * e.n + 19) // 20 or e.n <= 20),
 lo as (select min(start) as t from cp), p as (select t from p0 where t > (select t from lo) union select t from lo),
 mx as (select max(t) as t from p),
 s as (select id, start, stop, event, coalesce((select min(p.t) from p where p.t >= cp.start), (select t from mx)) as a,
   coalesce((select min(p.t) from p where p.t >= cp.stop), (select t from mx)) as z from cp),
 q as (select *, sum(cast(a < z as int)) over (partition by id order by start) as run from s),
 m as (select *, max(case when a >= z then event end) over (partition by id, run) as moved from q)
select id, a as start, z as stop, case when event != 0 then event else coalesce(moved, 0) end as event from m where a < z""",
)
def coarsen_ntime_20(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    grid = [r.t for r in reshape.quantile_grid(cp, 20).orderBy("t").collect()]
    return reshape.coarsen(cp, grid).select("id", "start", "stop", "event")


@query(
    "onehot_segment",
    CP_SQL
    + " select id, start, "
    + ", ".join(f"cast(segment = '{s}' as double) as \"segment={s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    + " from cp",
)
def onehot_segment(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    return reshape.CategoryEncoder().fit(cp.df, ["segment"]).transform(cp.df.select("id", "start", "segment"))


@query(
    "locf_price",
    CP_SQL + ", m as (select id, start, case when price > 200000 then null else price end as price from cp) select id, start, last_value(price ignore nulls) over (partition by id order by start) as price from m",
)
def locf_price(spark, sf_dir):
    rows = orders_cp(spark, sf_dir).df.select("id", "start", F.when(F.col("price") <= 200000, F.col("price")).alias("price"))
    return reshape.impute_locf(rows, "id", "start", ["price"])


BINS16 = """, v as (select price as x, count(*) as c from cp group by 1),
 b as (select x, row_number() over (order by price) - 1 as r, count(*) over () as n, max(price) over () as top from (select price, price as x from cp)),
 e as (select distinct x as edge from b, (select unnest(range(1, 16)) as q) where r = (q * n) // 16 and x < top)"""


@query("bins_price_16_edges", CP_SQL + BINS16 + " select 'price' as feature, row_number() over (order by edge) - 1 as j, edge from e")
def bins_price_16_edges(spark, sf_dir):
    edges = reshape.feature_edges(orders_cp(spark, sf_dir).df, ["price"], 16)
    return edges.select("feature", F.col("j").cast("long"), "edge")


@query("bins_price_16", CP_SQL + BINS16 + " select id, start, cast((select count(*) from e where e.edge < cp.price) as integer) as price_bin from cp")
def bins_price_16(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    edges = [r.edge for r in reshape.feature_edges(cp.df, ["price"], 16).orderBy("edge").collect()]
    return reshape.bin_columns(cp.df, {"price": edges}).select("id", "start", "price_bin")


BLOCKS = """, kb as (select *, cast(floor(start / 365) as bigint) + 1 as k1, cast(ceil(stop / 365) as bigint) - 1 as k2 from cp),
 b as (select *, unnest(range(k1 - 1, k2 + 1)) as block from kb),
 p as (select id, block, case when block = k1 - 1 then start else block * 365.0::double end as start,
   case when block = k2 then stop else (block + 1) * 365.0::double end as stop, case when block = k2 then event else 0 end as event, start as row_start from b)"""


@query("block_split_365", CP_SQL + BLOCKS + " select id, block, start, stop, event from p")
def block_split_365(spark, sf_dir):
    return reshape.split_blocks(orders_cp(spark, sf_dir), 365.0).select("id", "block", "start", "stop", "event")


@query("block_units", CP_SQL + BLOCKS + " select id, block, count(*) as n_rows from p group by 1, 2")
def block_units(spark, sf_dir):
    return reshape.block_units(reshape.split_blocks(orders_cp(spark, sf_dir), 365.0))


@query(
    "oob_sets_buffer1",
    CP_SQL
    + BLOCKS
    + """, u as (select distinct id, block from p), w as (select id, start as row_key, k1 - 1 as lo, k2 as hi from kb)
select w.id, w.row_key, u.block from w join u on u.id = w.id and u.block between w.lo - 1 and w.hi + 1""",
)
def oob_sets_buffer1(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    pieces = reshape.split_blocks(cp.with_df(cp.df.withColumn("row_key", F.col("start"))), 365.0)
    rows = pieces.groupBy("id", "row_key").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    return reshape.oob_sets(rows, reshape.block_units(pieces), 1)


@query(
    "split_at_time",
    CP_SQL
    + """ select id, start, stop, event, start >= 1000 as late from cp where not (start < 1000 and 1000 < stop)
union all select id, start, 1000, 0, false from cp where start < 1000 and 1000 < stop
union all select id, 1000, stop, event, true from cp where start < 1000 and 1000 < stop""",
)
def split_at_time(spark, sf_dir):
    return adapters.split_at_time(orders_cp(spark, sf_dir).df, F.lit(1000.0), "late").select("id", "start", "stop", "event", "late")


@query("censor_at_cutoff", CP_SQL + " select id, start, least(stop, 1200) as stop, case when stop <= 1200 then event else 0 end as event from cp where start < 1200")
def censor_at_cutoff(spark, sf_dir):
    return reshape.censor_at(orders_cp(spark, sf_dir), 1200.0).select("id", "start", "stop", "event")


WINDOWS = [0.0, 300.0, 700.0, 1200.0, 2000.0]
WINDOW_SQL = ", win as (select * from (values (0, 0.0::double, 300.0::double), (1, 300, 700), (2, 700, 1200), (3, 1200, 2000)) v(m, lo, hi))"


@query(
    "window_exposure",
    CP_SQL + WINDOW_SQL + " select id, start, m, least(stop, hi) - greatest(start, lo) as exposure from cp join win on lo < stop and hi > start",
)
def window_exposure(spark, sf_dir):
    return reshape.exposures(orders_cp(spark, sf_dir), WINDOWS).select("id", "start", "m", "exposure")


@query(
    "strata_codes",
    CP_SQL
    + """, q as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.5) as b, quantile_cont(price, 0.75) as c from cp)
select id, start, cast(cast(a < price as int) + cast(b < price as int) + cast(c < price as int) as bigint) as code from cp, q""",
)
def strata_codes(spark, sf_dir):
    return reshape.quantile_codes(orders_cp(spark, sf_dir).df, "price", 4).select("id", "start", "code")


@query(
    "user_strata_cross",
    CP_SQL + ", c as (select segment, event, row_number() over (order by segment, event) - 1 as stratum from (select distinct segment, event from cp)) select id, start, stratum from cp join c using (segment, event)",
)
def user_strata_cross(spark, sf_dir):
    return reshape.cross_codes(orders_cp(spark, sf_dir).df, ["segment", "event"]).select("id", "start", "stratum")


@query("at_risk_table", POOLED + " select t, cast(y as bigint) as y, cast(d as bigint) as d, cast(c as bigint) as c, cast(d1 as bigint) as d1, cast(d2 as bigint) as d2 from risk")
def at_risk_table(spark, sf_dir):
    return est.at_risk_table(orders_cp(spark, sf_dir), causes=CAUSES).select("t", "y", "d", "c", "d1", "d2")


@query("nelson_aalen", POOLED + " select t, cast(y as bigint) as y, cast(d as bigint) as d, round(sum(d / y) over (order by t), 9) as cumhaz from risk where d > 0")
def nelson_aalen(spark, sf_dir):
    return rounded(est.nelson_aalen(orders_cp(spark, sf_dir)))


@query(
    "nelson_aalen_by_cause",
    POOLED + " select t, cast(y as bigint) as y, cast(d as bigint) as d, round(sum(d1 / y) over (order by t), 9) as h1, round(sum(d2 / y) over (order by t), 9) as h2 from risk where d > 0",
)
def nelson_aalen_by_cause(spark, sf_dir):
    return rounded(est.nelson_aalen_by_cause(orders_cp(spark, sf_dir), CAUSES))


@query(
    "nelson_aalen_by_segment",
    BY_SEGMENT + " select segment, t, cast(y as bigint) as y, cast(d as bigint) as d, round(sum(d / y) over (partition by segment order by t), 9) as cumhaz from risk where d > 0",
)
def nelson_aalen_by_segment(spark, sf_dir):
    return rounded(est.nelson_aalen(orders_cp(spark, sf_dir), ["segment"]))


@query(
    "kaplan_meier_by_segment",
    BY_SEGMENT + " select segment, t, cast(y as bigint) as y, cast(d as bigint) as d, round(product(1 - d / y) over (partition by segment order by t), 9) as surv from risk where d > 0",
)
def kaplan_meier_by_segment(spark, sf_dir):
    return rounded(est.kaplan_meier(orders_cp(spark, sf_dir), ["segment"]))


CENSORING = POOLED + ", g as (select t, y, c, product(1 - c / (y - d)) over (order by t) as g from risk where c > 0)"


@query("censoring_km", CENSORING + " select t, cast(y as bigint) as y, cast(c as bigint) as c, round(g, 9) as g from g")
def censoring_km(spark, sf_dir):
    return rounded(est.censoring_survival(orders_cp(spark, sf_dir)))


@query("censoring_km_left_limits", CENSORING + " select id, start, round(coalesce((select arg_max(g, t) from g where g.t < cp.stop), 1), 9) as g from cp")
def censoring_km_left_limits(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    return rounded(est.step_lookup(cp.df, est.censoring_survival(cp), "g", 1.0, time="stop", left=True).select("id", "start", "g"))


AJ = """, l as (select {by} t, d1 / y as l1, d2 / y as l2 from risk where d > 0),
 s as (select *, product(greatest(0, 1 - l1 - l2)) over ({part} order by t) as surv from l),
 p as (select *, lag(surv, 1, 1.0) over ({part} order by t) as b from s)
select {by} t, round(surv, 9) as surv, round(sum(b * l1) over ({part} order by t), 9) as f1, round(sum(b * l2) over ({part} order by t), 9) as f2 from p"""


@query("aalen_johansen", POOLED + AJ.format(by="", part=""))
def aalen_johansen(spark, sf_dir):
    return rounded(est.aalen_johansen(orders_cp(spark, sf_dir), CAUSES))


@query("aalen_johansen_by_segment", BY_SEGMENT + AJ.format(by="segment,", part="partition by segment"))
def aalen_johansen_by_segment(spark, sf_dir):
    return rounded(est.aalen_johansen(orders_cp(spark, sf_dir), CAUSES, ["segment"]))


EDGES8 = """, ev as (select stop as t, row_number() over (order by stop) as r, count(*) over () as n from cp where event != 0),
 edges as (select distinct t from ev, (select unnest(range(1, 9)) as k) where r = (k * n + 7) // 8 and t > 0)"""


@query("event_windows_8", CP_SQL + EDGES8 + " select t from edges")
def event_windows_8(spark, sf_dir):
    return est.event_window_table(orders_cp(spark, sf_dir), 8)


@query(
    "baseline_at_windows",
    POOLED + EDGES8 + ", na as (select t, sum(d / y) over (order by t) as h from risk where d > 0), a as (select t from edges union all select 0.0::double) select t, round(coalesce((select max(h) from na where na.t <= a.t), 0), 9) as h0 from a",
)
def baseline_at_windows(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    return rounded(est.baseline_at(cp, est.event_windows(cp, 8)))


THRESHOLDS = [1000.0, 2000.0, 4000.0, 6000.0, 8000.0]
LOGRANK = (
    CP_SQL
    + """, th as (select unnest([1000.0, 2000.0, 4000.0, 6000.0, 8000.0])::double as threshold),
 ev as (select stop as t, sum(cast(event != 0 as int)) as d, sum(cast(event = 1 as int)) as d1, sum(cast(event = 2 as int)) as d2 from cp where event != 0 group by 1),
 rr as (select th.threshold, ev.t, ev.d, ev.d1, ev.d2, count(*) as y, count(*) filter (acctbal <= threshold) as yl,
   count(*) filter (acctbal <= threshold and cp.stop = ev.t and event != 0) as dl,
   count(*) filter (acctbal <= threshold and cp.stop = ev.t and event = 1) as dl1, count(*) filter (acctbal <= threshold and cp.stop = ev.t and event = 2) as dl2
   from ev join cp on cp.start < ev.t and ev.t <= cp.stop cross join th group by 1, 2, 3, 4, 5),
 c as (select threshold, 0 as cause, y, yl, d, dl from rr union all select threshold, 1, y, yl, d1, dl1 from rr union all select threshold, 2, y, yl, d2, dl2 from rr),
 s as (select threshold, cause, sum(dl - d * yl / y) as u, sum(d * (yl / y) * (1 - yl / y) * (y - d) / (y - 1)) as v from c where y >= 2 and d > 0 group by 1, 2),
 x as (select *, case when v > 0 then u * u / v else 0 end as chi2 from s)"""
)


@query("logrank_thresholds", LOGRANK + " select threshold, round(u, 6) as u, round(v, 6) as v, round(chi2, 6) as chi2 from x where cause = 0")
def logrank_thresholds(spark, sf_dir):
    return rounded(logrank.logrank_thresholds(orders_cp(spark, sf_dir), "acctbal", THRESHOLDS), 6)


@query("logrank_by_cause", LOGRANK + " select threshold, cast(cause as bigint) as cause, round(chi2, 6) as chi2 from x where cause > 0")
def logrank_by_cause(spark, sf_dir):
    return rounded(logrank.logrank_by_cause(orders_cp(spark, sf_dir), "acctbal", THRESHOLDS, CAUSES), 6)


@query("composite_logrank", LOGRANK + " select threshold, round(sum(chi2), 6) as chi2 from x where cause > 0 group by 1")
def composite_logrank(spark, sf_dir):
    return rounded(logrank.composite_logrank(orders_cp(spark, sf_dir), "acctbal", THRESHOLDS, CAUSES), 6)


def _split_sql(missing: bool) -> str:
    """All admissible splits of the root on two features, scored by joining rows with event times."""
    value = "case when price > 250000 then null else price end" if missing else "price"
    ways = "(values ('right'), ('left')) w(missing)" if missing else "(values ('right')) w(missing)"
    alone = " union all select feature_no, feature, cast(-1 as integer), cast(null as double), 'alone' from (values (0, 'price'), (1, 'acctbal')) f(feature_no, feature)" if missing else ""
    return (
        CP_SQL
        + f""", x as (select id, start, stop, event, {value} as price, acctbal from cp),
 e as (select 0 as feature_no, 'price' as feature, unnest([50000.0, 100000.0, 150000.0, 200000.0])::double as threshold
   union all select 1, 'acctbal', unnest([0.0, 2500.0, 5000.0, 7500.0])::double),
 n as (select feature_no, feature, cast(row_number() over (partition by feature_no order by threshold) - 1 as integer) as bin, threshold from e),
 cand as (select feature_no, feature, bin, threshold, missing from n cross join {ways}{alone}),
 z as (select x.*, cand.*, case when cand.feature = 'price' then x.price else x.acctbal end as val from x cross join cand),
 s as (select *, case when missing = 'alone' then val is null when val is null then missing = 'left' else val <= threshold end as l from z),
 units as (select feature_no, feature, bin, threshold, missing, count(distinct case when l then id end) as units_left, count(distinct case when not l then id end) as units_right,
   sum(cast(l and event != 0 as int)) as events_left, sum(cast(not l and event != 0 as int)) as events_right from s group by 1, 2, 3, 4, 5),
 ev as (select distinct stop as t from x where event != 0),
 rr as (select feature_no, bin, missing, ev.t, count(*) as y, count(*) filter (l) as yl, count(*) filter (s.stop = ev.t and event != 0) as d,
   count(*) filter (l and s.stop = ev.t and event != 0) as dl from s join ev on s.start < ev.t and ev.t <= s.stop group by 1, 2, 3, 4),
 sc as (select feature_no, bin, missing, sum(dl - d * yl / y) as u, sum(d * (yl / y) * (1 - yl / y) * (y - d) / (y - 1)) as v from rr where y >= 2 group by 1, 2, 3)
select units.feature_no, feature, units.bin, threshold, units.missing, units_left, units_right, cast(events_left as bigint) as events_left, cast(events_right as bigint) as events_right,
  round(case when v > 0 then u * u / v else 0 end, 6) as score from units join sc on sc.feature_no = units.feature_no and sc.bin = units.bin and sc.missing = units.missing
  where least(units_left, units_right) >= 15 and least(events_left, events_right) >= 3"""
    )


EDGES = {"price": [50000.0, 100000.0, 150000.0, 200000.0], "acctbal": [0.0, 2500.0, 5000.0, 7500.0]}
TOP_SPLIT = " qualify row_number() over (order by score desc, feature_no, bin, case missing when 'right' then 0 when 'left' then 1 else -1 end) = 1"


def _with_missing(spark, sf_dir):
    cp = orders_cp(spark, sf_dir)
    return cp.with_df(cp.df.withColumn("price", F.when(F.col("price") <= 250000, F.col("price"))))


@query("split_candidates", _split_sql(False))
def split_candidates(spark, sf_dir):
    return rounded(logrank.split_candidates(orders_cp(spark, sf_dir), EDGES, 15, 3), 6)


@query("split_candidates_missing", _split_sql(True))
def split_candidates_missing(spark, sf_dir):
    return rounded(logrank.split_candidates(_with_missing(spark, sf_dir), EDGES, 15, 3, with_missing=True), 6)


@query("root_best_split", "select * from (" + _split_sql(False) + ")" + TOP_SPLIT)
def root_best_split(spark, sf_dir):
    return rounded(logrank.best_split(orders_cp(spark, sf_dir), EDGES), 6)


@query("root_best_split_missing", "select * from (" + _split_sql(True) + ")" + TOP_SPLIT)
def root_best_split_missing(spark, sf_dir):
    return rounded(logrank.best_split(_with_missing(spark, sf_dir), EDGES, with_missing=True), 6)


@query(
    "visits_to_rows",
    """with v as (select user_id, epoch_us(ts) / 1000000.0 as day, max(epoch_us(ts) / 1000000.0) over (partition by user_id) as futime, event_type from events),
 d as (select distinct user_id, day, futime from v where day < futime)
select user_id as id, cast(day as double) as start, cast(coalesce(lead(day) over (partition by user_id order by day), futime) as double) as stop,
  cast(case when lead(day) over (partition by user_id order by day) is null then 1 else 0 end as bigint) as event from d""",
)
def visits_to_rows(spark, sf_dir):
    from pyspark.sql.window import Window

    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    visits = read(spark, sf_dir, "events").select("user_id", seconds.alias("day")).distinct()
    visits = visits.withColumns({"futime": F.max("day").over(Window.partitionBy("user_id")), "status": F.lit(1)})
    return adapters.from_visits(visits, "user_id", "day", "futime", "status")
