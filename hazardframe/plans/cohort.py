"""The cohort that the registered queries run on, in DataFrame form and as SQL.

Customers enter on their first order day; each order day begins a row with the
day's largest price; the first day with an urgent (cause 1) or low-priority order
(cause 2, unless both) ends follow-up with an event, else it is censored 730 days
after entry. Time is in days since 1995-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.frame import CountingProcess
from hazardframe.functions import days_since
from hazardframe.sources.adapters import from_event_log

ORIGIN = "1995-01-01"
FOLLOW_UP = 730.0
CAUSES = [1, 2]

#: DuckDB: the common table expressions up to ``cp``.
CP_SQL = """with o as (select o_custkey as id, cast(date_diff('day', timestamp '1995-01-01', o_orderdate) as double) as t,
   max(o_totalprice) as price, min(case when o_orderpriority='1-URGENT' then 1 when o_orderpriority='5-LOW' then 2 end) as lab
   from orders group by 1, 2),
 f as (select id, min(t) as t0, min(case when lab is not null then t end) as te from o group by id),
 k as (select o.id, o.t as start, lead(o.t) over (partition by o.id order by o.t) as nx, o.price, f.t0, f.te
   from o join f on o.id=f.id where (f.te is null or o.t < f.te) and o.t < f.t0 + 730),
 r as (select id, start, least(coalesce(nx, te, t0+730), coalesce(te, t0+730), t0+730) as stop, te, price from k),
 cp as (select r.id, r.start, r.stop, cast(coalesce(l.lab, 0) as bigint) as event, r.price, c.c_acctbal as acctbal, c.c_mktsegment as segment
   from r left join o l on l.id=r.id and l.t=r.stop and r.te = r.stop join customer c on c.c_custkey=r.id where r.start < r.stop)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_cp(spark: SparkSession, sf_dir: str) -> CountingProcess:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", days_since(F.col("o_orderdate"), ORIGIN).alias("t"))
    cause = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "5-LOW", 2)
    rows = from_event_log(orders, "o_custkey", "t", cause, {"price": F.max("o_totalprice")}, FOLLOW_UP)
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return CountingProcess(rows.join(customer, "id"), features=("price", "acctbal", "segment"))
