"""A streaming query run to its end over the events table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.plans.registry import query
from hazardframe.storage import fresh_path
from hazardframe.streaming.intervals import interval_stream


@query(
    "interval_stream",
    """with e as (select user_id as id, epoch_us(ts) / 1e6 as t, case when event_type = 'error' then 1 else 0 end as label, value from events),
 f as (select id, min(case when label = 1 then t end) as te from e group by 1),
 d as (select e.id, t, max(label) as label, arg_max(value, label * 1e9 + value) as value from e join f using (id) where te is null or t <= te group by 1, 2),
 n as (select id, t as start, lead(t) over (partition by id order by t) as stop, lead(label) over (partition by id order by t) as event, value, label from d)
select id, start, stop, cast(event as bigint) as event, value from n where stop is not null""",
)
def intervals(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")
    events = events.withColumn("label", F.when(F.col("event_type") == "error", 1).otherwise(0))
    rows = interval_stream(events, "user_id", "ts", "label", "value", "36500 days")
    path = fresh_path(spark, "intervals")
    stream = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")
