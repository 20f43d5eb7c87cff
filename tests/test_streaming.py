"""Intervals of a stream whose idle ids are given up."""

import datetime as dt

from hazardframe.streaming.intervals import interval_stream


def test_idle_ids_begin_anew(spark, tmp_path):
    schema = "id long, ts timestamp, label long, value double"
    at = lambda minute: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)
    batches = [[(1, at(0), 0, 1.0), (2, at(1), 0, 5.0)], [(2, at(300), 0, 6.0)], [(2, at(310), 0, 7.0)], [(1, at(320), 0, 2.0), (2, at(330), 1, 8.0)]]
    for idle, first in ((None, True), (3600.0, False)):
        folder = tmp_path / f"in{idle}"
        folder.mkdir()
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        rows = interval_stream(events, "id", "ts", "label", "value", "1 minute", idle)
        out = []
        stream = rows.writeStream.foreachBatch(lambda df, _, out=out: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / f"state{idle}")).outputMode("append").start()
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
            stream.processAllAvailable()
        stream.stop()
        base = at(0).timestamp()
        got = sorted((i, (a - base) / 60, (z - base) / 60, e, v) for i, a, z, e, v in out)
        assert ((1, 0.0, 320.0, 0, 1.0) in got) == first
        assert (2, 310.0, 330.0, 1, 7.0) in got
