"""Counting-process rows from a stream of events.

Every event closes its id's open interval; the state of an id is the start and
values of that interval, so it has a fixed size, and with ``idle`` it is given up
once the watermark has passed the id's last event by so long. Events that come later than the
watermark allows are dropped by the engine, and an event older than the open
interval is counted as late and left out, which keeps an id's rows in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROWS = "id long, start double, stop double, event long, value double"
STATE = "start double, value double, closed boolean, late long"


def interval_stream(events: DataFrame, id: str, ts: str, label: str, value: str, delay: str = "1 day", idle: float | None = None) -> DataFrame:
    """Rows ``id, start, stop, event, value`` as events come in; times are seconds of the event clock.

    ``label`` is 0 for an ordinary event and a cause for a terminal one, which
    closes the id for good. ``idle`` is in seconds; an id whose state was given up
    begins anew with its next event. Without it states are kept for ever, which
    only a bounded set of ids allows.
    """
    clocked = events.select(F.col(id).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.col(label).cast("long").alias("label"), F.col(value).cast("double").alias("value"))
    clocked = clocked.withWatermark("ts", delay).withColumn("t", F.unix_micros("ts") / 1e6)

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, held, closed, late = state.get if state.exists else (None, None, False, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["t", "label"]).itertuples():
            if closed or (start is not None and r.t <= start):
                late += int(not closed and r.t < start)
                if not closed and r.t == start:
                    held = r.value
                continue
            if start is not None:
                rows.append((key[0], start, r.t, int(r.label), held))
            start, held, closed = r.t, r.value, bool(r.label)
        state.update((start, held, closed, late))
        if idle is not None:
            state.setTimeoutTimestamp(max(int((start + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["id", "start", "stop", "event", "value"])

    return clocked.groupBy("id").applyInPandasWithState(close, ROWS, STATE, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout)
