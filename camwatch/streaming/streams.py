"""Streaming twins of the operators. All use event time; rows behind the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from camwatch.operators.filters import route_messages


def stream_route(messages: DataFrame) -> DataFrame:
    return route_messages(messages)


def stream_incidents(events: DataFrame, gap_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """Sessions by site. Spark joins sessions at exactly the gap, the rule doesn't: hence one microsecond less."""
    w = F.session_window("ts", f"{gap_s - 1}.999999 seconds")
    return events.withWatermark("ts", late).groupBy("site_id", w).agg(F.count("*").alias("n_events"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"))


def stream_request_rate(messages: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    return messages.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes")).agg(F.count("*").alias("n"))


def stream_first_per_key(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def timeline_sink(entries: DataFrame, path: str, checkpoint: str, now: str):
    """Append each batch of entries to the timeline table."""
    from camwatch.sources.files import append_timeline

    return entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_timeline(df, path, now)).trigger(availableNow=True).start()


def _rows(parts: Iterator[pd.DataFrame], by: str = "ts") -> pd.DataFrame:
    found = [p for p in parts if len(p)]
    return pd.concat(found).sort_values([by, "event_id"]) if found else pd.DataFrame()


def delayed_trigger(events: DataFrame, delay_s: int = 5, late: str = "1 minute") -> DataFrame:
    """The event id once, ``delay_s`` after its start, if it hasn't ended by then."""

    def step(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"event_id": [key[0]]})
            return
        for r in _rows(parts).itertuples():
            if r.type == "new" and not state.exists:
                state.update((True,))
                state.setTimeoutTimestamp(max(int(r.ts.timestamp() * 1000) + delay_s * 1000, state.getCurrentWatermarkMs() + 1))
            elif r.type == "end" and state.exists:
                state.remove()

    return events.withWatermark("ts", late).groupBy("event_id").applyInPandasWithState(step, "event_id string", "open boolean", "append", GroupStateTimeout.EventTimeTimeout)
