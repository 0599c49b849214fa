"""The same state rules on unbounded input, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_stream(events: DataFrame, key: str, source: str, at_ms: str, window_ms: int, idle_ms: int | None = 300_000) -> DataFrame:
    """Cross-source dedup of a stream: state is the last accepted event of each key.

    It expires when idle for idle_ms; without (None) it stays, and a stream with nothing new rests.
    An event without a source (its key has closed) passes and removes the state.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        for rows in batches:
            rows = rows.sort_values([at_ms, source], kind="stable").astype({source: object})
            rows[source] = rows[source].where(rows[source].notna(), None)
            keep = []
            for at, name in zip(rows[at_ms], rows[source], strict=True):
                ok = last is None or name is None or last[1] == name or at - last[0] >= window_ms
                if ok:
                    last = None if name is None else (int(at), name)
                keep.append(ok)
            yield rows[keep]
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update(last)
            if idle_ms:
                state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(run, events.schema, "at bigint, source string", "append", timeout)


def latest_capture(events: DataFrame, key: str, at: str, expiry: str = "5 minutes") -> DataFrame:
    """The last record of each key within its expiry: event time windows with a watermark drop late ones."""
    return events.withWatermark(at, expiry).groupBy(key, F.window(at, expiry)).agg(F.max_by(F.struct(*events.columns), at).alias("record"))


def speech_sink(df: DataFrame, write, checkpoint: str):
    """Start a stream whose micro-batches are handed to write(batch, id) as patched synthesis requests."""

    def send(batch: DataFrame, batch_id: int) -> None:
        write(with_pauses(batch), batch_id)

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send)


def with_pauses(queries: DataFrame, speed: str = "speed", query: str = "query") -> DataFrame:
    """Synthesis queries with the pauses before and after set to a tenth of the speed."""
    pause = F.col(speed) * 0.1
    return queries.withColumn(query, F.col(query).withField("prePhonemeLength", pause).withField("postPhonemeLength", pause))
