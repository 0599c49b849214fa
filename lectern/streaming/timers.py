"""Limits in time: what is late, on a stream that may go quiet and over rows of the past.

A limit is armed by some commands, armed anew by each of them, and lifted by others. If nothing
lifts it in time, it runs out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Limit:
    name: str
    ms: int
    arms: tuple[str, ...]
    lifts: tuple[str, ...]


#: How long starting and recognizing may take, how long progress may stay away, and when an idle recognizer is given back.
LIMITS = (
    Limit("init", 30_000, ("init",), ("ready", "failed")),
    Limit("recognize", 60_000, ("recognize",), ("done", "failed")),
    Limit("stall", 90_000, ("recognize", "progress"), ("done", "failed")),
    Limit("idle", 300_000, ("done", "ready"), ("recognize", "init")),
)


def run_out(events: DataFrame, keys: list[str], order: list[str], at: str, command: str, limits: tuple[Limit, ...] = LIMITS, until: str | None = None) -> DataFrame:
    """keys, name, armed_at, out_at: the limits that ran out, in milliseconds.

    A limit runs out if the next command of its key that arms or lifts it comes no sooner, or
    never does; with `until`, a column of the time to which the rows reach, it must have passed by then.
    """
    told = F.array(*[
        F.when(F.col(command).isin(*set(x.arms + x.lifts)), F.struct(F.lit(x.name).alias("name"), F.lit(x.ms).cast("long").alias("ms"), F.col(command).isin(*x.arms).alias("arms"))) for x in limits
    ])
    rows = events.select(*dict.fromkeys([*keys, *order, at, *([until] if until else [])]), F.inline(F.filter(told, lambda t: t.isNotNull())))
    after = F.lead(at).over(Window.partitionBy(*keys, "name").orderBy(*order))
    out = F.col(at) + F.col("ms")
    late = F.col("arms") & (F.col("__after").isNull() | (F.col("__after") >= out))
    if until:
        late = late & (out <= F.col(until))
    return rows.withColumn("__after", after).where(late).select(*keys, "name", F.col(at).alias("armed_at"), out.alias("out_at"))


class Watch(StatefulProcessor):
    """One timer for each limit of a key; state: when the limit that runs will run out."""

    def __init__(self, command: str, order: str, limits: tuple[Limit, ...]):
        self.command, self.order, self.limits = command, order, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getMapState("running", "name string", "out bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        commands = [r for part in rows for r in zip(part[self.order].tolist(), part[self.command].tolist(), strict=True)]
        for _, command in sorted(commands):
            for x in self.limits:
                if command in x.arms or command in x.lifts:
                    self._lift(x.name)
                if command in x.arms:
                    self.running.updateValue((x.name,), (now + x.ms,))
                    self.handle.registerTimer(now + x.ms)
        yield pd.DataFrame({"key": [], "name": []}, dtype=object)

    def _lift(self, name: str) -> None:
        if self.running.containsKey((name,)):
            out = self.running.getValue((name,))[0]
            self.running.removeKey((name,))
            if not any(v[0] == out for v in self.running.values()):  # limits may share a time
                self.handle.deleteTimer(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = expiredTimerInfo.getExpiryTimeInMs()
        gone = sorted(k[0] for k, v in self.running.iterator() if v[0] == out)
        for name in gone:
            self.running.removeKey((name,))
        yield pd.DataFrame({"key": [str(key[0])] * len(gone), "name": gone}, dtype=object)  # as Spark can turn it into Arrow

    def close(self) -> None:
        pass


def watch_stream(events: DataFrame, key: str, command: str, order: str, limits: tuple[Limit, ...] = LIMITS) -> DataFrame:
    """(key as text, name) of each limit that runs out, by the clock, also while the stream is quiet.

    Needs the RocksDB state store. Commands of one batch are taken by `order`.
    """
    return events.groupBy(key).transformWithStateInPandas(Watch(command, order, limits), "key string, name string", "Append", "ProcessingTime")
