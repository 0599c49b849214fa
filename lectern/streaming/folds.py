"""Stateful operators over ordered events, in batch form.

Where the state is a sum, an extreme or the row before, windows give it. Where it isn't, blocks of
sorted rows are run side by side and their functions of the state are followed from block to block
(scans), so no task holds a key's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def cross_source_dedup(events: DataFrame, key: str, at: Column, source: str, order: str, window_ms: int) -> DataFrame:
    """events with `accepted`: false if the last accepted event of the key came from another source
    less than window_ms before."""
    timed = events.withColumn("__at", at)
    return scans.scan(timed, [key], ["__at", order], ["__at", source], scans.Dedup(window_ms), "accepted").drop("__at")


def bounded_queue(events: DataFrame, keys: list[str], order: list[str], arrives: str, most: int = 3) -> DataFrame:
    """events with `queue`: accepted or rejected for arrivals, done for finishes; at most `most` wait."""
    return scans.scan(events, keys, order, [arrives], scans.Queue(most), "queue")


def playback(events: DataFrame, keys: list[str], order: list[str], command: str) -> DataFrame:
    """events with `status`: what is told after the commands enqueue, finish, error, stop.

    STARTED for each text that begins to play: on an empty queue, or when the one before has
    finished or failed. ENDED when the last one finishes. ERROR when one fails, after which the next
    one plays (`ERROR,STARTED`) or, behind the last one, nothing is told. STOPPED empties the queue. QUEUED
    and IDLE tell nothing: a text waits, or there is none to finish or fail.
    The texts that are left are the sum of steps since the queue was last emptied, less the least
    value of that sum if it fell below zero, as a finish of an empty queue takes nothing.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    epoch = Window.partitionBy(*keys, "__epoch").orderBy(*order)
    c = F.col(command)
    move = F.when(c == "enqueue", 1).when(c.isin("finish", "error"), -1).otherwise(0)
    rows = events.withColumn("__epoch", F.sum(F.when(c == "stop", 1).otherwise(0)).over(w))
    rows = rows.withColumn("__sum", F.sum(move).over(epoch.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.min("__sum").over(epoch.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__left", F.col("__sum") - F.least(least, F.lit(0)))
    before = F.coalesce(F.lag("__left").over(epoch), F.lit(0))
    status = (
        F.when(c == "stop", "STOPPED").when(c == "enqueue", F.when(F.col("__before") == 0, "STARTED").otherwise("QUEUED")).when(F.col("__before") == 0, "IDLE")
        .when(c == "finish", F.when(F.col("__before") == 1, "ENDED").otherwise("STARTED")).when(c == "error", F.when(F.col("__before") == 1, "ERROR").otherwise("ERROR,STARTED"))
    )
    return rows.withColumn("__before", before).withColumn("status", status).drop("__epoch", "__sum", "__left", "__before")


def overall_progress(events: DataFrame, keys: list[str], order: list[str], progress: str, share: float = 0.6, slack: float = 0.05) -> DataFrame:
    """events with `overall`: progress of repeated passes as one value that never falls back to a pass's start.

    A drop by more than slack closes a pass: its share of what is left is added to the base. After
    n closed passes the base is therefore 1 - (1 - share)^n.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("__p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(progress), F.lit(0.0)))))
    rows = rows.withColumn("__drop", (F.col("__p") < F.coalesce(F.lag("__p").over(w), F.lit(0.0)) - slack).cast("int"))
    left = F.pow(F.lit(1 - share), F.sum("__drop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("overall", 1 - left + left * share * F.col("__p")).drop("__p", "__drop")


def serialized(events: DataFrame, keys: list[str], order: list[str], arrives: str, takes: str, fails: Column) -> DataFrame:
    """events with started, ended, outcome: operations of a key run one after another in order.

    Each starts when it arrives, or when the one before has ended, be it done or failed. With D
    the time that all operations up to one take, it ends at D plus the largest of arrival less the
    D of the operation before, over it and all before it.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__all", F.sum(takes).over(w))
    rows = rows.withColumn("ended", F.col("__all") + F.max(F.col(arrives) - (F.col("__all") - F.col(takes))).over(w))
    return rows.withColumn("started", F.col("ended") - F.col(takes)).withColumn("outcome", F.when(fails, "failed").otherwise("done")).drop("__all")


def current_generation(events: DataFrame, keys: list[str], order: list[str], stops: Column) -> DataFrame:
    """Events that belong to the latest generation of their key; each stop begins a new one."""
    w = Window.partitionBy(*keys)
    numbered = events.withColumn("generation", F.sum(F.when(stops, 1).otherwise(0)).over(w.orderBy(*order)))
    return numbered.withColumn("__last", F.max("generation").over(w)).where("generation = __last").drop("__last")


def first_claim(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events with `should_show`: true for the first claimant of a key alone."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("should_show", n == 1)


def route(events: DataFrame, channel: list[str], order: list[str], target: str, part: Column) -> DataFrame:
    """events with `stopped`: the target that loses the channel because another takes it over.

    `part` cuts the order into ranges (hours, say) that tasks can share; the last target of a
    range is carried to the first event of the next one.
    """
    cut = events.withColumn("__part", part)
    last = cut.groupBy(*channel, "__part").agg(F.max_by(F.struct(F.col(target).alias("t")), F.struct(*order)).alias("__last"))
    over = Window.partitionBy(*channel).orderBy("__part")
    carried_over = last.select(*channel, "__part", F.lag("__last").over(over).alias("__carried"))
    within = Window.partitionBy(*channel, "__part").orderBy(*order)
    rows = cut.withColumn("__first", F.row_number().over(within) == 1).withColumn("__lag", F.lag(target).over(within)).join(carried_over, [*channel, "__part"])
    before = F.when(F.col("__first"), F.col("__carried")["t"]).otherwise(F.col("__lag"))
    return rows.withColumn("stopped", F.when(before != F.col(target), before)).drop("__part", "__first", "__lag", "__carried")


def targets(events: DataFrame, channel: list[str], order: list[str], target: str, starts: Column, closes: Column, part: Column) -> DataFrame:
    """events with `target_now`: the target that the channel has at each event; null once it has closed.

    A start gives the channel to its target, which holds it until the next start or until it
    closes itself: an interval of the order that ends at the target's next close. `part` cuts the order into ranges
    that tasks can share; the last start of a range is carried to the next ones.
    """
    at = F.struct(*order)
    w = Window.partitionBy(*channel, target).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    cut = events.withColumn("__part", part).withColumn("__ends", F.min(F.when(closes, at)).over(w))
    start = F.when(starts, F.struct(F.col(target).alias("t"), F.col("__ends").alias("ends")))
    last = cut.withColumn("__s", start).groupBy(*channel, "__part").agg(F.max_by("__s", F.when(F.col("__s").isNotNull(), at)).alias("__last"))
    parts = Window.partitionBy(*channel).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*channel, "__part", F.last("__last", ignorenulls=True).over(parts).alias("__carried"))
    within = Window.partitionBy(*channel, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("__own", F.last(start, ignorenulls=True).over(within)).join(carried, [*channel, "__part"])
    rows = rows.withColumn("__now", F.coalesce("__own", "__carried"))
    open_ = F.col("__now.ends").isNull() | (at < F.col("__now.ends"))
    return rows.withColumn("target_now", F.when(open_, F.col("__now.t"))).drop("__part", "__ends", "__own", "__carried", "__now")


def bounded_reads(chunks: DataFrame, keys: list[str], order: list[str], size: str, at: str, most: int, deadline: int, declared: str | None = None) -> DataFrame:
    """keys, outcome, n_bytes: whether what arrives in chunks may be taken whole: read, too-large or late.

    Chunks add up in order. The first that comes after the deadline, or takes the sum beyond
    `most`, ends the reading; lateness is asked first. A declared size beyond `most` ends it before.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = chunks.withColumn("__upto", F.sum(size).over(w))
    fault = F.when(F.col(at) >= deadline, "late").when(F.col("__upto") > most, "too-large")
    first = F.min_by(fault, F.when(fault.isNotNull(), F.struct(*order)))
    too_much = F.max(F.coalesce(F.col(declared) > most, F.lit(False))) if declared else F.lit(False)
    outcome = F.when(too_much, "too-large").otherwise(F.coalesce(first, F.lit("read")))
    return upto.groupBy(*keys).agg(outcome.alias("outcome"), F.sum(size).alias("__all")).select(*keys, "outcome", F.when(F.col("outcome") == "read", F.col("__all")).alias("n_bytes"))


def prefetched(events: DataFrame, keys: list[str], order: list[str], command: str, ahead: int = 2) -> DataFrame:
    """events with `synthesized`: texts made so far if at most `ahead` may be made before one ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    count = lambda what: F.sum(F.when(F.col(command) == what, 1).otherwise(0)).over(w)
    return events.withColumn("synthesized", F.least(count("enqueue"), count("finish") + ahead))


def stalls(events: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """Sessions of a key that a gap ends: first and last time and events; each end is a stall."""
    sessions = events.groupBy(*keys, F.session_window(at, gap).alias("s"))
    return sessions.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
