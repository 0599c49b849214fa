"""Queries of the stateful operators over events, with recursive SQL to check the folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import folds, timers

#: One hour; at the 400 ms of interactive use nothing in these events would be suppressed.
DEDUP_MS = 3_600_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    command = F.expr("CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'stop' ELSE 'enqueue' END")
    return events.withColumn("day", F.to_date("ts")).withColumn("command", command)


EVENTS = """e AS (SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS day,
  CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'stop' ELSE 'enqueue' END AS command FROM events)"""
NUMBERED = EVENTS + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e)"
DAILY = NUMBERED.replace("PARTITION BY user_id", "PARTITION BY user_id, day")


def cross_source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.cross_source_dedup(_events(spark, sf_dir), "user_id", F.unix_millis("ts"), "event_type", "event_id", DEDUP_MS)
    return out.select("event_id", "user_id", "accepted")


DEDUP_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM e),
r AS (SELECT event_id, user_id, i, ms AS at, event_type AS source, true AS accepted FROM n WHERE i = 1
  UNION ALL SELECT n.event_id, n.user_id, n.i,
    CASE WHEN r.source <> n.event_type AND n.ms - r.at < {DEDUP_MS} THEN r.at ELSE n.ms END,
    CASE WHEN r.source <> n.event_type AND n.ms - r.at < {DEDUP_MS} THEN r.source ELSE n.event_type END,
    NOT (r.source <> n.event_type AND n.ms - r.at < {DEDUP_MS}) FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, user_id, accepted FROM r
"""


def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("arrives", F.col("command") != "finish")
    return folds.bounded_queue(events, ["user_id"], ["ts", "event_id"], "arrives", 2).select("event_id", "queue")


QUEUE_SQL = f"""
WITH RECURSIVE {NUMBERED},
r AS (SELECT event_id, user_id, day, i, CASE WHEN command = 'finish' THEN 0 ELSE 1 END AS p, CASE WHEN command = 'finish' THEN 'done' ELSE 'accepted' END AS queue FROM n WHERE i = 1
  UNION ALL SELECT n.event_id, n.user_id, n.day, n.i,
    CASE WHEN command = 'finish' THEN greatest(r.p - 1, 0) WHEN r.p < 2 THEN r.p + 1 ELSE r.p END,
    CASE WHEN command = 'finish' THEN 'done' WHEN r.p < 2 THEN 'accepted' ELSE 'rejected' END
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, queue FROM r
"""


def playback_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.playback(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "command").select("event_id", "status")


PLAYBACK_SQL = f"""
WITH RECURSIVE {NUMBERED},
r AS (SELECT event_id, user_id, i, command, 0 AS before, CASE WHEN command = 'enqueue' THEN 1 ELSE 0 END AS p FROM n WHERE i = 1
  UNION ALL SELECT n.event_id, n.user_id, n.i, n.command, r.p, CASE n.command WHEN 'enqueue' THEN r.p + 1 WHEN 'stop' THEN 0 ELSE greatest(r.p - 1, 0) END
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, CASE WHEN command = 'stop' THEN 'STOPPED' WHEN command = 'enqueue' THEN CASE WHEN before = 0 THEN 'STARTED' ELSE 'QUEUED' END WHEN before = 0 THEN 'IDLE'
  WHEN command = 'finish' THEN CASE WHEN before = 1 THEN 'ENDED' ELSE 'STARTED' END ELSE CASE WHEN before = 1 THEN 'ERROR' ELSE 'ERROR,STARTED' END END AS status FROM r
"""


def overall_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("p", F.col("value") / 200)
    return folds.overall_progress(events, ["user_id"], ["ts", "event_id"], "p").select("event_id", F.round("overall", 9).alias("overall"))


PROGRESS_SQL = f"""
WITH RECURSIVE {NUMBERED}, v AS (SELECT *, least(1.0, greatest(0.0, value / 200)) AS q FROM n),
r AS (SELECT event_id, user_id, day, i, CAST(0 AS DOUBLE) AS base, CAST(q AS DOUBLE) AS prev FROM v WHERE i = 1
  UNION ALL SELECT v.event_id, v.user_id, v.day, v.i, CASE WHEN v.q < r.prev - CAST(0.05 AS DOUBLE) THEN r.base + (1 - r.base) * CAST(0.6 AS DOUBLE) ELSE r.base END, CAST(v.q AS DOUBLE)
  FROM r JOIN v ON v.user_id = r.user_id AND v.i = r.i + 1)
SELECT event_id, round(base + (1 - base) * CAST(0.6 AS DOUBLE) * prev, 9) AS overall FROM r
"""


def current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.current_generation(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("command") == "stop")
    return out.select("event_id", "user_id", F.col("generation").cast("long").alias("generation"))


GENERATION_SQL = f"""
WITH {EVENTS}, g AS (SELECT *, sum(CASE WHEN command = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation FROM e)
SELECT event_id, user_id, CAST(generation AS BIGINT) AS generation FROM (SELECT *, max(generation) OVER (PARTITION BY user_id) AS last FROM g) WHERE generation = last
"""


def first_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.first_claim(_events(spark, sf_dir), ["user_id", "day"], ["ts", "event_id"]).select("event_id", "should_show")


CLAIM_SQL = f"WITH {DAILY} SELECT event_id, i = 1 AS should_show FROM n"


def route_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.route(_events(spark, sf_dir).withColumn("channel", F.lit("speech")), ["channel"], ["ts", "event_id"], "user_id", F.date_trunc("hour", "ts")).select("event_id", "user_id", "stopped")


ROUTE_SQL = f"""
WITH {EVENTS}, l AS (SELECT *, lag(user_id) OVER (ORDER BY ts, event_id) AS before FROM e)
SELECT event_id, user_id, CASE WHEN before <> user_id THEN before END AS stopped FROM l
"""


def prefetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.prefetched(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "command").select("event_id", "synthesized")


PREFETCH_SQL = f"""
WITH {EVENTS}, c AS (SELECT event_id, sum(CASE WHEN command = 'enqueue' THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN command = 'finish' THEN 1 ELSE 0 END) OVER w AS b
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(least(a, b + 2) AS BIGINT) AS synthesized FROM c
"""


def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.stalls(_events(spark, sf_dir), ["user_id"], "ts", "6 hours")
    return out.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n")


STALL_SQL = f"""
WITH {EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, s
"""


def serialized_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of each user one after another: when each starts and ends, and that failing ones hold up nobody."""
    events = _events(spark, sf_dir).withColumn("at_us", F.unix_micros("ts")).withColumn("takes_us", (F.coalesce(F.col("value"), F.lit(0.0)) * 100_000_000).cast("bigint"))
    out = folds.serialized(events, ["user_id"], ["ts", "event_id"], "at_us", "takes_us", F.col("command") == "error")
    return out.select("event_id", "user_id", F.col("started").alias("started_us"), F.col("ended").alias("ended_us"), "outcome")


SERIAL_SQL = f"""
WITH RECURSIVE {NUMBERED}, o AS (SELECT *, epoch_us(ts) AS at_us, CAST(trunc(coalesce(value, 0) * 100000000) AS BIGINT) AS takes FROM n),
r AS (SELECT event_id, user_id, i, command, at_us AS started, at_us + takes AS ended FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.i, o.command, greatest(o.at_us, r.ended), greatest(o.at_us, r.ended) + o.takes FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT event_id, user_id, started AS started_us, ended AS ended_us, CASE WHEN command = 'error' THEN 'failed' ELSE 'done' END AS outcome FROM r
"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's record as a later reader finds it: the last one, unless it is older than its expiry."""
    events = _events(spark, sf_dir)
    read_at = events.agg(F.max("ts").alias("read_at"))
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("r"))
    old = F.unix_micros("read_at") - F.unix_micros("r.ts") > 12 * 3_600_000_000
    return last.join(F.broadcast(read_at)).select("user_id", F.col("r.event_id").alias("event_id"), F.when(old, "expired").otherwise("valid").alias("state"))


CAPTURE_SQL = """
SELECT user_id, event_id, CASE WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) > 12 * 3600000000 THEN 'expired' ELSE 'valid' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1
"""

#: Commands of a recognizer, and the limits that hold for them.
COMMANDS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'init' WHEN 'click' THEN 'recognize' ELSE CASE WHEN event_id % 2 = 0 THEN 'progress' ELSE 'ready' END END"


def limits_run_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits in time that ran out between the commands of each user, an hour standing for a second."""
    events = _events(spark, sf_dir).withColumn("at_ms", F.unix_millis("ts") / 3600).withColumn("at_ms", F.floor("at_ms")).withColumn("step", F.expr(COMMANDS))
    out = timers.run_out(events, ["user_id"], ["ts", "event_id"], "at_ms", "step")
    return out.groupBy("user_id", "name", "armed_at", "out_at").agg(F.count("*").alias("n"))


_LIMIT_ROWS = ", ".join(f"('{x.name}', {x.ms}, {list(x.arms)}, {list(x.lifts)})" for x in timers.LIMITS)
LIMITS_SQL = f"""
WITH e AS (SELECT event_id, user_id, ts, (epoch_us(ts) // 1000) // 3600 AS at_ms, {COMMANDS} AS step FROM events), l(name, ms, arms, lifts) AS (VALUES {_LIMIT_ROWS}),
t AS (SELECT user_id, name, ms, at_ms, list_contains(arms, step) AS arms, lead(at_ms) OVER (PARTITION BY user_id, name ORDER BY ts, event_id) AS after FROM e JOIN l ON list_contains(arms, step) OR list_contains(lifts, step))
SELECT user_id, name, at_ms AS armed_at, at_ms + ms AS out_at, count(*) AS n FROM t WHERE arms AND (after IS NULL OR after >= at_ms + ms) GROUP BY ALL
"""


def playback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user whose text is played at each event: purchases start, errors of the same user close."""
    events = _events(spark, sf_dir).withColumn("channel", F.lit("speech"))
    starts, closes = F.col("event_type") == "purchase", F.col("event_type").isin("error", "signup")
    return folds.targets(events, ["channel"], ["ts", "event_id"], "user_id", starts, closes, F.date_trunc("hour", "ts")).select("event_id", "target_now")


TARGETS_SQL = """
WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN n END) OVER (ORDER BY n) AS started FROM n),
t AS (SELECT s.event_id, s.n, s.started, o.user_id AS target FROM s LEFT JOIN n o ON o.n = s.started),
c AS (SELECT t.event_id, t.target, min(k.n) AS closed FROM t LEFT JOIN n k ON k.user_id = t.target AND k.event_type IN ('error', 'signup') AND k.n > t.started AND k.n <= t.n GROUP BY ALL)
SELECT event_id, CASE WHEN closed IS NULL THEN target END AS target_now FROM c
"""


def dedup_after_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cross_source_dedup; a signup closes the user's state, so what follows is accepted whatever its source."""
    events = _events(spark, sf_dir).withColumn("source", F.when(F.col("command") != "stop", F.col("event_type")))
    return folds.cross_source_dedup(events, "user_id", F.unix_millis("ts"), "source", "event_id", DEDUP_MS).select("event_id", "user_id", "accepted")


CLOSING_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'signup' THEN event_type END AS source, epoch_us(ts) // 1000 AS ms FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM e),
r AS (SELECT event_id, user_id, i, ms AS since, source AS held, true AS accepted FROM n WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, CASE WHEN ok THEN ms ELSE since END, CASE WHEN ok THEN source ELSE held END, ok
  FROM (SELECT n.event_id, n.user_id, n.i, n.ms, n.source, r.since, r.held, n.source IS NULL OR r.held IS NULL OR n.source = r.held OR n.ms - r.since >= {DEDUP_MS} AS ok FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))
SELECT event_id, user_id, accepted FROM r
"""


def reads_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that arrive as a user's events of a day: their bytes add up, and the day's first event sets the clock."""
    events = _events(spark, sf_dir).withColumn("n", F.coalesce(F.floor("value"), F.lit(0))).withColumn("ms", F.unix_millis("ts") - F.unix_millis(F.col("day").cast("timestamp")))
    events = events.withColumn("declared", F.when(F.col("event_id") % 40 == 0, 1000))
    return folds.bounded_reads(events, ["user_id", "day"], ["ts", "event_id"], "n", "ms", 300, 70_000_000, "declared").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "outcome", "n_bytes")


READS_SQL = f"""
WITH {EVENTS}, c AS (SELECT *, CAST(floor(coalesce(value, 0)) AS BIGINT) AS b, (epoch_us(ts) - epoch_us(CAST(day AS TIMESTAMP))) // 1000 AS ms FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM c),
f AS (SELECT *, CASE WHEN ms >= 70000000 THEN 'late' WHEN upto > 300 THEN 'too-large' END AS fault FROM s),
g AS (SELECT user_id, day, CASE WHEN bool_or(event_id % 40 = 0) THEN 'too-large' ELSE coalesce(arg_min(fault, (ts, event_id)) FILTER (fault IS NOT NULL), 'read') END AS outcome, sum(b) AS n FROM f GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, outcome, CAST(CASE WHEN outcome = 'read' THEN n END AS BIGINT) AS n_bytes FROM g
"""


def capture_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader who asks for a record by its id finds: it, an expired one, or another that took its place."""
    events = _events(spark, sf_dir)
    read_at = events.agg(F.max("ts").alias("read_at"))
    record = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("r")
    last = events.groupBy("user_id").agg(record, F.min(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("asked"))
    old = F.unix_micros("read_at") - F.unix_micros("r.ts") > 36 * 3_600_000_000
    asked = F.when(F.col("user_id") % 2 == 0, F.col("asked")).otherwise(F.col("r.event_id"))
    state = F.when(asked.isNull(), "no-id").when(old, "expired").when(asked != F.col("r.event_id"), "replaced").otherwise("valid")
    return last.join(F.broadcast(read_at)).select("user_id", state.alias("state"))


CAPTURE_READS_SQL = """
WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS ts, min(event_id) FILTER (event_id % 3 = 0) AS asked FROM events GROUP BY user_id),
a AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN asked ELSE id END AS want FROM l)
SELECT user_id, CASE WHEN want IS NULL THEN 'no-id' WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) > 36 * 3600000000 THEN 'expired' WHEN want <> id THEN 'replaced' ELSE 'valid' END AS state FROM a
"""

QUERIES = {
    "cross_source_dedup": (cross_source_dedup, DEDUP_SQL),
    "bounded_queue": (bounded_queue, QUEUE_SQL),
    "playback_states": (playback_states, PLAYBACK_SQL),
    "overall_progress": (overall_progress, PROGRESS_SQL),
    "current_generation": (current_generation, GENERATION_SQL),
    "first_claim": (first_claim, CLAIM_SQL),
    "route_switches": (route_switches, ROUTE_SQL),
    "prefetched": (prefetched, PREFETCH_SQL),
    "stalls": (stalls, STALL_SQL),
    "serialized_operations": (serialized_operations, SERIAL_SQL),
    "captures": (captures, CAPTURE_SQL),
    "capture_reads": (capture_reads, CAPTURE_READS_SQL),
    "limits_run_out": (limits_run_out, LIMITS_SQL),
    "playback_targets": (playback_targets, TARGETS_SQL),
    "dedup_after_closing": (dedup_after_closing, CLOSING_SQL),
    "reads_of_chunks": (reads_of_chunks, READS_SQL),
}
