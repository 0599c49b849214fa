"""Streams that go quiet, that close keys, and sinks."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from lectern.streaming import live, timers


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="lectern-test-", dir="/tmp")


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_limits_run_out_while_the_stream_is_quiet(spark, folder):
    """A second stands for 30: limits of 1, 2, 3 and 10 seconds."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    limits = tuple(timers.Limit(x.name, x.ms // 30, x.arms, x.lifts) for x in timers.LIMITS)
    schema = "k int, i int, c string"
    rows = [(1, 0, "init"), (2, 0, "init"), (2, 1, "ready"), (3, 0, "recognize"), (3, 1, "progress"), (4, 0, "recognize"), (4, 1, "done"), (5, 0, "recognize"), (5, 1, "failed"), (6, 0, "other")]
    put(spark, folder, rows, schema)
    events = spark.readStream.schema(schema).parquet(f"{folder}/in")
    query = timers.watch_stream(events, "k", "c", "i", limits).writeStream.format("memory").queryName("run_out").option("checkpointLocation", f"{folder}/state").trigger(processingTime="500 milliseconds").start()
    want = {("1", "init"), ("2", "idle"), ("3", "recognize"), ("3", "stall"), ("4", "idle")}
    try:
        for _ in range(120):
            time.sleep(1)
            got = [(r.key, r.name) for r in spark.table("run_out").collect()]
            if len(got) >= len(want):
                break
        assert sorted(got) == sorted(want)
        put(spark, folder, [(1, 5, "recognize"), (1, 6, "done"), (1, 7, "init"), (1, 8, "ready")], schema)
        for _ in range(60):
            time.sleep(1)
            got = [(r.key, r.name) for r in spark.table("run_out").collect()]
            if len(got) > len(want):
                break
        assert sorted(got) == sorted([*want, ("1", "idle")])
    finally:
        query.stop()
        spark.conf.unset(provider)


def test_limits_in_batch(spark):
    rows = [(1, 0, "init"), (1, 29_999, "ready"), (2, 0, "init"), (2, 30_000, "ready"), (3, 0, "recognize"), (3, 50_000, "progress"), (3, 59_000, "done"), (4, 0, "recognize"), (4, 80_000, "progress"), (4, 100_000, "progress")]
    df = spark.createDataFrame(rows, "k int, at bigint, c string")
    got = sorted((r.k, r.name, r.armed_at, r.out_at) for r in timers.run_out(df, ["k"], ["at"], "at", "c").collect())
    assert got == [(1, "idle", 29_999, 329_999), (2, "idle", 30_000, 330_000), (2, "init", 0, 30_000), (3, "idle", 59_000, 359_000), (4, "recognize", 0, 60_000), (4, "stall", 100_000, 190_000)]
    assert timers.run_out(df.withColumn("u", F.lit(100_000)), ["k"], ["at"], "at", "c", until="u").count() == 2


def test_closed_keys_lose_their_state(spark, folder):
    schema = "k int, at bigint, source string"
    for rows in [[(1, 0, "A"), (1, 300, "B"), (2, 0, "A")], [(1, 310, None), (1, 350, "B"), (2, 350, "B")]]:
        put(spark, folder, rows, schema)
        query = live.dedup_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "k", "source", "at", 400, idle_ms=None)
        query = query.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        assert query.awaitTermination(90)
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=str)
    assert got == [(1, 0, "A"), (1, 310, None), (1, 350, "B"), (2, 0, "A")]


def test_latest_capture(spark, folder):
    schema = "k int, at timestamp, id string"
    stamp = lambda s: F.timestamp_seconds(F.lit(s))
    for i, (k, at, name) in enumerate([(1, 10, "a"), (1, 200, "b"), (2, 20, "c"), (9, 5000, "later")]):
        spark.range(1).select(F.lit(k).alias("k"), stamp(at).alias("at"), F.lit(name).alias("id")).write.mode("append").parquet(f"{folder}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    query = live.latest_capture(events, "k", "at").writeStream.outputMode("append").format("memory").queryName("captured").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert sorted((r.k, r.record.id) for r in spark.table("captured").collect()) == [(1, "b"), (2, "c")]


def test_speech_sink(spark, folder):
    schema = "speed double, query struct<prePhonemeLength:double,postPhonemeLength:double>"
    put(spark, folder, [(1.5, (0.0, 0.0)), (2.0, (1.0, 1.0))], schema)
    sent = []
    query = live.speech_sink(spark.readStream.schema(schema).parquet(f"{folder}/in"), lambda df, i: sent.extend(r.query.prePhonemeLength for r in df.collect()), f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert sorted(round(x, 6) for x in sent) == [0.15, 0.2]
