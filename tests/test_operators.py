"""Folds, votes, geometry, kernels and checks on small fixtures."""

import random
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import geometry as G
from lectern.operators import kernels as K
from lectern.operators import recognition as R
from lectern.operators import statistics as St
from lectern.operators import validation as V
from lectern.streaming import folds, live


def test_dedup_is_a_fold_not_a_lag(spark):
    rows = spark.createDataFrame([(1, 0, "A", 0), (1, 300, "B", 1), (1, 350, "B", 2), (1, 900, "B", 3)], "k int, at bigint, source string, i int")
    out = folds.cross_source_dedup(rows, "k", F.col("at"), "source", "i", 400).orderBy("i").collect()
    assert [r.accepted for r in out] == [True, False, False, True]


def test_queue_and_playback(spark):
    rows = spark.createDataFrame([(1, i, True) for i in range(4)], "k int, i int, arrives boolean")
    assert [r.queue for r in folds.bounded_queue(rows, ["k"], ["i"], "arrives").orderBy("i").collect()] == ["accepted"] * 3 + ["rejected"]
    commands = ["enqueue", "error", "finish", "enqueue", "finish", "enqueue", "stop"]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(commands)], "k int, i int, c string")
    assert [r.status for r in folds.playback(rows, ["k"], ["i"], "c").orderBy("i").collect()] == ["STARTED", "ERROR", "IDLE", "STARTED", "ENDED", "STARTED", "STOPPED"]
    commands = ["enqueue", "enqueue", "enqueue", "error", "finish", "finish", "enqueue", "enqueue", "stop", "error"]  # a failed text takes the others with it no more
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(commands)], "k int, i int, c string")
    assert [r.status for r in folds.playback(rows, ["k"], ["i"], "c").orderBy("i").collect()] == ["STARTED", "QUEUED", "QUEUED", "ERROR,STARTED", "STARTED", "ENDED", "STARTED", "QUEUED", "STOPPED", "IDLE"]


def test_prefetch_and_claim(spark):
    rows = spark.createDataFrame([(1, i, "enqueue") for i in range(10)] + [(1, 10, "finish")], "k int, i int, c string")
    made = [r.synthesized for r in folds.prefetched(rows, ["k"], ["i"], "c").orderBy("i").collect()]
    assert made[9] == 2 and made[10] == 3
    assert [r.should_show for r in folds.first_claim(rows, ["k"], ["i"]).orderBy("i").collect()] == [True] + [False] * 10


def test_dedup_stream(spark):
    folder = tempfile.mkdtemp(prefix="lectern-test-", dir="/tmp")
    schema = "k int, at bigint, source string"
    for i, rows in enumerate([[(1, 0, "A"), (1, 300, "B")], [(1, 350, "B"), (1, 900, "B"), (2, 10, "B")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = live.dedup_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "k", "source", "at", 400, idle_ms=None)
        query = query.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        assert query.awaitTermination(90)
        assert i in (0, 1)
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == [(1, 0, "A"), (1, 900, "B"), (2, 10, "B")]
    shutil.rmtree(folder, ignore_errors=True)


def test_pauses(spark):
    df = spark.createDataFrame([(1.5, (0.0, 0.0))], "speed double, query struct<prePhonemeLength:double,postPhonemeLength:double>")
    assert abs(live.with_pauses(df).first().query.prePhonemeLength - 0.15) < 1e-12


def test_fuse(spark):
    rows = [(1, 0, 0, "校", 60), (1, 0, 1, "核", 90), (1, 0, 2, "核", 92), (1, 1, 0, "校", 80), (1, 1, 1, "核", 80), (1, 2, 0, "あ", 10), (1, 2, 1, "核", 90)]
    got = R.fuse(spark.createDataFrame(rows, "image int, pos int, variant int, char string, confidence int"), ["image"]).orderBy("pos").collect()
    assert [r.char for r in got] == ["核", "校", "あ"]


def test_dictionary(spark):
    text = {0: "條恨鎌", 1: "悔恨鎌", 2: "悔恨鎌", 3: "海恨鎌"}
    rows = [(1, p, v, c, 50) for v, s in text.items() for p, c in enumerate(s)]
    symbols = spark.createDataFrame(rows, "image int, pos bigint, variant int, char string, confidence int")
    words = spark.createDataFrame([("悔恨",), ("覚悟",)], "word string")
    chosen = R.choose_windows(R.dictionary_candidates(symbols, ["image"], words), ["image"]).collect()
    assert [(r.start, r.len, r.word) for r in chosen] == [(0, 2, "悔恨")]
    assert R.dictionary_candidates(symbols, ["image"], words.limit(0)).count() == 0


def test_substitute_and_ruby(spark):
    df = spark.createDataFrame([("鯨幕が", [(0, 2, "くじらまく"), (1, 1, "x")])], "t string, s array<struct<start:int,len:int,word:string>>")
    assert df.select(R.substitute(F.col("t"), F.col("s")).alias("r")).first().r == "鯨xが"
    df = spark.createDataFrame([(["鯨", "幕"],)], "c array<string>")
    run = df.select(R.ruby_run(F.col("c"), F.lit(0.0), F.lit(20.0), F.lit(0.0), F.lit(20.0), F.lit("くじらまく")).alias("r")).first().r
    assert (run.start, run.len) == (0, 2)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_align():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        distance, pairs = R.align(a, b)
        assert distance == edit_distance(a, b)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs)
        assert distance == sum(a[i] != b[j] for i, j in pairs) + len(a) + len(b) - 2 * len(pairs)
    assert R.align("", "") == (0, [])


def test_medians(spark):
    rows = spark.createDataFrame([(1, 4), (1, 1), (1, 3), (1, 2)], "k int, v int")
    assert St.upper_median(rows, ["k"], "v").first().median == 3
    assert St.weighted_upper_median(rows.withColumn("w", F.lit(0)).where("v < 3"), ["k"], "v", "w").count() == 0


def test_otsu_agrees_with_kernel(spark):
    rng = np.random.default_rng(1)
    lum = np.concatenate([rng.integers(20, 60, 300), rng.integers(150, 220, 700)])
    counts = spark.createDataFrame([(1, int(v)) for v in lum], "k int, bin int").groupBy("k", "bin").count()
    assert St.otsu(counts, ["k"]).first().threshold == K.otsu(lum)


def test_kernels():
    image = np.full((20, 60, 3), 250, np.uint8)
    image[8:12, 5:55:2] = 10
    assert K.pad(image, 4).shape == (28, 68, 3) and (K.pad(image, 4)[0, 0] == 250).all()
    assert K.scale(image, 2.0).shape == (40, 120, 3) and (K.scale(image, 1.0) == image).all()
    assert set(np.unique(K.binarize(image))) == {0, 255}
    assert (K.binarize(np.full((5, 5, 3), 9, np.uint8)) == 9).all()
    assert K.orientation(image) == ("horizontal", True) and K.orientation(image.transpose(1, 0, 2))[0] == "vertical"
    page = np.full((60, 150, 3), 250, np.uint8)  # several lines on a wide page: the sides don't decide
    page[::6, 10:140], page[1::6, 10:140] = 10, 10
    assert K.bands(np.array([0, 2, 1, 0, 3, 0, 0, 1])) == (3, 2, 3) and K.bands(np.zeros(4)) == (0, 0, 0)
    assert K.orientation(page) == ("horizontal", True) and K.orientation(page.transpose(1, 0, 2)) == ("vertical", True)
    blank = np.full((40, 200, 3), 250, np.uint8)
    assert K.orientation(blank) == ("horizontal", True) and K.orientation(blank.transpose(1, 0, 2)) == ("horizontal", True)
    assert K.square_icon(image).shape == (64, 64, 3)


def test_range_join_makes_each_pair_once(spark):
    rng = random.Random(5)
    make = lambda n: [(i, tuple(float(v) for v in (x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 90)))) for i in range(n) for x, y in [(rng.randrange(-50, 300), rng.randrange(-50, 300))]]
    left, right = make(60), make(40)
    kind = "struct<left:double,top:double,right:double,bottom:double>"
    got = G.range_join(spark.createDataFrame(left, f"i int, a {kind}"), spark.createDataFrame(right, f"j int, b {kind}"), "a", "b", 40.0)
    want = sorted((i, j) for i, a in left for j, b in right if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3])
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_settings_and_versions(spark):
    raw = {"speakerId": F.lit("-5"), "speedScale": F.lit(99.0), "pitchScale": F.lit(-99.0), "intonationScale": F.lit("x"), "volumeScale": F.lit(float("nan")), "pauseLengthScale": F.lit(None).cast("double")}
    s = spark.range(1).select(V.sanitized(raw).alias("s")).first().s
    assert (s.speakerId, s.speedScale, s.pitchScale, s.intonationScale, s.volumeScale, s.pauseLengthScale) == (1, 2.0, -0.15, 1.0, 1.0, 1.0)
    versions = spark.createDataFrame([("1.4.0", "1.4.1"), ("1.10", "1.9"), ("1.4", "1.4.0")], "a string, b string")
    assert [r.x for r in versions.select(V.version_before(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


def test_texts_wav_and_password(spark):
    df = spark.createDataFrame([(["abc", "", None],), (["x" * 200_001],), ([],)], "t array<string>")
    assert [r.q for r in df.select(V.queue_texts(F.col("t")).alias("q")).collect()] == [["abc"], None, None]
    wav = spark.createDataFrame([(bytearray(b"RIFF0000WAVE"),), (bytearray(b"not audio"),), (None,)], "c binary")
    assert [r.w for r in wav.select(V.is_wav(F.col("c")).alias("w")).collect()] == [True, False, False]
    sel = spark.createDataFrame([("password", "secret"), ("text", "normal text")], "k string, v string")
    assert [r.s for r in sel.select(V.selected_text(F.col("k"), F.col("v"), F.lit(0), F.lit(6)).alias("s")).collect()] == ["", "normal"]


def test_speakers(spark):
    raw = '[{"name":"","styles":[]},{"name":"Valid","styles":[{"id":1,"name":"n"},{"id":-2}]}]'
    df = spark.createDataFrame([(raw,), ("[]",), (None,)], "raw string").select(V.speakers(F.col("raw")).alias("s")).collect()
    assert [s.name for s in df[0].s] == ["Valid"] and [x.id for x in df[0].s[0].styles] == [1]
    assert df[1].s is None and df[2].s is None


def test_versions_of_any_length(spark):
    pairs = [("1.4.0", "1.4.1", True), ("1.4.1", "1.4.1", False), ("1.2.3.4.5", "1.2.3.4.6", True), ("1.2.3.4.6", "1.2.3.4.5.9", False), ("", "0.0.0.0.1", True), (None, "1", True), ("1.4", "1.4.0.0.0", False), ("a.b", "0", False), ("10", "9.9", False)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r.x for r in rows.select(V.version_before(F.col("a"), F.col("b")).alias("x")).collect()] == [x for _, _, x in pairs]


def test_folds_carry_their_state(spark):
    """Batches smaller than a key's rows, and queues that no day's end empties."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.createDataFrame([(k, i, c) for k in (1, 2) for i, c in enumerate("++++-+--+-")], "k int, i int, c string").withColumn("arrives", F.col("c") == "+")
    got = folds.bounded_queue(rows, ["k"], ["i"], "arrives", 2).orderBy("k", "i").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = ["accepted", "accepted", "rejected", "rejected", "done", "accepted", "done", "done", "accepted", "done"]
    assert [r.queue for r in got] == one * 2


def test_operations_run_one_after_another(spark):
    rows = spark.createDataFrame([(1, 0, 10), (2, 5, 10), (3, 50, 5), (4, 51, 1), (5, 52, 0)], "i int, at int, takes int").withColumn("k", F.lit(1))
    got = folds.serialized(rows, ["k"], ["i"], "at", "takes", F.col("i") == 2).orderBy("i").collect()
    assert [(r.started, r.ended, r.outcome) for r in got] == [(0, 10, "done"), (10, 20, "failed"), (50, 55, "done"), (55, 56, "done"), (56, 56, "done")]


def test_routes_are_carried_over_ranges(spark):
    rows = spark.createDataFrame([(i, i // 3, t) for i, t in enumerate("aabbbcccaab")], "i int, part int, t string").where("part != 1").withColumn("c", F.lit(1))
    got = [r.stopped for r in folds.route(rows, ["c"], ["i"], "t", F.col("part")).orderBy("i").collect()]
    seen = [t for i, t in enumerate("aabbbcccaab") if i // 3 != 1]
    assert got == [None] + [a if a != b else None for a, b in zip(seen, seen[1:])]


def test_crops_and_offsets(spark):
    image = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    assert (K.crop(image, 1, 2, 2, 3) == image[2:5, 1:3]).all() and K.crop(image, 3, 4, 9, 9).shape == (1, 1, 3)
    up = K.scale(K.crop(image, 0, 0, 2, 2), 2.0)
    assert up.shape == (4, 4, 3) and (up[0, 0] == image[0, 0]).all() and (up[-1, -1] == image[1, 1]).all()


def test_reencoding():
    import zlib

    def decoded(png):
        at, body = 8, b""
        while at < len(png):
            n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
            data = png[at + 8 : at + 8 + n]
            assert int.from_bytes(png[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + data)
            if kind == b"IHDR":
                w, h = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
            body += data if kind == b"IDAT" else b""
            at += 12 + n
        raw = zlib.decompress(body)
        rows, above = [], np.zeros(w * 3, np.uint8)
        for y in range(h):
            way, line = raw[y * (w * 3 + 1)], np.frombuffer(raw, np.uint8, w * 3, y * (w * 3 + 1) + 1).copy()
            if way == 1:
                line = np.cumsum(line.reshape(w, 3), axis=0, dtype=np.uint8).ravel()
            elif way == 2:
                line = line + above
            rows.append(line)
            above = line
        return np.array(rows).reshape(h, w, 3)

    draw = np.random.default_rng(3)
    for image in (draw.integers(0, 256, (40, 60, 3)).astype(np.uint8), np.full((9, 1, 3), 7, np.uint8), np.tile(np.arange(50, dtype=np.uint8)[:, None, None], (1, 30, 3))):
        assert (decoded(K.encode_png(image)) == image).all()
        for most in (10_000, 3000, 600):
            made = K.encode_within(image, most)
            if made is not None:
                assert K.data_url_size(made[1]) <= most and (decoded(made[1]) == made[0]).all()
    assert K.encode_within(draw.integers(0, 256, (40, 60, 3)).astype(np.uint8), 40) is None
    assert K.encode_within(draw.integers(0, 256, (40, 60, 3)).astype(np.uint8), 3000)[0].shape[0] < 40


def test_lexicon_and_icons(spark):
    lines = spark.createDataFrame([("覚悟",), ("",), (" ",), ("鎌倉 ",), ("覚悟",)], "line string")
    assert sorted(r.word for r in V.lexicon(lines, "line").collect()) == ["覚悟", "鎌倉"]
    assert V.lexicon(lines, "line", most=10).count() == 0 and V.lexicon(lines.limit(0), "line").count() == 0
    sizes = spark.createDataFrame([("20",), ("5",), ("99",), ("x",), (None,), ("NaN",)], "v string").select(V.icon_size(F.col("v")).alias("s"))
    assert [r.s for r in sizes.collect()] == [20.0, 16.0, 64.0, 16.0, 16.0, 16.0]


def test_alignment_takes_little_memory():
    import tracemalloc

    rng = random.Random(4)
    a = "".join(rng.choice("abcd") for _ in range(20_000))
    b = "".join(c for c in a if rng.random() > 0.02)
    tracemalloc.start()
    distance, pairs = R.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert distance == len(a) - len(b) and len(pairs) >= len(b) - 50 and peak < 100 << 20
    assert all(x < y and i < j for (x, i), (y, j) in zip(pairs, pairs[1:]))


def test_queued_texts_count_characters(spark):
    most = V.MAX_TEXT
    rows = [[["a" * most]], [["a" * most, "b"]], [["あ" * most]], [["あ" * most, " ", None]], [["あ" * (most + 1)]], [["😀" * most]], [["😀" * most, "a"]], [["é" + "a" * (most - 1)]], [["é" + "a" * most]], [[]], [None]]
    df = spark.createDataFrame(rows, "t array<string>").select(F.size(F.coalesce(V.queue_texts(F.col("t")), F.array())).alias("n"))
    assert [r.n for r in df.collect()] == [1, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0]


def test_payloads_of_a_small_file_are_dealt(spark, tmp_path):
    from lectern.plans.check_queries import payload_checks

    orders = spark.range(40_000).selectExpr("id AS o_orderkey", "id % 500 AS o_custkey", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions() == 1
    assert payload_checks(spark, str(tmp_path)).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ["rect_range_join", "clipped_rects"])
def test_equal_rectangles_are_joined_once(spark, tmp_path, monkeypatch, name):
    import duckdb

    from lectern.plans import catalog

    spark.range(600).selectExpr("id % 120 + 28500 * (id div 120) AS p_partkey", "'p' AS p_name", "CAST(id % 120 % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(160).selectExpr("id % 40 + 22100 * (id div 40) AS s_suppkey", "CAST(id % 40 % 25 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    join, seen = G.range_join, []
    monkeypatch.setattr(G, "range_join", lambda left, right, *more: seen.append((left.count(), right.count())) or join(left, right, *more))
    query, sql = catalog.QUERIES[name]
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, query(spark, str(tmp_path)).select(*names).collect())) == want and want
    assert seen == [(120, 40)]


def test_ruby_lines_are_dealt_once(spark, sf):
    from lectern.plans import catalog

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = catalog.QUERIES["ruby_lines"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning") <= 2
