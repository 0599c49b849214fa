"""Block scans against plain folds, with keys that span many blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.streaming import scans


def dedup(rows, window):
    last, out = None, []
    for at, source in rows:
        if at is None or source is None:
            last = None
            out.append(True)
        elif last is not None and last[1] != source and at - last[0] < window:
            out.append(False)
        else:
            last = (at, source)
            out.append(True)
    return out


def queue(rows, most):
    waits, out = 0, []
    for arrives in rows:
        if arrives:
            out.append("accepted" if waits < most else "rejected")
            waits = min(waits + 1, most)
        else:
            out.append("done")
            waits = max(waits - 1, 0)
    return out


def by_blocks(machine, key, columns, size):
    """The machine over blocks of a size, as scan does it, without Spark."""
    out, carried, state, n, before = [], False, None, len(key), object()
    for b in range(0, n, size):
        own = key[b : b + size]
        run = np.cumsum([0] + [x != y for x, y in zip(own, own[1:])])
        block = machine.prepare(run, *(c.slice(b, size) for c in columns))
        carried = own[0] == before
        out += machine.apply(block, carried, state if carried else None).to_pylist()
        state = machine.follow(machine.table(block), state if carried else None) if own[0] == own[-1] else machine.end(block)
        before = own[-1]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_machines_over_blocks(seed):
    draw = random.Random(seed)
    key, ats, sources, arrives = [], [], [], []
    for k in range(draw.randrange(1, 5)):
        at = 0
        for _ in range(draw.choice([1, 3, 40, 200])):
            at += draw.choice([0, 0, 1, 3, draw.randrange(30)])
            key.append(k)
            ats.append(None if draw.random() < 0.02 and not ats else at)
            sources.append(draw.choice(["a", "b", "b", "c"] + [None] * (seed % 2)))
            arrives.append(draw.choice([True, True, False, None]))
    for window in (0, 7, 25, 1000):
        want = [x for k in sorted(set(key)) for x in dedup([(a, s) for o, a, s in zip(key, ats, sources) if o == k], window)]
        for size in (1, 2, 7, 64, 10_000):
            assert by_blocks(scans.Dedup(window), key, [pa.array(ats, pa.int64()), pa.array(sources, pa.string())], size) == want
    for most in (0, 1, 3, 50):
        want = [x for k in sorted(set(key)) for x in queue([a for o, a in zip(key, arrives) if o == k], most)]
        for size in (1, 2, 7, 64, 10_000):
            assert by_blocks(scans.Queue(most), key, [pa.array(arrives, pa.bool_())], size) == want


def test_scan_of_a_hot_key(spark):
    draw, rows = random.Random(1), []
    for i in range(4000):
        rows.append((None if i % 50 == 0 else 7 if i % 3 else draw.randrange(9), i // 2, draw.choice("ab"), i, draw.random() < 0.6, "kept"))
    df = spark.createDataFrame(rows, "k int, at bigint, source string, i int, arrives boolean, more string").repartition(5)
    got = {r.i: r.ok for r in scans.scan(df, ["k"], ["at", "i"], ["at", "source"], scans.Dedup(5), "ok", block_bits=6).collect()}
    said = {r.i: r.queue for r in scans.scan(df, ["k"], ["at", "i"], ["arrives"], scans.Queue(3), "queue", block_bits=6).select("i", "queue", "more").collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        assert [got[r[3]] for r in own] == dedup([(r[1], r[2]) for r in own], 5)
        assert [said[r[3]] for r in own] == queue([r[4] for r in own], 3)
    assert scans.scan(df.limit(0), ["k"], ["i"], ["arrives"], scans.Queue(3), "queue").count() == 0
    blocks = df.select(F.lit(1)).count() >> 6
    assert blocks > 50
