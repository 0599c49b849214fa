"""State machines over ordered rows whose keys are split over tasks.

Rows are sorted over all keys by ranges and cut into blocks, so a key with most of the rows lies in
many blocks. What a block does to the state that comes in is a function that can be written down
in a small table. Blocks yield their tables at once; for each key that lies in several blocks the
tables are followed one after another, a step a block; then all blocks are run again with the state
that comes in. Within a block everything is arrays: rows are never visited one by one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep

#: Rows of a block, as a power of two.
BLOCK_BITS = 16


def last_of(step: np.ndarray) -> np.ndarray:
    """Where each place ends if it is followed along step, whose ends lead to themselves."""
    for _ in range(len(step).bit_length()):
        step = step[step]
    return step


def visited(step: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places are met from the starts along step; places beyond the last are no places."""
    n = len(step)
    jump, met = np.append(step, n), np.zeros(n + 1, bool)
    met[starts] = True
    for _ in range(n.bit_length()):
        met[jump[met.nonzero()[0]]] = True
        jump = jump[jump]
    return met[:n]


class Dedup:
    """Rows (at, source) are accepted unless the last accepted row came from another source less than `window` before.

    Rows without a time or a source are accepted, and so is what follows them. A state is (at, source) of
    the last accepted row, or None.
    """

    kind = pa.bool_()

    def __init__(self, window: int):
        self.window = window

    def _next(self, run: np.ndarray, at: np.ndarray, source: np.ndarray, free: np.ndarray) -> np.ndarray:
        """For each row, the next that is accepted if it is itself; the number of rows if there is none in its run."""
        n = len(run)
        end = np.searchsorted(run, run, "right")
        code = run * (int(source.max(initial=0)) + 1) + source
        order = np.argsort(code, kind="stable")
        same = np.full(n, n)
        alike = code[order[1:]] == code[order[:-1]]
        same[order[:-1][alike]] = order[1:][alike]
        span = int(at.max() - at.min()) + self.window + 1
        if span * (int(run[-1]) + 1) < 1 << 62:
            placed = at - at.min() + run * span
            late = np.searchsorted(placed, placed + self.window)
        else:
            begin = np.searchsorted(run, run)
            late = np.concatenate([b + np.searchsorted(at[b:e], at[b:e] + self.window) for b, e in sorted(set(zip(begin.tolist(), end.tolist(), strict=True)))])
        frees = np.append(np.flatnonzero(free), n)
        unasked = frees[np.searchsorted(frees, np.arange(1, n + 1))]  # the next free row
        after = np.arange(1, n + 1)
        found = np.where(free, after, np.minimum(np.minimum(same, np.maximum(late, after)), unasked))
        return np.where(found < end, found, n)

    def prepare(self, run: np.ndarray, at: pa.Array, source: pa.Array) -> tuple:
        free = np.asarray(pc.or_(pc.is_null(at), pc.is_null(source)))
        first = pc.min(at).as_py() or 0
        time = np.asarray(pc.fill_null(at, first)).astype(np.int64)
        time = np.where(np.asarray(pc.is_null(at)), first, time)
        names = source.cast(pa.string()).dictionary_encode()
        number = np.asarray(pc.fill_null(names.indices, len(names.dictionary))).astype(np.int64)
        return run, time, number, free, names.dictionary.to_pylist(), self._next(run, time, number, free)

    def _state(self, block: tuple, i: int) -> tuple | None:
        _, at, number, free, names, _ = block
        return None if free[i] else (int(at[i]), names[number[i]])

    def table(self, block: tuple) -> Any:
        """Of the first run: parts of it in which the first accepted row leads to one end, and the part of each source's first row."""
        run, at, number, free, names, step = block
        n = int(np.searchsorted(run, run[0], "right"))
        end = last_of(np.where(step[:n] < n, step[:n], np.arange(n)))
        begins = np.flatnonzero(np.diff(end, prepend=-1))
        first_free = int(np.argmax(free[:n])) if free[:n].any() else n
        first = {names[c]: min(int(i), first_free) for c, i in zip(*np.unique(number[:n], return_index=True), strict=True) if c < len(names)}
        part = lambda i: int(np.searchsorted(begins, i, "right")) - 1 if i < n else len(begins)
        return at[begins[1:] - 1], int(at[n - 1]), [self._state(block, e) for e in end[begins].tolist()], {s: part(i) for s, i in first.items()}, part(first_free)

    def follow(self, table: Any, state: tuple | None) -> tuple | None:
        bounds, last, ends, parts, other = table
        if state is None:
            return ends[0]
        limit = state[0] + self.window
        part = min(int(np.searchsorted(bounds, limit)) if last >= limit else len(ends), parts.get(state[1], other))
        return state if part == len(ends) else ends[part]

    def end(self, block: tuple) -> tuple | None:
        """The state after the last run, which begins in the block."""
        run, step = block[0], block[5]
        b = int(np.searchsorted(run, run[-1]))
        own = step[b:]
        return self._state(block, b + int(last_of(np.where(own < len(run), own - b, np.arange(len(own))))[0]))

    def apply(self, block: tuple, carried: bool, state: tuple | None) -> pa.Array:
        run, at, number, free, names, step = block
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        if carried and state is not None:
            n = int(np.searchsorted(run, run[0], "right"))
            known = names.index(state[1]) if state[1] in names else -1
            entry = np.flatnonzero((number[:n] == known) | free[:n] | (at[:n] >= state[0] + self.window))
            starts = np.concatenate([entry[:1], starts[1:]])
        return pa.array(visited(step, starts))


class Queue:
    """At most `most` wait: arrivals are accepted while fewer do, other rows take one away. A state is how many wait.

    Every row holds a number within bounds after a step; such functions stay of their kind when one
    follows another, so those of all beginnings of a run come from doubling the rows they span.
    """

    kind = pa.string()

    def __init__(self, most: int):
        self.most = most

    def prepare(self, run: np.ndarray, arrives: pa.Array) -> tuple:
        arrival = np.asarray(pc.fill_null(arrives, False))
        n = len(run)
        add, low, high = np.where(arrival, 1, -1), np.zeros(n, np.int64), np.full(n, self.most)
        begin = np.searchsorted(run, run)
        span = 1
        while span < n:
            later = np.flatnonzero(np.arange(n) - span >= begin)
            before = later - span
            held = lambda x, later=later: np.minimum(high[later], np.maximum(low[later], x + add[later]))
            new_low, new_high, new_add = held(low[before]), held(high[before]), add[before] + add[later]
            low[later], high[later], add[later] = new_low, new_high, new_add
            span *= 2
        return run, arrival, add, low, high

    def table(self, block: tuple) -> Any:
        run, _, add, low, high = block
        n = int(np.searchsorted(run, run[0], "right")) - 1
        return int(add[n]), int(low[n]), int(high[n])

    def follow(self, table: Any, state: int | None) -> int:
        add, low, high = table
        return min(high, max(low, (state or 0) + add))

    def end(self, block: tuple) -> int:
        return self.follow((int(block[2][-1]), int(block[3][-1]), int(block[4][-1])), 0)

    def apply(self, block: tuple, carried: bool, state: int | None) -> pa.Array:
        run, arrival, add, low, high = block
        began = np.where(run == run[0], (state or 0) if carried else 0, 0)
        after = np.minimum(high, np.maximum(low, began + add))
        same = np.concatenate([[False], run[1:] == run[:-1]])
        before = np.where(same, np.concatenate([[0], after[:-1]]), began)
        return pa.array(np.where(~arrival, "done", np.where(before < self.most, "accepted", "rejected")).astype(object), pa.string())


def _runs(key: pa.Array) -> np.ndarray:
    """Number of the run of equal keys that each row lies in."""
    key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
    return np.concatenate([[0], np.cumsum(np.asarray(pc.not_equal(key[1:], key[:-1])))]).astype(np.int64)


def scan(events: DataFrame, keys: list[str], order: list[str], uses: list[str], machine: Any, name: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """events with `name`: what the machine says of each row of a key in order, after the rows before it.

    Nulls are a key like others; rows that the order doesn't tell apart keep some order of theirs.
    An empty table stays empty.
    """
    numbered = events.withColumn("__key", F.to_json(F.struct(*keys)))
    dealt = numbered.repartitionByRange("__key", *order).sortWithinPartitions("__key", *order).withColumn("__seq", F.monotonically_increasing_id())
    rows = keep(dealt.withColumn("__block", F.shiftright("__seq", block_bits)), "sorted")  # the numbers stay as they are written
    column = lambda table, c: table.column(c).combine_chunks()

    def block_of(table: pa.Table) -> tuple:
        return machine.prepare(_runs(table.column("__key")), *(column(table, c) for c in uses))

    def tables(table: pa.Table) -> pa.Table:
        table = table.sort_by("__seq")
        block, ends, number = block_of(table), [table.column("__key")[i].as_py() for i in (0, -1)], table.column("__block")[0].as_py()
        made = [(ends[0], number, True, pickle.dumps(machine.table(block)))]
        if ends[1] != ends[0]:
            made.append((ends[1], number, False, pickle.dumps(machine.end(block))))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.binary())
        return pa.Table.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["__key", "__block", "whole", "data"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, known = None, None, False
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            for own, number, whole, data in zip(*(batch.column(c).to_pylist() for c in ("__key", "__block", "whole", "data")), strict=True):
                if own != key or not whole:
                    key, state, known = own, None, False
                if whole:
                    if known:
                        out.append((number, pickle.dumps(state)))
                    state = machine.follow(pickle.loads(data), state)
                else:
                    state = pickle.loads(data)
                known = True
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["__block", "state"])

    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in (*table.schema, pa.field(name, machine.kind))], names=[*table.schema.names, name])
        table = table.sort_by("__seq")
        state = pickle.loads(states.column("state")[0].as_py()) if states.num_rows else None
        return table.append_column(name, machine.apply(block_of(table), states.num_rows > 0, state))

    needed = rows.select("__key", "__seq", "__block", *dict.fromkeys(uses))
    chain = needed.groupBy("__block").applyInArrow(tables, "__key string, __block bigint, whole boolean, data binary")
    chain = chain.repartition("__key").sortWithinPartitions("__key", "__block", F.col("whole").desc())
    states = chain.mapInArrow(carry, "__block bigint, state binary")
    schema = rows.withColumn(name, F.lit(None).cast("boolean" if machine.kind == pa.bool_() else "string")).schema
    return rows.groupBy("__block").cogroup(states.groupBy("__block")).applyInArrow(run, schema).drop("__key", "__seq", "__block")
