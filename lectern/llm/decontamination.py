"""Benchmark decontamination with suffix arrays of the training text.

Spark deals the documents to tasks. A task turns each few MB of them into one shard: the words
as ids of the test vocabulary (0: a word that no test item has) and the suffix array over the
shard's positions. Every distinct start of a test suffix is binary-searched in each shard's array;
its interval gives all verbatim places, and a binary search among the test suffixes with that start
extends each place to its longest match. Nothing is shuffled, and each document's row depends on
that document and the test set alone, so a lost task is simply run again.

Two things keep the array small without losing a place: words outside the test vocabulary
cannot be part of a match, so a suffix is listed only if its first `shortest window` words are
all test words; and suffixes are ordered by their first `window` words, the depth that the
search compares.

Items of equal text are one text with several names, and windows of equal words one window with
several texts, so a place of a document is found once however many items share its words. What a
task holds is bounded by the words of its documents and of the test block; the names of the items of a document are
written out as they come up.

A test set of more than TEST_BLOCK_WORDS words is broadcast in blocks. One block is searched
after another: the places that it adds are written to the shared folder before the next one starts, so a
task never holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, keep
from .common import bound_batches, col, pieces, slices, words_of

#: Words of a window; an item with fewer words (but some) is one window.
WINDOW = 10
#: Words of a block of the test set (six bytes each), which is what one search holds.
TEST_BLOCK_WORDS = 2_000_000
#: Names of items in a batch that leaves a task.
NAMES = 200_000


def suffix_ranks(ids: np.ndarray) -> np.ndarray:
    """Rank of each suffix of a sequence by prefix doubling."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < len(ids) and rank.max(initial=0) < len(ids) - 1:
        after = np.concatenate([rank[span:] + 1, np.zeros(min(span, len(rank)), np.int64)])
        rank = np.unique(rank * (len(ids) + 2) + after, return_inverse=True)[1].astype(np.int64)
        span *= 2
    return rank


@dataclass
class TestSet:
    """A block of test items: the words of their distinct texts as ids, their distinct windows, and their suffixes."""

    vocab: dict[bytes, int]
    ids: np.ndarray  # words of all texts, each text followed by a 0
    begins: np.ndarray  # first word of each text
    names: list[list[str]]  # the item_ids of each text, sorted
    starts: np.ndarray  # a place of each distinct window
    lengths: np.ndarray  # words of each distinct window
    text_of: np.ndarray  # texts of the windows, one window after another
    texts: np.ndarray  # where those of each window begin
    suffixes: np.ndarray  # places from which whole windows start, by what follows them
    low: np.ndarray  # the suffixes that start with each window; none of a short item's
    high: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, bytes | None]], window: int) -> TestSet:
        named: dict[bytes, list[str]] = {}
        for name, text in rows:
            words = words_of(text)
            if words and name is not None:
                named.setdefault(b" ".join(words), []).append(str(name))
        held = sorted((sorted(set(n)), t.split()) for t, n in named.items())
        vocab: dict[bytes, int] = {}
        ids: list[int] = []
        begins = np.zeros(len(held) + 1, np.int64)
        for i, (_, words) in enumerate(held):
            ids += [vocab.setdefault(w, len(vocab) + 1) for w in words]
            ids.append(0)
            begins[i + 1] = len(ids)
        flat = np.array(ids, np.int64)
        n = np.diff(begins) - 1
        size = np.minimum(window, n)
        count = n - size + 1
        text = np.repeat(np.arange(len(held)), count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begins[:-1][text]
        padded = np.concatenate([flat, np.zeros(window, np.int64)])
        words = padded[place[:, None] + np.arange(window)].astype(np.int32)
        words[np.arange(window) >= size[text][:, None]] = 0  # an item's only window ends with it
        _, first, kind = np.unique(np.ascontiguousarray(words).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(kind.astype(np.int64) * max(1, len(held)) + text)
        texts = np.searchsorted(pairs, np.arange(len(first) + 1) * max(1, len(held)))
        ranks = suffix_ranks(np.where(flat == 0, np.searchsorted(begins, np.arange(len(flat)), "right"), flat + len(held) + 1))
        whole = np.flatnonzero(size[text] == window)
        order = whole[np.argsort(ranks[place[whole]])]
        low, high = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        if len(order):
            edge = np.flatnonzero(np.diff(kind[order], prepend=-1))  # suffixes with one start stand together
            low[kind[order][edge]], high[kind[order][edge]] = edge, np.append(edge[1:], len(order))
        return cls(vocab, flat, begins[:-1], [h[0] for h in held], place[first], size[text][first], pairs % max(1, len(held)), texts, place[order], low, high)

    def names_of(self, windows: np.ndarray) -> set[str]:
        """Names of the items in which one of the windows occurs."""
        texts = np.unique(np.concatenate([self.text_of[self.texts[w] : self.texts[w + 1]] for w in windows]))
        return {name for t in texts.tolist() for name in self.names[t]}


def _keys(ids: np.ndarray, at: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The `depth` ids from each position, packed into as few uint64 columns as they need."""
    per = 64 // bits
    columns = []
    for first in range(0, depth, per):
        key = np.zeros(len(at), np.uint64)
        for j in range(first, first + per):
            key = (key << np.uint64(bits)) | (ids[at + j].astype(np.uint64) if j < depth else np.uint64(0))
        columns.append(key)
    return columns


def _as_text(columns: list[np.ndarray]) -> np.ndarray:
    """Packed columns as byte strings, whose order is that of the columns."""
    return np.stack(columns, axis=1).astype(">u8").view(f"S{8 * len(columns)}").ravel()


class Shard:
    """The suffix array of one shard of training text."""

    def __init__(self, docs: list[list[bytes]], vocab: dict[bytes, int], shortest: int, depth: int):
        self.depth = depth
        self.bits = max(1, int(len(vocab)).bit_length())
        counts = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        self.first = np.concatenate([[0], np.cumsum(counts + 1)])  # a 0 ends each document
        self.ids = np.zeros(self.first[-1] + depth, np.int64)
        get = vocab.get
        for words, at in zip(docs, self.first, strict=False):
            self.ids[at : at + len(words)] = [get(w, 0) for w in words]
        gaps = np.concatenate([[0], np.cumsum(self.ids == 0)])
        n = self.first[-1]
        at = np.nonzero(gaps[shortest : n + shortest] == gaps[:n])[0] if n else np.empty(0, np.int64)
        columns = _keys(self.ids, at, depth, self.bits)
        order = np.lexsort(columns[::-1])
        self.suffixes = at[order]
        self.keys = _as_text([c[order] for c in columns]) if len(at) else np.empty(0, f"S{8 * len(columns)}")

    def search(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct test window the interval [low, high) of the suffixes that start with it."""
        low, high = np.empty(len(test.starts), np.int64), np.empty(len(test.starts), np.int64)
        padded = np.concatenate([test.ids, np.zeros(self.depth, np.int64)])
        for size in np.unique(test.lengths):
            which = np.nonzero(test.lengths == size)[0]
            words = padded[test.starts[which][:, None] + np.arange(self.depth)]
            words[:, size:] = 0
            flat, at = words.ravel(), np.arange(len(which)) * self.depth
            low[which] = np.searchsorted(self.keys, _as_text(_keys(flat, at, self.depth, self.bits)), "left")
            words[:, size:] = (1 << self.bits) - 1
            high[which] = np.searchsorted(self.keys, _as_text(_keys(flat, at, self.depth, self.bits)), "right")
        return low, high

    def places(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position) of every verbatim occurrence of a test window."""
        if not len(self.suffixes) or not len(test.starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = self.search(test)
        count = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return window, self.suffixes[low[window] + inside]

    def longest(self, test: TestSet, window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place in the test set) of the longest match from each place on.

        The text that follows a place is looked up among the test suffixes that start with its
        window; its neighbours there are among those it is compared with, and one of them agrees longest.
        """
        best, where = test.lengths[window].copy(), test.starts[window].copy()
        low, high = test.low[window].copy(), test.high[window].copy()
        ids = np.concatenate([self.ids, [0]])
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            other, n = test.suffixes[middle], test.lengths[window[live]].copy()
            going = np.arange(len(live))
            while len(going):  # an item ends with a 0, as does a document
                here = ids[np.minimum(at[live[going]] + n[going], len(ids) - 1)]
                there = test.ids[other[going] + n[going]]
                going = going[(here == there) & (here > 0)]
                n[going] += 1
            better = n > best[live]
            best[live[better]], where[live[better]] = n[better], other[better]
            right = ids[np.minimum(at[live] + n, len(ids) - 1)] > test.ids[other + n]
            low[live[right]], high[live[~right]] = middle[right] + 1, middle[~right]
            live = live[low[live] < high[live]]
        return best, where


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Union of intervals as disjoint [start, end) pairs in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(starts) - 1]])
    return np.stack([starts[new], ends[last]], axis=1).tolist()


MATCH = pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n", pa.int64())])
FOUND = "doc_id {kind}, text binary, n_words bigint, items array<string>, hits array<array<bigint>>, matches array<struct<item_id:string,doc_start:bigint,item_start:bigint,n:bigint>>"


def _maximal(matches: list[dict]) -> list[dict]:
    """The matches that lie within no other, by their place."""
    out: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["doc_start"], -m["n"])):
        if not out or m["doc_start"] + m["n"] > out[-1]["doc_start"] + out[-1]["n"]:
            out.append(m)
    return out


def _matches(test: TestSet, shard: Shard, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, place in the test set, length) of the matches that lie within no other, by position; at ascends."""
    n, where = shard.longest(test, which, at)
    order = np.lexsort((-n, at))
    at, n, where = at[order], n[order], where[order]
    end = at + n
    new = end > np.concatenate([[-1], np.maximum.accumulate(end)[:-1]]) if len(at) else np.zeros(0, bool)
    return at[new], where[new], n[new]


def _scan(block: Broadcast, window: int, last: bool):
    """Adds the places of one block of the test set to each row; the text goes on unless the block is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestSet = block.value
        shortest = int(test.lengths.min()) if len(test.lengths) else window
        for batch in slices(batches, "text"):
            docs = [words_of(t) for t in batch.column("text").to_pylist()]
            shard = Shard(docs, test.vocab, shortest, window)
            which, at = shard.places(test)
            order = np.argsort(at, kind="stable")
            which, at = which[order], at[order]
            cuts = np.searchsorted(at, shard.first)
            longest = _matches(test, shard, which, at)
            own = np.searchsorted(longest[0], shard.first)
            n_words = pa.array([len(d) for d in docs], pa.int64())
            none = pa.array([], pa.string())
            known: dict[bytes, pa.Array] = {}
            items, hits, matches, begin, held = [], [], [], 0, 0

            def made(end: int, batch=batch, n_words=n_words) -> pa.RecordBatch:
                part = slice(begin, end)
                columns = {"doc_id": batch.column("doc_id")[part]} | ({} if last else {"text": batch.column("text")[part]})
                names = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, items)]), pa.int32()), pa.concat_arrays([none, *items]))
                columns |= {"n_words": n_words[part], "items": names, "hits": pa.array(hits, pa.list_(pa.list_(pa.int64()))), "matches": pa.array(matches, pa.list_(MATCH))}
                return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

            for d in range(len(docs)):
                before = [batch.column("items")[d].values, *(batch.column(c)[d].as_py() for c in ("hits", "matches"))] if "items" in batch.schema.names else [none, [], []]
                if cuts[d + 1] > cuts[d]:
                    part = slice(cuts[d], cuts[d + 1])
                    place, windows = at[part] - shard.first[d], np.unique(which[part])
                    key = windows.tobytes()
                    if key not in known:
                        known = known if len(known) < 1000 else {}
                        known[key] = pa.array(sorted(test.names_of(windows)), pa.string())
                    old = np.array(before[1], np.int64).reshape(-1, 2)
                    before[0] = pa.array(sorted({*before[0].to_pylist(), *known[key].to_pylist()}), pa.string()) if len(before[0]) else known[key]
                    before[1] = _merge(np.concatenate([old[:, 0], place]), np.concatenate([old[:, 1], place + test.lengths[which[part]]]))
                    for p, w, n in zip(*(x[own[d] : own[d + 1]].tolist() for x in longest), strict=True):
                        text = int(np.searchsorted(test.begins, w, "right")) - 1
                        before[2].append({"item_id": test.names[text][0], "doc_start": p - int(shard.first[d]), "item_start": w - int(test.begins[text]), "n": n})
                    before[2] = _maximal(before[2])
                for column, value in zip((items, hits, matches), before, strict=True):
                    column.append(value)
                held += len(before[0])
                if held >= NAMES:
                    yield made(d + 1)
                    items, hits, matches, begin, held = [], [], [], d + 1, 0
            if begin < len(docs):
                yield made(len(docs))

    return run


def _blocks(benchmark: DataFrame, window: int, block_words: int, item_id: str, item_text: str) -> Iterator[tuple[Broadcast, bool]]:
    """The test set in broadcast blocks of about block_words words, dealt by a hash of the text, and whether it is the last; one at least."""
    items = benchmark.select(col(item_id).cast("string").alias("i"), col(item_text).cast("string").cast("binary").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (block_words * 6)))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(TestSet.of([(r.i, r.t) for r in part.collect()], window)), b == blocks - 1


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = TEST_BLOCK_WORDS,
) -> DataFrame:
    """Every document with the test items that it repeats verbatim.

    Returns a row for each row of docs: doc_id, n_words, n_hit (words inside an occurrence of a
    window), items (sorted item ids with occurring windows), hits (disjoint [start, end) word
    ranges) and matches: the longest verbatim matches, none within another, each with one item
    that holds it, its place in the document and in the item, and its words.

    Null or wordless texts have no words and no hits; null item ids and wordless items give no
    window; repeated rows each keep their row; items with equal texts are all listed; an empty
    benchmark gives rows without hits, an empty table no rows; very long texts are searched whole.
    Other columns of docs are not read. The result doesn't depend on block_words, but for the
    item that a match names.
    """
    out = bound_batches(docs).select(col(doc_id).alias("doc_id"), col(text).cast("string").cast("binary").alias("text"))
    schema = FOUND.format(kind=out.schema["doc_id"].dataType.simpleString())
    before = None
    for block, last in _blocks(benchmark, window, block_words, item_id, item_text):
        out = out.mapInArrow(_scan(block, window, last), schema.replace(" text binary,", "") if last else schema)
        if not last:
            out = keep(out, "searched")
            if before is not None:
                drop_kept(before)
            before = out
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "hits", "matches")


def _touched(block: Broadcast, window: int):
    """An Arrow function of a text column: does the text hold any window of the block?"""

    @F.arrow_udf("boolean")
    def touched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test: TestSet = block.value
        shortest = int(test.lengths.min()) if len(test.lengths) else window
        for column in texts:
            out = np.zeros(len(column), bool)
            for first, n in pieces(column):
                shard = Shard([words_of(t) for t in column.slice(first, n).to_pylist()], test.vocab, shortest, window)
                _, at = shard.places(test)
                out[first + np.searchsorted(shard.first, at, "right") - 1] = True
            yield pa.array(out)
        pa.default_memory_pool().release_unused()

    return touched


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = TEST_BLOCK_WORDS, text: str = "text") -> DataFrame:
    """docs without the rows that hold any test window; all columns stay as they are, whatever their names.

    Rows are judged where they are read, so no join follows; no column but the text leaves the
    JVM. What a block of the test set leaves is written before the next one is searched. Edge
    cases as find_contamination.
    """
    before = None
    for block, last in _blocks(benchmark, window, block_words, "item_id", "text"):
        docs = bound_batches(docs).where(~_touched(block, window)(col(text).cast("string").cast("binary")))
        if not last:
            docs = keep(docs, "searched")
            if before is not None:
                drop_kept(before)
            before = docs
    return docs
