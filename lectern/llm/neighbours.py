"""Approximate nearest neighbours by inner product over learned partitions.

On a bounded sample of distinct vectors the neighbour graph is built exactly and cut into parts of
equal size: it is halved again and again by a slowly varying vector of the graph, and pairs of
members are swapped while that saves edges. A small network learns which parts a vector's neighbours
lie in. It gives every row of the table its part (the most probable one), and sends each query to
its most probable parts, as many as bring enough of the neighbours of vectors that it has not been
fitted on. There, all members are scored exactly.

A part of any size is dealt to blocks by a hash of its rows, so copies of one vector, which all
share a part, spread over tasks. Within a block, equal vectors are scored once and stand for their
smallest ids. Only k rows of each query leave a pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .common import col

#: Most vectors that the partitions are fitted on; a tenth of them is kept to choose the number of parts a query visits.
SAMPLE = 8192
#: Rows of a part on average, and most parts.
PART_ROWS, MOST_PARTS = 4096, 128
#: Vectors of a block, on either side.
BLOCK = 8192
#: Share of neighbours that the parts a query visits must hold, over vectors that were kept back.
RECALL = 0.95
GRAPH, HIDDEN, EPOCHS = 10, 128, 25


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k): the k rows with the largest inner product with each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for first in range(0, len(x), 1024):
        s = x[first : first + 1024] @ x.T
        s[np.arange(len(s)), np.arange(first, first + len(s))] = -np.inf
        out[first : first + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def _halve(graph: np.ndarray, members: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Which members go to the first half, of `size` members: few edges run between the halves."""
    number = np.full(len(graph), -1, np.int64)
    number[members] = np.arange(len(members))
    near = number[graph[members]]
    inside = near >= 0
    heads, tails = np.repeat(np.arange(len(members)), inside.sum(axis=1)), near[inside]
    degree = np.bincount(heads, minlength=len(members)) + np.bincount(tails, minlength=len(members)) + 1.0
    v = np.random.default_rng(seed).standard_normal(len(members))
    for _ in range(40):  # power iteration towards a slowly varying vector
        v = v - (v * degree).sum() / degree.sum()
        v = (v + np.bincount(heads, v[tails], len(members)) + np.bincount(tails, v[heads], len(members))) / degree
        v /= np.abs(v).max() + 1e-30
    first = np.zeros(len(members), bool)
    first[np.argsort(v, kind="stable")[:size]] = True
    for _ in range(20):  # swap the pairs whose edges mostly run across
        side = np.where(first, 1.0, -1.0)
        across = -side * (np.bincount(heads, side[tails], len(members)) + np.bincount(tails, side[heads], len(members)))
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        a, b = a[np.argsort(-across[a], kind="stable")], b[np.argsort(-across[b], kind="stable")]
        n = min(len(a), len(b))
        gain = across[a[:n]] + across[b[:n]] > 2.0
        n = min(int(gain.argmin()) if not gain.all() else n, max(1, n // 20))
        if not n or not gain[0]:
            break
        first[a[:n]], first[b[:n]] = False, True
    return first


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each vertex; the sizes of parts differ by 1 at most for each halving."""
    out = np.zeros(len(graph), np.int64)
    work = [(np.arange(len(graph)), 0, parts)]
    while work:
        members, name, n = work.pop()
        if n == 1 or len(members) < 2:
            out[members] = name
            continue
        left = n // 2
        first = _halve(graph, members, round(len(members) * left / n), name)
        work += [(members[first], name, left), (members[~first], name + left, n - left)]
    return out


class Router:
    """A network of one hidden layer from vectors to probabilities of parts."""

    def __init__(self, scale: float, weights: list[np.ndarray], visits: int):
        self.scale, self.weights, self.visits = scale, weights, visits

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.maximum(x / self.scale @ w + b, 0) @ v + c

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1) if self.parts > 1 else np.zeros(len(x), np.int64)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """(n, visits): the most probable parts of each query."""
        if self.visits >= self.parts:
            return np.tile(np.arange(self.parts), (len(x), 1))
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.visits]


def _train(x: np.ndarray, share: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Weights that make the softmax of the network's outputs follow `share`, by Adam."""
    draw = np.random.default_rng(seed)
    d, p = x.shape[1], share.shape[1]
    weights = [draw.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), draw.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    turn = 0
    for epoch in range(EPOCHS):
        for some in np.array_split(draw.permutation(len(x)), max(1, len(x) // 256)):
            turn += 1
            hidden = np.maximum(x[some] @ weights[0] + weights[1], 0)
            out = hidden @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out = (out / out.sum(axis=1, keepdims=True) - share[some]) / len(some)
            back = (out @ weights[2].T) * (hidden > 0)
            for i, g in enumerate((x[some].T @ back, back.sum(axis=0), hidden.T @ out, out.sum(axis=0))):
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.001 * (g * g - square[i])
                step = (3e-3 if epoch < EPOCHS * 0.7 else 6e-4) * mean[i] / (1 - 0.9**turn)
                weights[i] -= step / (np.sqrt(square[i] / (1 - 0.999**turn)) + 1e-8)
    return weights


def fit(sample: np.ndarray, rows: int, k: int, recall: float = RECALL, part_rows: int = PART_ROWS) -> Router:
    """A router for a table of `rows` vectors, fitted on a sample of distinct ones."""
    d = sample.shape[1]
    parts = int(min(MOST_PARTS, -(-rows // part_rows), len(sample) // 32))
    if parts < 2:
        return Router(1.0, [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    scale = float(np.sqrt(np.mean((sample / np.abs(sample).max()) ** 2) * d) * np.abs(sample).max())
    x = sample / scale
    held = max(64, len(x) // 10)
    own, kept = x[:-held], x[-held:]
    graph = neighbour_graph(own, GRAPH)
    part = balanced_parts(graph, parts)
    share = np.zeros((len(own), parts))
    np.add.at(share, (np.repeat(np.arange(len(own)), graph.shape[1]), part[graph].ravel()), 1.0)
    np.add.at(share, (np.arange(len(own)), part), 1.0)
    router = Router(scale, _train(own, share / share.sum(axis=1, keepdims=True)), parts)
    # of vectors kept back: how many parts must be visited
    home = router.part_of(sample[:-held])
    k = min(k, len(own))
    near = np.argpartition(-(kept @ own.T), k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-router.logits(sample[-held:]), axis=1, kind="stable"), axis=1)
    visit = np.take_along_axis(place, home[near], axis=1)
    found = (visit[:, :, None] < np.arange(1, parts + 1)).mean(axis=(0, 1))
    router.visits = int(np.argmax(found >= recall)) + 1 if (found >= recall).any() else parts
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, routers: dict[int, Router], answer) -> list[list[int]]:
    """answer(router, vectors) for the rows of each length; [0] for lengths without a router."""
    column = batch.column(batch.schema.get_field_index("v"))
    sizes = np.asarray(column.value_lengths())
    out: list[list[int]] = [[0]] * len(sizes)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        if size in routers:
            for i, got in zip(at.tolist(), answer(routers[size], _matrix(column.take(pa.array(at)))).tolist(), strict=True):
                out[i] = got if isinstance(got, list) else [got]
    return out


def _routed(routers: dict[int, Router], every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _by_size(batch, routers, (lambda r, x: r.visited(x)) if every else (lambda r, x: r.part_of(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    return run


def best_in_block(queries: np.ndarray, own: np.ndarray, block: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(place of a query, its k best (score, vec_id) of a block), its own row left out."""
    order = np.lexsort((rows, ids))
    block, rows, ids = np.ascontiguousarray(block[order]), rows[order], ids[order]
    width = block.dtype.itemsize * block.shape[1]
    _, first, back = np.unique((block + 0.0).view(f"V{width}").ravel(), return_index=True, return_inverse=True)  # + 0.0: no -0.0
    members = np.argsort(back, kind="stable")  # of each distinct vector, by id
    begin = np.concatenate([[0], np.cumsum(np.bincount(back, minlength=len(first)))])
    distinct = block[first]
    slack = 1e-13 * max(1, block.shape[1]) * np.sqrt((distinct * distinct).sum(axis=1).max(initial=0.0))
    most = min(k + 1, len(distinct))
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        rough = some @ distinct.T
        kth = np.partition(rough, len(distinct) - most, axis=1)[:, len(distinct) - most] - slack * np.sqrt((some * some).sum(axis=1))
        for i, q in enumerate(some):
            near = np.flatnonzero(rough[i] >= kth[i])
            exact = (distinct[near] * q).sum(axis=1)  # one sum for each vector, the same for its copies wherever they are
            found = []
            for score, c in zip(exact.tolist(), near.tolist(), strict=True):
                found += [(score, int(ids[m])) for m in members[begin[c] : min(begin[c] + k + 1, begin[c + 1])] if rows[m] != own[at + i]]
            yield at + i, sorted(found, key=lambda t: (-t[0], t[1]))[:k]


FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        made: list[tuple[int, int, float, int]] = []
        if queries.num_rows and candidates.num_rows:
            row, name = (np.asarray(queries.column(c)) for c in ("row", "vec_id"))
            for i, best in best_in_block(_matrix(queries.column("v")), row, _matrix(candidates.column("v")), *(np.asarray(candidates.column(c)) for c in ("row", "vec_id")), k):
                made += [(int(row[i]), int(name[i]), s, v) for s, v in best]
        return pa.Table.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    return run


def index_vectors(vectors: DataFrame, k: int = 20, sample: int = SAMPLE, part_rows: int = PART_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, dict[int, Router]]:
    """(row, vec_id, v, size and part of every usable vector as a written table; the router of each length)."""
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    raw = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(embedding).cast("array<double>").alias("v"))
    usable = raw.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    whole = keep(usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("size")), "vectors")  # row numbers stay as written
    sizes = {r["size"]: r["count"] for r in whole.groupBy("size").count().orderBy(F.desc("count"), "size").limit(16).collect()}
    routers = {}
    for size, rows in sizes.items():
        hashed = whole.where(F.col("size") == size).withColumn("h", F.xxhash64("v", F.lit(1)))
        part = hashed.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4.0 * sample / rows)))
        distinct = part.groupBy("h").agg(F.min_by("v", "row").alias("v")).orderBy("h").limit(sample)
        drawn = np.array([r.v for r in distinct.select("v").collect()], np.float64).reshape(-1, size)
        routers[size] = fit(drawn, rows, k, part_rows=part_rows)
    routed = whole.mapInArrow(_routed(routers, False), "row bigint, vec_id bigint, v array<double>, size int, parts array<int>")
    return keep(routed.select("row", "vec_id", "v", "size", F.col("parts")[0].alias("part")), "index"), routers


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE, part_rows: int = PART_ROWS, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that are found for each row with vec_id % every = 0.

    Every usable row is indexed; the partitions are fitted on at most `sample` distinct vectors of
    each of the 16 commonest lengths (rarer lengths are searched whole). Nearness is the inner product in double
    precision; ties go to the smaller vec_id. All rows but the query's own are candidates, rows
    that repeat a vec_id or a vector among them. Vectors that are null, zero, or hold null or non-finite
    components, or have no vec_id, take no part; only vectors of equal length meet. Where fewer
    than k candidates lie in the parts that a query visits, it visits all parts. An empty table gives no rows; other columns
    are not read.
    """
    index, routers = index_vectors(vectors, k, sample, part_rows, vec_id, embedding)
    counts = index.groupBy("size", "part").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    held = {(r["size"], r["part"]): r["n"] for r in counts.where(F.col("size").isin(*routers) if routers else F.lit(False)).collect()}  # at most 16 x MOST_PARTS rows
    for size, router in routers.items():
        n = sorted(held.get((size, p), 0) for p in range(router.parts))
        while router.visits < router.parts and sum(n[: router.visits]) <= k:  # even the smallest parts hold k others
            router.visits += 1
    asked = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v", "size")
    routed = asked.mapInArrow(_routed(routers, True), "row bigint, vec_id bigint, v array<double>, size int, parts array<int>")
    queries = keep(routed.withColumn("part", F.explode("parts")).drop("parts"), "routed")

    # blocks of both sides of a part
    wanted = queries.groupBy("size", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
    blocks = keep(counts.join(wanted, ["size", "part"]).select("size", "part", F.ceil(F.col("n") / block).cast("int").alias("c_blocks"), "q_blocks"), "blocks")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    key = ["size", "part", "c", "q"]
    left = queries.join(blocks, ["size", "part"]).withColumn("q", salt("q_blocks")).withColumn("c", numbers("c_blocks"))
    right = index.join(blocks, ["size", "part"]).withColumn("c", salt("c_blocks")).withColumn("q", numbers("q_blocks"))
    columns = ["row", "vec_id", "v", *key]
    met = left.select(*[F.col(c).alias(c) for c in columns]).groupBy(*key).cogroup(right.select(*[F.col(c).alias(c) for c in columns]).groupBy(*key))
    found = met.applyInArrow(_search(k), "query_row bigint, query_id bigint, score double, vec_id bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
