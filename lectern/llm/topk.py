"""Exact top-k search by inner product with a table of pivot distances.

Components are turned into integers, so scores are exact. Distances from every vector to a few
dozen pivots are computed once and travel with the vector. For a query q and a candidate x every
pivot p bounds their distance from below by |d(q, p) - d(x, p)|; the largest of these bounds gives
the upper bound (|q|^2 + |x|^2 - bound^2) / 2 of the inner product. Distances are rounded, so each
bound is lowered by more than the rounding of both distances, which grows with the pivot as they do.

Vectors are dealt to blocks in the order of their nearest pivots, queries and candidates alike, so
a block's distances to a pivot lie in a narrow range. Each block of queries first meets one block
of candidates, which gives every query a k-th best score to begin with. Then the ranges of
two blocks bound all scores between them, and only pairs of blocks that may hold a better score
meet. In such a pair, candidates are evaluated in the order of their bounds until the k-th best
score exceeds what is left; a few neighbouring queries share one order, that of their largest
bound, so that evaluation is a product of matrices.

Queries are a stated share of the rows. A task holds one block of queries and one of candidates,
and only k rows of each query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .common import col

PIVOTS = 24
#: Vectors of a block, on either side.
BLOCK = 4096
SCALE = 64
#: Queries that share an order, and candidates that are evaluated first; each turn takes 8 times more.
GROUP, STEP = 16, 512
#: Part of two distances that exceeds their rounding in single precision, and of two squares in double precision.
ROUNDING, SQUARES = 2.0**-21, 2.0**-40
#: Distances beyond this are not used: their squares leave the range of doubles.
FAR = 1e18


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def scores_of(block: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products (queries, block), held within 64-bit integers."""
    with np.errstate(over="ignore"):
        most = np.abs(block).max(initial=0) * np.abs(queries).max(initial=0) * block.shape[1]
    if most <= 2.0**53:
        return (queries @ block.T).astype(np.int64)
    if most <= 2.0**62:
        return queries.astype(np.int64) @ block.T.astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in block] for q in queries]
    return np.array([[max(-(2**63), min(2**63 - 1, s)) for s in row] for row in whole], np.int64)


def upper_bounds(queries: np.ndarray, near: np.ndarray, far: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(queries, block): no inner product is greater. near, far: distances to the pivots; norms: squares of the block."""
    lower = np.zeros((len(queries), len(far)), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        near, far = np.where(near < FAR, near, np.nan).astype(np.float32), np.where(far < FAR, far, np.nan).astype(np.float32)
        for p in range(far.shape[1]):
            a, b = near[:, p, None], far[None, :, p]
            np.fmax(lower, np.abs(a - b) - (a + b) * np.float32(ROUNDING), out=lower)  # what isn't a number bounds nothing
        size = norms[None] + (queries * queries).sum(axis=1)[:, None]
        upper = (size * (1 + SQUARES) - lower.astype(np.float64) ** 2 * (1 - SQUARES)) / 2 + 1
    upper[~np.isfinite(upper)] = np.inf
    return upper


def best_of(
    queries: np.ndarray, own: np.ndarray, near: np.ndarray, kth: np.ndarray, rows: np.ndarray, ids: np.ndarray,
    block: np.ndarray, far: np.ndarray, norms: np.ndarray, k: int,
) -> list[list[tuple[int, int]]]:
    """The k best (score, vec_id) of a block for each of a few queries, by descending upper bounds.

    kth: a score that k other rows are known to reach (or -inf); lower ones may be left out.
    """
    upper = upper_bounds(queries, near, far, norms)
    upper[own[:, None] == rows[None]] = -np.inf
    shared = upper.max(axis=0)
    order = np.argsort(-shared)
    tops: list[list[tuple[int, int]]] = [[] for _ in queries]
    kth = kth.copy()
    first, step = 0, STEP
    while first < len(order) and not (kth > shared[order[first]]).all():
        some = order[first : first + step]
        first, step = first + step, step * 8
        scores, others = scores_of(block[some], queries), rows[some]
        for i in range(len(queries)):
            hit = np.nonzero((scores[i] >= kth[i]) & (others != own[i]))[0]
            if len(hit) > k:
                hit = hit[scores[i, hit] >= np.partition(scores[i, hit], len(hit) - k)[len(hit) - k]]
            tops[i] = sorted(tops[i] + list(zip(scores[i, hit].tolist(), ids[some[hit]].tolist(), strict=True)), key=lambda t: (-t[0], t[1]))[:k]
            if len(tops[i]) == k:
                kth[i] = max(kth[i], tops[i][-1][0])
    return tops


def _with_pivots(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, nearest, norms = [], [], []
            for v in map(np.array, batch.column("v").to_pylist()):
                with np.errstate(over="ignore", invalid="ignore"):
                    d = np.sqrt(((pivots[len(v)] - v) ** 2).sum(axis=1)) if len(v) in pivots else np.zeros(0)
                    norms.append(float((v * v).sum()))
                far.append(d.tolist())
                nearest.append(int(d.argmin()) if len(d) else 0)
            made = [pa.array(far, pa.list_(pa.float64())), pa.array(nearest, pa.int32()), pa.array(norms, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "far", "nearest", "norm"])

    return run


RESULT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            block, far = _matrix(candidates.column("v")), _matrix(candidates.column("far"))
            ids, own, norms = (np.asarray(candidates.column(c)) for c in ("vec_id", "row", "norm"))
            wanted, near = _matrix(queries.column("v")), _matrix(queries.column("far"))
            asked, names = np.asarray(queries.column("row")), np.asarray(queries.column("vec_id"))
            kth = np.array([-np.inf if s is None else s for s in queries.column("kth").to_pylist()], np.float64)
            far = np.asfortranarray(far)
            alike = np.argsort(near.argmin(axis=1), kind="stable") if near.shape[1] else np.arange(len(near))
            for first in range(0, len(alike), GROUP):
                g = alike[first : first + GROUP]
                for row, name, best in zip(asked[g].tolist(), names[g].tolist(), best_of(wanted[g], asked[g], near[g], kth[g], own, ids, block, far, norms, k), strict=True):
                    rows += [(row, name, s, i) for s, i in best]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=RESULT)

    return run


def _blocks(held: DataFrame, n: DataFrame, count: str, block: int, name: str) -> DataFrame:
    """held with `name`: the block of each row, in the order of nearest pivots and of hashes for one pivot; and `many`, their number."""
    many = F.ceil(F.col("all") / block)
    part = F.pmod(F.xxhash64("row", F.lit(name)), F.lit(1 << 20)) / (1 << 20)
    at = (F.col("before") + part * F.col(count)) / F.col("all") * F.col("many")
    by_pivot = Window.partitionBy("size").orderBy("nearest").rowsBetween(Window.unboundedPreceding, -1)
    sizes = n.select("size", "nearest", count, F.coalesce(F.sum(count).over(by_pivot), F.lit(0)).alias("before"), F.sum(count).over(Window.partitionBy("size")).alias("all"))
    sizes = sizes.where(F.col(count) > 0).withColumn("many", many)
    return held.join(F.broadcast(sizes), ["size", "nearest"]).withColumn(name, F.least(F.floor(at), F.col("many") - 1).cast("int")).drop("before", "all", count, "nearest")


def _ranges(blocks: DataFrame, key: str, pivots: int, prefix: str, *more: Column) -> DataFrame:
    """For each block the least and largest distance to each pivot, and the largest square."""
    ends = [f(F.get("far", F.lit(p))) for p in range(pivots) for f in (F.min, F.max)]
    low, high = F.array(*ends[::2]), F.array(*ends[1::2])
    return blocks.groupBy("size", key).agg(low.alias(f"{prefix}low"), high.alias(f"{prefix}high"), F.max("norm").alias(f"{prefix}norm"), *more)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = PIVOTS, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row with vec_id % every = 0.

    Components become floor(64 x); the score is the integer inner product; ties go to the smaller
    vec_id. Vectors that are null, or hold null or non-finite components, or have no vec_id take
    no part, and only vectors of equal length meet (empty ones score 0). Rows that repeat a vec_id
    are rows of their own. Fewer than k others give fewer rows; an empty table gives none. Scores
    beyond 64 bits are held at their ends. Other columns are not read.
    """
    usable = F.col("e").isNotNull() & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    raw = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(embedding).cast("array<double>").alias("e")).where(usable & F.col("vec_id").isNotNull())
    whole = raw.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    whole = keep(whole, "vectors")  # row numbers stay as they are written
    picked = whole.orderBy(F.xxhash64("vec_id"), "row").limit(pivots).collect()
    table: dict[int, list] = {}
    for r in picked:
        table.setdefault(len(r.v), []).append(r.v)
    chosen = {n: np.array(v, np.float64).reshape(len(v), n) for n, v in table.items()}
    made = whole.mapInArrow(_with_pivots(chosen), "row bigint, vec_id bigint, v array<double>, far array<double>, nearest int, norm double")
    held = keep(made.withColumn("size", F.size("v")), "pivot-table")
    asked = F.col("vec_id") % every == 0
    n = held.groupBy("size", "nearest").agg(F.count("*").alias("n"), F.count_if(asked).alias("n_asked"))
    candidates = _blocks(held, n, "n", block, "c").withColumnRenamed("many", "n_c")
    queries = _blocks(held.where(asked), n, "n_asked", block, "q").withColumnRenamed("many", "n_q")
    shared = held.groupBy("size").agg(F.ceil(F.count_if(asked) / block).alias("n_q"), F.ceil(F.count("*") / block).alias("n_c"))
    home = F.floor((F.col("q") + 0.5) / F.col("n_q") * F.col("n_c")).cast("int")

    # each block of queries meets the block of candidates at the same place of the order
    columns = ["row", "vec_id", "v", "far", "norm", "size"]
    first = shared.where("n_q > 0").select("size", "n_q", "n_c", F.explode(F.sequence(F.lit(0), (F.col("n_q") - 1).cast("int"))).alias("q")).select("size", "q", home.alias("c"))
    own = [F.col(c).alias(c) for c in (*columns, "q")]  # names of their own, as both sides come from one table
    begun = queries.select(*own, F.lit(None).cast("long").alias("kth")).groupBy("size", "q").cogroup(candidates.select(*columns, "c").join(F.broadcast(first), ["size", "c"]).groupBy("size", "q"))
    ddl = "query_row bigint, query_id bigint, score bigint, vec_id bigint"
    begun = keep(begun.applyInArrow(_search(k), ddl), "begun")
    kth = begun.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    queries = keep(queries.join(kth, "row", "left"), "queries")

    # pairs of blocks whose ranges leave room for a better score
    deal = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.min(F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))).alias("kth")
    asking = _ranges(queries, "q", pivots, "q", least).withColumn("deal", F.pmod(F.xxhash64("q"), F.lit(deal)))
    offered = _ranges(candidates, "c", pivots, "c").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    gaps = F.transform(
        F.arrays_zip("qlow", "qhigh", "clow", "chigh"),
        lambda r: F.when((r["qhigh"] < FAR) & (r["chigh"] < FAR), F.greatest(r["qlow"] - r["chigh"], r["clow"] - r["qhigh"]) - (r["qhigh"] + r["chigh"]) * ROUNDING).otherwise(0.0),
    )
    gap = F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)), F.lit(0.0))
    upper = ((F.col("qnorm") + F.col("cnorm")) * (1 + SQUARES) - gap * gap * (1 - SQUARES)) / 2 + 1
    pairs = asking.join(offered, ["size", "deal"]).where(~(upper < F.col("kth"))).select("size", "q", "c")
    pairs = keep(pairs.join(first, ["size", "q", "c"], "left_anti"), "block-pairs")

    left = queries.select(*columns, "kth", "q").join(pairs, ["size", "q"]).groupBy("size", "q", "c")
    right = candidates.select(*columns, "c").join(pairs.select(*[F.col(c).alias(c) for c in pairs.columns]), ["size", "c"]).groupBy("size", "q", "c")
    found = begun.unionByName(left.cogroup(right).applyInArrow(_search(k), ddl))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
