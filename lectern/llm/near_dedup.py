"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets.

A document is the multiset of its five-word shingles; two documents are near duplicates if the
weighted Jaccard similarity of these multisets is 0.8 or more, and a class is a connected group
of such pairs.

Signatures: the weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), [4,8) ... and each
(shingle, interval) owns a Poisson process of that rate. A process yields its first point
without looking inside; only a process whose point may still enter the signature is split into
its halves, down to unit intervals below the shingle's count. Each point falls into one of the
signature's slots, and a slot keeps its earliest point, so two documents agree in a slot with
probability equal to their weighted Jaccard similarity.

Grouping: documents with equal words share one node. Nodes that agree in all rows of a band
share a bucket. A bucket never emits all its pairs. First, its members are compared with one hub,
the member that shares most buckets; verified pairs join components. Those that the hub doesn't
link to get a hub of their own, as long as large buckets keep shrinking that way. Only members of
one bucket that are still in different components are paired then, and only if they can be similar
at all: a shingle that no other open node has can't be common to a pair, so what is left of both
must reach the overlap that the similarity needs. This bound is exact. A pair within one component
adds nothing to the classes, so no class is lost.

Before members and texts are shuffled, a broadcast filter of bounded size drops those that no other
node shares a bucket with. It may let others through, which the join that follows drops.

Bags are written in buckets by their node, so pairs are shuffled to them and not they to each list of pairs.
A hub meets all members of its bucket, so its shingles are sent in as many copies as its bucket
has parts of SPLIT members, and each pair goes to one of these copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, keep, keep_by
from .common import WordHashes, bound_batches, col, mix, rolling, slices, unused, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 5 rows miss a pair of similarity 0.8 with probability 3e-6.
BANDS, ROWS = 32, 5
#: A bucket with more open members than LARGE gets a further hub, if the last one halved their number at least.
LARGE = 128
#: Pairs of one node that are compared in one place.
SPLIT = 512
#: Rows of a piece that is signed at once.
PIECE = 512
#: Pairs of a task that compares bags.
TASK_PAIRS = 2048
#: The most bits of the filter that tells which texts are needed (it is broadcast), and those of one of its blocks.
FILTER_BITS, BLOCK = 1 << 28, 1 << 12

UNIT = np.float64(1.0 / (1 << 53))


def _exponential(h: np.ndarray) -> np.ndarray:
    return -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * UNIT))


def _trees(doc: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The dyadic intervals that a count reaches: (doc, key, count, start, size) arrays by size."""
    start, size = 0, 1
    while len(doc):
        yield doc, key, count, start, size
        start, size = start + size, max(1, start + size)
        more = count > start
        doc, key, count = doc[more], key[more], count[more]


def _seed(key: np.ndarray, start: np.ndarray | int, size: np.ndarray | int, salt: int) -> np.ndarray:
    node = np.atleast_1d(np.asarray(start, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(size, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(key ^ mix(node + np.uint64(salt)))


def bag_signatures(doc: np.ndarray, key: np.ndarray, count: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """BagMinHash signatures: uint64 ids of the earliest points, (docs, slots); 0 for empty documents.

    doc, key, count: one entry for each distinct shingle of each document.
    """
    total = np.bincount(doc, weights=count, minlength=docs)
    best = np.full(docs * slots, np.inf)
    sign = np.zeros(docs * slots, np.uint64)
    margin, todo = 4.0, total > 0
    while todo.any():
        limit = np.where(todo, slots / np.maximum(total, 1) * (np.log(slots) + margin), -1.0)
        best.reshape(docs, slots)[todo] = np.inf
        live = todo[doc]
        for d, k, c, start, size in _trees(doc[live], key[live], count[live]):
            # split processes whose first point comes early enough, down to unit intervals
            x = _exponential(_seed(k, start, size, 1)) / size
            early = x <= limit[d]
            d, k, c, x = d[early], k[early], c[early], x[early]
            at = np.full(len(d), start, np.int64)
            width = size
            while width > 1 and len(d):
                half = width // 2
                right = (_seed(k, at, width, 2) >> np.uint64(63)).astype(np.int64)
                other = at + (1 - right) * half
                late = x + _exponential(_seed(k, other, half, 3)) / half
                at, d, k, c, x = np.concatenate([at + right * half, other]), np.tile(d, 2), np.tile(k, 2), np.tile(c, 2), np.concatenate([x, late])
                on = (at < c) & (x <= limit[d])
                at, d, k, c, x = at[on], d[on], k[on], c[on], x[on]
                width = half
            # unit intervals: all points up to the limit
            leaf, turn = _seed(k, at, 1, 4), 0
            while len(d):
                point = mix(leaf + np.uint64(turn * 2 + 1))
                slot = d * slots + (point % np.uint64(slots)).astype(np.int64)
                np.minimum.at(best, slot, x)
                first = best[slot] == x
                sign[slot[first]] = point[first]
                turn += 1
                x = x + _exponential(mix(leaf + np.uint64(turn * 2)))
                on = x <= limit[d]
                d, leaf, x = d[on], leaf[on], x[on]
        todo = np.isinf(best.reshape(docs, slots)).any(axis=1) & (total > 0)
        margin *= 2
    return sign.reshape(docs, slots)


def _counted(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, shingle) with their counts."""
    parts = [np.unique(s, return_counts=True) for s in shingles]
    doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    if not parts:
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return doc, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles; fewer words (but some) are one shingle."""
    return rolling(hashes, min(k, len(hashes))) if len(hashes) else hashes


def _node(hashes: np.ndarray) -> bytes | None:
    """128 bits that stand for the sequence of words; none without words."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches, "text", 1 << 20, PIECE):
            hashes = words.of(batch.column("text").to_pylist())
            doc, key, count = _counted([_shingles(h, k) for h in hashes])
            sign = bag_signatures(doc, key, count, len(hashes), bands * rows).reshape(len(hashes), bands, rows)
            band = mix(np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(hashes), bands)))
            for r in range(rows):
                band = mix(band ^ sign[:, :, r])
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1) * bands, pa.int32()), pa.array(band.ravel().view(np.int64)))
            node = pa.array([_node(h) for h in hashes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), node, column], names=["doc_id", "key", "node", "bands"])

    return run


def _halves(nodes: list[bytes]) -> np.ndarray:
    """The 64-bit halves of nodes."""
    return np.frombuffer(b"".join(nodes), "<u8").reshape(-1, 2)


def _hashes(buckets: np.ndarray) -> np.ndarray:
    """Two hashes of each bucket."""
    return np.stack([buckets, mix(buckets)], axis=1)


def _placed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            pairs = _halves(column.to_pylist()) if pa.types.is_binary(column.type) else _hashes(column.to_numpy().view(np.uint64))
            at = (pairs & np.uint64(bits - 1)).astype(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array((at % BLOCK).astype(np.int32))], names=["block", "at"])

    return run


def _block(group: pa.Table) -> pa.Table:
    on = np.zeros(BLOCK, bool)
    on[group.column("at").to_numpy()] = True
    return pa.table({"block": group.column("block").slice(0, 1), "on": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """Bits at two places of each of n keys: a column of nodes or of buckets. Its size is bounded, so of very many keys it tells fewer others apart."""
    bits = max(BLOCK, min(FILTER_BITS, 1 << (32 * max(n, 1) - 1).bit_length()))
    blocks = keys.mapInArrow(_placed(bits), "block bigint, at int").groupBy("block").applyInArrow(_block, "block bigint, on binary")
    out = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for row in blocks.collect():  # 32 MB at most
        out[row.block] = np.frombuffer(row.on, np.uint8)
    return out.ravel()


def _held(pairs: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Whether a key of each pair of hashes may be in the filter; of one that is, it is always true."""
    at = (pairs & np.uint64(len(on) * 8 - 1)).astype(np.int64)
    return (on[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def _members(shared):
    """(node, band, bucket) of the buckets that the broadcast filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            bucket = lists.flatten().to_numpy()
            n = lists.value_lengths().to_numpy()
            held = _held(_hashes(bucket.view(np.uint64)), shared.value)
            row = np.repeat(np.arange(len(n)), n)
            band = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            nodes = batch.column("node").take(pa.array(row[held]))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(band[held].astype(np.int32)), pa.array(bucket[held])], names=["node", "band", "bucket"])

    return run


def _spell(shared):
    """(node, words) of the rows whose node the broadcast filter may hold. Of equal nodes a piece emits the first.

    Words travel as text, which packs well; hashes wouldn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, on = WordHashes(), shared.value
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            first: dict[bytes, int] = {}
            for i, h in enumerate(words.of(texts)):
                node = _node(h)
                if node is not None:
                    first.setdefault(node, i)
            held = _held(_halves(list(first)), on)
            found = [node for node, h in zip(first, held, strict=True) if h]
            spelled = [b" ".join(words_of(texts[first[node]])) for node in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(spelled, pa.binary())], names=["node", "words"])

    return run


def _bags(k: int):
    """(node, bag): the shingles of words as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches, "words", 1 << 20):
            bags = [np.sort(_shingles(h, k)).astype("<u8").tobytes() for h in words.of(batch.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bags, pa.binary())], names=["node", "bag"])

    return run


def _distinct_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingle, count) of every distinct shingle of every bag."""
    for batch in slices(batches, "bag"):
        parts = [np.unique(np.frombuffer(b, "<i8"), return_counts=True) for b in batch.column("bag").to_pylist()]
        ids = np.repeat(np.asarray(batch.column("id")), [len(p[0]) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.concatenate([p[1] for p in parts]))], names=["id", "shingle", "n"])


def bag_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as arrays."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bag", 4 << 20):
            left, right = batch.column("bag").to_pylist(), batch.column("other").to_pylist()
            near = []
            for a, b in zip(left, right, strict=True):
                short, long = sorted((len(a), len(b)))
                near.append(short >= similarity * long and (a == b or bag_similarity(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= similarity))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, root) for all nodes of labels, in which edges join components further; root: the smallest node.

    labels: (node, root) as kept so far, each root a node of its own. Each turn hooks every root
    to its smallest neighbouring root and then follows the hooks until they end at roots, so the
    components shrink by a factor each turn. All steps are joins and partial aggregates; nothing of
    the graph comes to the driver but counts of rows, by which the steps are dealt to tasks.
    """
    n, first = labels.count(), labels

    def between(pairs: DataFrame, roots: DataFrame, node: str, root: str, rows: int) -> tuple[DataFrame, int]:
        """The distinct edges of different roots that pairs become, and their number; a node without a root stays."""
        a = roots.select(F.col(node).alias("a"), F.col(root).alias("ra"))
        b = roots.select(F.col(node).alias("b"), F.col(root).alias("rb"))
        moved = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        moved = moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        out = keep(moved, "edges", rows)
        return out, out.count()

    rest, m = between(edges.select("a", "b"), labels, "node", "root", edges.count())
    while m:
        hooks = keep(rest.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to")), "hooks", m)
        while True:
            step = hooks.select(F.col("root").alias("to"), F.col("to").alias("further"))
            longer = hooks.join(step, "to").limit(1)
            if longer.isEmpty():
                break
            jumped = hooks.join(step, "to", "left").select("root", F.coalesce("further", "to").alias("to"))
            old, hooks = hooks, keep(jumped, "hooks", m)
            drop_kept(old)
        old, labels = labels, keep(labels.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels", n)
        if old is not first:
            drop_kept(old)
        old, (rest, m) = rest, between(rest, hooks, "root", "to", m)
        drop_kept(old)
        drop_kept(hooks)
    drop_kept(rest)
    return labels


def _key(text: str) -> Column:
    """Stands for the text of a row: its MD5; null for a null text."""
    return F.unhex(F.md5(col(text).cast("string").cast("binary")))


def _possible_pairs(open_: DataFrame, bags: DataFrame, similarity: float, kept: Callable[..., DataFrame]) -> DataFrame:
    """(a, b, n) of members of one bucket that have different roots and may be similar."""
    places = open_.count()
    own = bags.join(open_.select("node").distinct(), "node").select("node", F.xxhash64("node").alias("id"), "bag")
    size = (F.octet_length("bag") / 8).cast("bigint")
    share = similarity / (1 + similarity)  # of the two sizes together, the least overlap of a pair

    def with_common(bags_of: DataFrame) -> DataFrame:
        """(node, size, common): how many shingles of each bag some other of these bags has too."""
        parts = bags_of.select("id", "bag").mapInArrow(_distinct_shingles, "id bigint, shingle bigint, n bigint")
        sizes = bags_of.select("id", "node", size.alias("size"))  # a bag itself needn't come to its sums
        alone = parts.groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("id").alias("id"), F.sum("n").alias("n")).where("nodes = 1").groupBy("id").agg(F.sum("n").alias("alone"))
        return kept(sizes.join(alone, "id", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common")), "sizes", places, TASK_PAIRS)

    # who can't reach the overlap with the smallest member of any of its buckets is out, and its shingles with it
    sized = open_.join(with_common(own), "node")
    smallest = sized.groupBy("bucket").agg(F.min("size").alias("least"))
    able = sized.join(smallest, "bucket").where(F.col("common") >= share * (F.col("size") + F.col("least")) - 1e-6).select("node").distinct()
    sizes = with_common(own.join(kept(able, "able", places), "node"))
    own_buckets = open_.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "bucket"))).alias("all"))
    left = kept(open_.join(sizes.join(own_buckets, "node"), "node"), "left", places)
    right = left.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "size", "common", "all")])
    needed = share * (F.col("size") + F.col("size2")) - 1e-6
    first = F.array_intersect("all", "all2")[0]["bucket"] == F.col("k")  # a pair counts in its first common bucket
    may = (F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & (F.col("common") >= needed) & (F.col("common2") >= needed) & first
    return left.withColumnRenamed("bucket", "k").join(right, (F.col("k") == F.col("bucket")) & may).select(F.col("node").alias("a"), F.col("node2").alias("b"), "n")


def row_classes(
    docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    large: int = LARGE, split: int = SPLIT, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, key (of the text), node (null without words), root and class_id for each row of docs.

    Rows of one class have one root; the rest as near_duplicates.
    """
    source = bound_batches(docs).select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").cast("binary").alias("text"))
    used, spark = [], docs.sparkSession

    def kept(df: DataFrame, name: str, *bounds: int) -> DataFrame:
        used.append(keep(df, name, *bounds))
        return used[-1]

    signed = kept(source.select("doc_id", "text", _key("text").alias("key")).mapInArrow(_sign(k, bands, rows), "doc_id bigint, key binary, node binary, bands array<bigint>"), "signed")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = kept(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    held = spark.sparkContext.broadcast(key_filter(shared.select("bucket"), shared.count()))
    members = signed.where("node IS NOT NULL").select("node", "bands").mapInArrow(_members(held), "node binary, band int, bucket bigint").distinct()
    found = kept(members.join(shared, "bucket").select("node", "band", "bucket", "n"), "found")
    held.unpersist()
    score = found.groupBy("node").agg(F.sum("n").alias("score"))
    buckets = kept(found.join(score, "node").select("node", "band", "bucket", "n", "score"), "buckets")
    places = all_places = buckets.count()
    labels = kept(buckets.select("node").distinct().withColumn("root", F.col("node")), "labels", places)
    candidates = labels.select("node")
    wanted = spark.sparkContext.broadcast(key_filter(candidates, labels.count()))
    spelled = source.select("text").mapInArrow(_spell(wanted), "node binary, words binary").join(candidates, "node").dropDuplicates(["node"])
    bags = keep_by(spelled.select("node", "words").mapInArrow(_bags(k), "node binary, bag binary"), "bags", "node")
    used.append(bags)
    wanted.unpersist()

    def link(pairs: DataFrame, rows: int | None = None) -> None:
        """Join the components of the similar of the pairs (a, b, n); n: about how many pairs b is in; rows: at most so many pairs."""
        nonlocal labels
        parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / split, F.lit(1.0))))).cast("int")
        pairs = pairs.groupBy("a", "b").agg(F.max("n").alias("n")).withColumn("parts", parts)
        pairs = kept(pairs.select("a", "b", "parts", F.pmod(F.xxhash64("a"), "parts").alias("part")), "pairs", rows)
        found = pairs.count()
        if not found:
            return
        copies = pairs.select("b", "parts", "part").distinct().join(bags.select(F.col("node").alias("b"), F.col("bag").alias("other")), "b")
        both = pairs.join(bags.withColumnRenamed("node", "a"), "a").join(copies, ["b", "parts", "part"])
        links = kept(both.select("a", "b", "bag", "other").mapInArrow(_verify(similarity), "a binary, b binary"), "links", found, TASK_PAIRS)
        old, labels = labels, connected(links, labels)
        if labels is not old:
            used.append(labels)

    placed = buckets.withColumn("root", F.col("node")).withColumn("before", F.col("n"))
    while True:
        hubs = placed.groupBy("bucket").agg(F.max(F.struct("score", "node", "root")).alias("hub"))
        apart = placed.join(hubs, "bucket").where(F.col("root") != F.col("hub.root"))
        met = kept(apart.select("node", "band", "bucket", "n", "score", "before", F.col("hub.node").alias("b")), "stars", places)
        places = met.count()
        link(met.select(F.col("node").alias("a"), "b", "n"), places)
        # buckets that are still large go on, if this hub halved them
        open_ = met.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > large).select("bucket")
        roots = labels.select(F.col("node").alias("b"), F.col("root").alias("hub_root"))
        rest = met.join(open_, "bucket").join(labels, "node").join(roots, "b").where("root != hub_root")
        rest = kept(rest.select("node", "band", "bucket", "n", "score", "before", "root"), "rest", places)
        shrunk = rest.groupBy("bucket").agg(F.count("*").alias("m"), F.first("before").alias("was")).where((F.col("m") > large) & (F.col("m") <= F.col("was") / 2))
        placed = kept(rest.drop("before").join(shrunk.select("bucket", F.col("m").alias("before")), "bucket"), "placed", places)
        places = placed.count()
        if not places:
            break

    placed = buckets.join(labels, "node")
    apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    open_ = kept(placed.join(apart, "bucket").select("node", "band", "bucket", "n", "root"), "open", all_places)
    if not open_.isEmpty():
        link(_possible_pairs(open_, bags, similarity, kept))

    classes = nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc")
    least = classes.groupBy("root").agg(F.min("doc").alias("class_id"))
    by_node = classes.join(least, "root").select("node", "root", "class_id")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    out = keep(signed.select("doc_id", "key", "node").join(by_node, "node", "left").select("doc_id", "key", "node", "root", class_id), "classes")
    for df in used:
        drop_kept(df)
    return out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) for each row of docs.

    Pairs of similarity below the threshold aren't linked, but members of a class may be less
    alike than that if others link them. Null or wordless texts belong to no pair: their class is
    their own doc_id. A text of one to four words is a single shingle. Rows with equal words share
    a class whatever their doc_id; null doc_ids get the smallest doc_id of their class that isn't
    null, or null. Repeated rows keep a row each; an empty table gives none; very long texts are
    signed whole; other columns are not read.
    """
    return row_classes(docs, **options).select("doc_id", "class_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class; columns stay as they are, whatever their names.

    That row has the class's smallest doc_id, or none if no row of the class has one, and of such
    rows the smallest digest of the text. Of rows that repeat its doc_id and text one stays. Rows
    without words belong to no class and all stay.
    """
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    own = row_classes(docs, **options).where("node IS NOT NULL").groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("first")
    id_, key, n, own_id, own_key = unused(docs, "id", "key", "n", "own_id", "own_key")
    kept = own.groupBy("root").agg(first).select(F.col("first.doc_id").alias(id_), F.col("first.key").alias(key), F.col("first.n").alias(n))
    kept = keep(kept, "kept")
    worded = F.coalesce(col(text).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    rows = docs.where(worded).withColumn(own_id, col(doc_id).cast("long")).withColumn(own_key, _key(text))
    rows = rows.join(kept, (F.col(own_key) == F.col(key)) & F.col(own_id).eqNullSafe(F.col(id_)))
    if not kept.where(F.col(n) > 1).isEmpty():
        rows = rows.where(F.col(n) == 1).unionByName(rows.where(F.col(n) > 1).dropDuplicates([own_id, own_key]))
    columns = [col(c) for c in docs.columns]
    return docs.where(~worded).select(*columns).unionByName(rows.select(*columns))
