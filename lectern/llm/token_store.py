"""Token ids as wavelet matrices: one compressed file for each shard of consecutive documents.

Documents are dealt by ranges of doc_id and encoded where they land; each task packs runs of
documents into shards. A shard file holds the bit planes of a wavelet matrix over its token ids,
cut into blocks that are compressed one by one, and for each plane a directory: where each block
lies and how many ones stand before it. The directory serves ranks (ones before a place) and, by
bisection, selects (the place of a one or zero), so token access, counting and occurrence lookup
unpack a block or two of each plane. Spark's own writer commits the files to the shared folder,
which makes the write atomic for each task and lets it go to any store that Spark can reach.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, col, slices

#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 19
#: The id that ends each document.
END_ID = 2
#: First bytes and version of a shard file.
MAGIC = b"LWMX\x02"
#: Bytes of a block of a plane (before compression).
BLOCK = 1 << 13


def wavelet_planes(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Bit planes of a sequence of ids, highest bit first, each stably split by the plane before, and their zeros."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros = [], []
    for b in range(bits - 1, -1, -1):
        ones = (x >> x.dtype.type(b)) & x.dtype.type(1) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        low = np.compress(~ones, x)
        zeros.append(len(low))
        x = np.concatenate([low, np.compress(ones, x)])
    return planes, zeros


def pack_wavelet(ids: np.ndarray) -> bytes:
    """n, planes; the zeros of each plane; per plane the blocks' ends and the ones before them; the blocks."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = wavelet_planes(ids)
    ends, before, body, at = [], [], [], 0
    for plane in planes:
        cut = [plane[i : i + BLOCK] for i in range(0, len(plane), BLOCK)]
        ones = [int(np.bitwise_count(c).sum(dtype=np.int64)) for c in cut]
        before.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]))
        for c in cut:
            body.append(pack(c.tobytes()))
            at += len(body[-1])
            ends.append(at)
    return b"".join([
        struct.pack("<QB", len(ids), len(planes)), np.array(zeros, "<u8").tobytes(),
        np.array(ends, "<u8").tobytes(), np.concatenate(before).astype("<u8").tobytes(), *body,
    ])


class WaveletMatrix:
    """Reads a packed wavelet matrix; unpacks only the blocks that an answer needs and counts them."""

    def __init__(self, data: bytes):
        import zstandard

        self.n, levels = struct.unpack_from("<QB", data)
        self.blocks = -(-(-(-self.n // 8)) // BLOCK)
        at = 9
        self.zeros = np.frombuffer(data, "<u8", levels, at).astype(np.int64)
        at += 8 * levels
        self.ends = np.frombuffer(data, "<u8", levels * self.blocks, at).astype(np.int64)
        at += 8 * levels * self.blocks
        self.before = np.frombuffer(data, "<u8", levels * (self.blocks + 1), at).astype(np.int64).reshape(levels, -1)
        at += 8 * levels * (self.blocks + 1)
        self.data, self.at, self.levels = data, at, levels
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.unpacked: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        return cls(pack_wavelet(ids))

    def _bytes(self, level: int, block: int) -> np.ndarray:
        i = level * self.blocks + block
        begin = int(self.ends[i - 1]) if i else 0
        return np.frombuffer(self.unpack(self.data[self.at + begin : self.at + int(self.ends[i])], max_output_size=BLOCK), np.uint8)

    def _bits(self, level: int, block: int) -> np.ndarray:
        """The bits of one block of a plane."""
        found = self.unpacked.get((level, block))
        if found is None:
            found = np.unpackbits(self._bytes(level, block), bitorder="little")[: self.n - block * BLOCK * 8]
            self.unpacked[level, block] = found
        return found

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        y = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self._bytes(level, b) for b in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)
            ones, x = np.unpackbits(plane, count=self.n, bitorder="little").view(bool), np.empty(self.n, kind)
            x[np.flatnonzero(~ones)] = y[: self.zeros[level]]
            x[np.flatnonzero(ones)] = y[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            y = x
        return y.astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane: the directory's count, and what its block adds."""
        block, rest = divmod(i, BLOCK * 8)
        return int(self.before[level, block]) + (int(self._bits(level, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.levels):
            block, rest = divmod(i, BLOCK * 8)
            bit = int(self._bits(level, block)[rest])
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        low = 0
        if value < 0 or value.bit_length() > self.levels:
            return 0, 0
        for level in range(self.levels):
            if low == i:
                return 0, 0
            a, b = self._rank1(level, low), self._rank1(level, i)
            if value >> (self.levels - 1 - level) & 1:
                low, i = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, i = low - a, i - b
        return low, i

    def rank(self, value: int, i: int) -> int:
        """How often value occurs among the first i ids."""
        low, high = self._range(value, i)
        return high - low

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th ones or zeros of a plane, for ascending k."""
        before = self.before[level] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK * 8, self.n) - self.before[level]
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block):
            own = block == b
            out[own] = b * BLOCK * 8 + np.flatnonzero(self._bits(level, int(b)) == bit)[k[own] - before[b]]
        return out

    def places(self, value: int, first: int = 0, end: int | None = None) -> np.ndarray:
        """The places of the occurrences number first to end (exclusive; all by default) of value, in order."""
        low, high = self._range(value, self.n)
        i = np.arange(low + max(0, first), high if end is None else min(high, low + end), dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of value, or -1."""
        found = self.places(value, k, k + 1) if k >= 0 else ()
        return int(found[0]) if len(found) else -1


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard file: magic, documents (id, null flag, length), then the packed wavelet matrix."""
    table = np.zeros(len(doc_ids), [("id", "<i8"), ("null", "u1"), ("n", "<u4")])
    table["id"], table["null"], table["n"] = [d or 0 for d in doc_ids], [d is None for d in doc_ids], lengths
    return MAGIC + struct.pack("<I", len(doc_ids)) + table.tobytes() + pack_wavelet(ids)


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Documents, their lengths and the wavelet matrix of a shard file."""
    if data[:5] != MAGIC:
        raise ValueError("not a shard file")
    (n,) = struct.unpack_from("<I", data, 5)
    table = np.frombuffer(data, [("id", "<i8"), ("null", "u1"), ("n", "<u4")], count=n, offset=9)
    docs = [None if null else int(i) for i, null in zip(table["id"], table["null"], strict=True)]
    return docs, table["n"].astype(np.int64), WaveletMatrix(data[9 + table.nbytes :])


# The normalizer and splitter of tokenizers whose texts can be cut into units.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that these treat alike one by one. Texts of these are cut into units by bytes; the
#: other texts are cut at white space, and runs with other characters go to the tokenizer as they stand.
PLAIN = re.compile(r"[ -&(-;=-~\n\t\rÀ-ÖØ-öø-ÿ]*")
#: Units longer than this are told apart by themselves and not by their hashes.
LONG_UNIT = 64


def _byte_letters() -> dict[int, str]:
    """str.translate table from characters below 256 to the letters that stand for their UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


def _plain_bytes() -> tuple[bytes, np.ndarray]:
    """For the UTF-8 bytes of plain texts: lower case, and kinds (0 white space, 1 letter, 2 digit, 3 sign).

    Of characters from U+00C0 to U+00FF the second byte tells the case (U+00DF has one case).
    """
    lower = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
    kind = np.full(256, 3, np.uint8)
    kind[list(b" \n\t\r")] = 0
    kind[[*range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    return lower, kind


class UnitEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, each distinct unit once.

    A unit is a run of letters, a digit or a run of signs, which the tokenizer's splitter never
    joins; its model is asked for the units that are new, and texts are put together from units.
    Units of a piece of texts are found and numbered by array operations. Tokenizers with another
    splitter encode whole texts.
    """

    LOWER, KIND = _plain_bytes()
    LETTERS = _byte_letters()
    #: Odd bases of the two hashes that stand for a unit of up to LONG_UNIT bytes.
    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normal, split = (json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        cut = split.get("pretokenizers") or [{}]
        self.by_units = (
            normal.get("normalizers") == NORMALIZERS
            and cut[0].get("pattern") == {"Regex": SPLITTER}
            and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
            and type(self.tokenizer.model).__name__ == "BPE"
        )
        self.most = most
        self.powers = [self._powers(b) for b in self.BASES]
        self._forget()

    @staticmethod
    def _powers(base: int, n: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(base))]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(base, -1, 1 << 64)))]))
        return up, down

    def _forget(self) -> None:
        self.runs: dict[str, int] = {}  # numbers of units that are known by themselves
        self.keys, self.checks, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, ids: list[list[int]]) -> np.ndarray:
        """Numbers of new units, of which `ids` are the encodings."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.length)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([self.flat, np.fromiter((i for own in ids for i in own), np.uint32, int(n.sum()))])
        return np.arange(first, first + len(ids))

    def _plain_unit(self, unit: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(unit if unit.isascii() else unit.translate(self.LETTERS))]

    def _by_run(self, units: list[str]) -> np.ndarray:
        """Numbers of units by the units themselves."""
        new = [u for u in dict.fromkeys(units) if u not in self.runs]
        plain = [PLAIN.fullmatch(u) is not None for u in new]
        other = iter(self.tokenizer.encode_batch_fast([u for u, p in zip(new, plain, strict=True) if not p], add_special_tokens=False))
        self.runs.update(zip(new, self._learn([self._plain_unit(u) if p else next(other).ids for u, p in zip(new, plain, strict=True)]).tolist(), strict=True))
        return np.fromiter(map(self.runs.__getitem__, units), np.int64, len(units))

    def _by_bytes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, first bytes) of the units of plain texts."""
        lower = data.translate(self.LOWER)
        a = np.frombuffer(lower, np.uint8)
        kind = np.concatenate([[0], self.KIND[a], [0]])
        inside = kind[1:-1] != 0
        starts = np.flatnonzero(inside & ((kind[1:-1] != kind[:-2]) | (kind[1:-1] == 2)))
        ends = np.flatnonzero(inside & ((kind[1:-1] != kind[2:]) | (kind[1:-1] == 2))) + 1
        if len(a) > len(self.powers[0][0]):
            self.powers = [self._powers(b, 1 << len(a).bit_length()) for b in self.BASES]
        size = (ends - starts).astype(np.uint64)
        key, check = (self._sums(a, starts, ends, up, down) * np.uint64(257) + size for up, down in self.powers)
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        known = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        old = self.keys[known] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        number = np.empty(len(uniq), np.int64)
        number[old] = self.numbers[known[old]]
        unlike = (check[first][back] != check).any() or (self.checks[known[old]] != check[first][old]).any()
        if unlike or (size > LONG_UNIT).any():  # some units can't be told apart by their hashes
            return self._by_run([lower[i:j].decode() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]), starts
        at = first[~old]
        number[~old] = self._learn([self._plain_unit(lower[i:j].decode()) for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        order = np.argsort(keys := np.concatenate([self.keys, uniq[~old]]), kind="stable")
        self.keys, self.checks, self.numbers = keys[order], np.concatenate([self.checks, check[at]])[order], np.concatenate([self.numbers, number[~old]])[order]
        return number[back], starts

    @staticmethod
    def _sums(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """sum of byte * base^i over each unit, i counted from its start."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(a * up[: len(a)], dtype=np.uint64)])
        return (sums[ends] - sums[starts]) * down[starts]

    @staticmethod
    def units(text: str) -> list[str]:
        """Units of a text that has other characters: plain runs in lower case, the rest as it stands."""
        out: list[str] = []
        for run in re.split(r"[ \n\t\r]+", text):
            out += re.findall(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+", run.lower()) if PLAIN.fullmatch(run) else [run]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        if not self.by_units:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for own in found for i in own), np.uint32, int(n.sum())), n
        if len(self.length) > self.most:
            self._forget()
        plain = [i for i, t in enumerate(texts) if t and PLAIN.fullmatch(t)]
        data = [texts[i].encode() for i in plain]
        numbers: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        if plain:
            number, starts = self._by_bytes(b"\n".join(data))
            bounds = np.cumsum([len(d) + 1 for d in data])[:-1]
            for i, own in zip(plain, np.split(number, np.searchsorted(starts, bounds)), strict=True):
                numbers[i] = own
        for i in set(range(len(texts))) - set(plain):
            if texts[i]:
                numbers[i] = self._by_run(self.units(texts[i]))
        at = np.concatenate([np.zeros(0, np.int64), *numbers])
        n = self.length[at]
        before = np.cumsum(n) - n
        where = np.arange(int(n.sum())) + np.repeat(self.begin[at] - before, n)
        upto = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(own) for own in numbers])]
        return self.flat[where], np.diff(np.concatenate([[0], upto]))


SHARD = "part int, shard int, part_start bigint, n_docs int, n_tokens bigint, file binary"
SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("file", pa.binary())])


def _encode(tokenizer: str, end_id: int | None, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = UnitEncoder(tokenizer), TaskContext.get().partitionId()
        docs: list[int | None] = []
        lengths: list[int] = []
        runs: list[np.ndarray] = []
        held, shard, start = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, lengths, runs, held, shard, start
            row = [[part], [shard], [start], [len(docs)], [held], [write_shard(docs, lengths, np.concatenate(runs) if runs else np.zeros(0, np.uint32))]]
            shard, start = shard + 1, start + held
            docs, lengths, runs, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, SHARD_ARROW, strict=True)], schema=SHARD_ARROW)

        for batch in slices(batches, "text", 1_000_000):
            ids, n = encoder.encode(batch.column("text").to_pylist())
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
            bounds = np.concatenate([[0], np.cumsum(n)])
            own = batch.column("doc_id").to_pylist()
            first = 0
            for i in range(len(own)):
                if held + bounds[i + 1] - bounds[first] >= shard_tokens or i == len(own) - 1:
                    docs += own[first : i + 1]
                    lengths += n[first : i + 1].tolist()
                    runs.append(ids[bounds[first] : bounds[i + 1]])
                    held += int(bounds[i + 1] - bounds[first])
                    first = i + 1
                    if held >= shard_tokens:
                        yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode docs in ascending doc_id order into shard files below `path`.

    `tokenizer` is the path of a tokenizers file that exists on every executor. Null texts count
    as empty and get the end id alone; null doc_ids come first; very long texts are encoded whole;
    rows that repeat a doc_id are all kept, ordered by a hash of the text, so that an id which
    many rows share, or the null id, is dealt to many tasks; equal rows are told apart by where
    they were read. An empty table writes no shard. Other columns are not read.
    """
    source = bound_batches(docs).select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("row").asc()]
    ordered = source.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    shards = ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id, shard_tokens), SHARD)
    shards.write.option("parquet.block.size", 8 << 20).option("compression", "uncompressed").parquet(path)


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """The shards below `path`, each with the number of ids that stand before it.

    Only totals of a write task's shards are ordered in one place, never documents or ids.
    """
    from pyspark.sql import Window

    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return shards.join(totals, "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before", "part_start")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "file", 1):
        for data, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            docs, n, matrix = read_shard(data)
            ids = matrix.decode().astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(n)])
            first = 0
            while first < len(docs):  # a batch of at most 2^24 ids, or one document
                end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + (1 << 24), "right")) - 1)
                offsets = ((bounds[first : end + 1] - bounds[first]) * 4).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids[bounds[first] : bounds[end]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(docs[first:end], pa.int64()), pa.array(start + bounds[first:end]), pa.array(n[first:end]), column], names=["doc_id", "start", "n_tokens", "ids"])
                first = end


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (little-endian uint32) from the files."""
    return shard_table(spark, path).select("file", "start").mapInArrow(_decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """For each shard: its start, how often a token occurs (n), and the places of all occurrences.

    Both come from ranks and selects on the bit planes; only blocks that these touch are unpacked.
    """

    def run(batches):
        for batch in slices(batches, "file", 1):
            for data, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                places = read_shard(data)[2].places(token) + start
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([len(places)], pa.int64()), pa.array([places], pa.list_(pa.int64()))], names=["start", "n", "places"])

    return shard_table(spark, path).select("file", "start").mapInArrow(run, "start bigint, n bigint, places array<bigint>")
