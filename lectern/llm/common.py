"""What several corpus operators share: words, slices of batches, hashes, projections."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z become a-z and every byte outside digits, letters and non-ASCII becomes a space, so
#: that bytes.split() yields the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches are bounded by bytes from now on, as texts differ much in length."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; none of a null text."""
    return text.translate(WORD_BYTES).split() if text else []


def as_bytes(df: DataFrame, text: str = "text", out: str = "__text") -> DataFrame:
    """The text column as UTF-8 bytes, which reach Python without a decoding step."""
    return df.withColumn(out, F.col(text).cast("string").cast("binary"))


def pieces(column: pa.Array, most: int = 2 << 20, rows: int = 10_000) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces with at most `most` bytes and `rows` rows, or one row."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    start = 0
    while start < len(column):
        end = max(start + 1, min(start + rows, int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1))
        yield start, end - start
        start = end


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds at most `most` bytes of `column` and `rows` rows, or one row.

    What Arrow's pool holds beyond that is given back when the task ends, as workers outlive tasks.
    """
    for batch in batches:
        for first, n in pieces(batch.column(batch.schema.get_field_index(column)), most, rows):
            yield batch.slice(first, n)
    give_back()


def give_back() -> None:
    """Return to the system what a task has used: a worker outlives its tasks and would hold it beside those of the next stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that a column of df bears, so that nothing of df is hidden."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its plain name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer with full avalanche, on uint64 arrays."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lists:
    """Numbered lists of small numbers, one after another."""

    def __init__(self, lists: list, dtype: type):
        self.flat, self.begin, self.n = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.add(np.fromiter(chain.from_iterable(lists), dtype, int(n.sum())), n)

    def add(self, flat: np.ndarray, n: np.ndarray) -> None:
        """Number further lists, given one after another with their lengths."""
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, flat])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of the numbers one after another, the length of each)."""
        n = self.n[numbers]
        before = np.cumsum(n) - n
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.begin[numbers] - before, n)], n


class Numbers(dict):
    """Numbers of words, given in the order in which they are met; new: those met since it was emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordHashes:
    """64-bit hashes of the words of texts: sum of byte * BASE^i, finished by mix.

    All words of a piece of texts are hashed together. Sums over the whole piece give that of each word by a
    difference, divided by the power of its first place (BASE is odd, so powers have inverses).
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        n = 1 << n.bit_length()
        inverse = np.uint64(pow(int(self.BASE), -1, 1 << 64))
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.BASE))])
        self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, inverse))])

    def runs(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the runs of bytes other than blanks."""
        if len(a) > len(self.powers):
            self._grow(len(a))
        inside = np.concatenate([[False], a != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(a * self.powers[: len(a)], dtype=np.uint64)])
        return starts, mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def of(self, texts: list[bytes | None], table: bytes = WORD_BYTES) -> list[np.ndarray]:
        """The hashes of the words of each text in order; table: what bytes count as, blanks part words."""
        data = b" ".join([t or b"" for t in texts])
        starts, hashes = self.runs(np.frombuffer(data.translate(table), np.uint8))
        bounds = np.cumsum([len(t or b"") + 1 for t in texts])[:-1]
        return np.split(hashes, np.searchsorted(starts, bounds))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all windows of k word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:n])
    for j in range(1, k):
        out = mix(out ^ hashes[j : j + n])
    return out
