"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

The terms of a document are its words (hashed), the shapes of its tokens (runs of lower case,
upper case, digits and signs), words that repeat the word before, and coarse bands of length,
variety and casing. A bounded sample of labelled rows gives the term weights (inverse document
frequencies) and a truncated SVD; its projected vectors are broadcast (their number is bounded, so
is their size). Every document is projected the same way and compared with all sampled vectors by
blocked matrix products; the labels of the nearest are weighted by their cosine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bound_batches, col, give_back, pieces

#: Labelled rows that are sampled for each label, the bound of what is collected and broadcast.
SAMPLE = 2000
#: Hashed words, shapes and bands; dimensions kept, neighbours that vote, documents of a block and their bytes.
WORDS, SHAPES, BANDS = 2048, 896, 128
TERMS = WORDS + SHAPES + BANDS
DIMENSIONS, NEIGHBOURS, BLOCK, BLOCK_BYTES = 64, 25, 256, 1 << 20
#: Size of the word part, and of a band, against a shape part of size 1.
WORD_PART, BAND_PART = 0.35, 0.35
#: Score from which a document counts as good.
THRESHOLD = 0.7


#: For each byte: itself, or a blank for white space; its kind: a (lower case, or beyond ASCII), A, 0, a sign, or a blank.
TOKEN_BYTES = bytes(32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))
KIND_BYTES = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else TOKEN_BYTES[b] for b in range(256))


class Terms:
    """Term vectors of texts."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def shapes_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Hashes of the shapes of the tokens of each text: runs of bytes of one kind count once."""
        kinds = np.frombuffer(b" ".join(texts).translate(KIND_BYTES), np.uint8)
        kept = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])[: len(kinds)])
        starts, hashes = self.hashes.runs(kinds[kept])
        bounds = np.searchsorted(kept, np.cumsum([len(t) + 1 for t in texts])[:-1])
        return np.split(hashes, np.searchsorted(starts, bounds))

    def of(self, texts: list[str | None]) -> np.ndarray:
        """For each text: roots of the shares of its words and of its shapes, and bands."""
        out = np.zeros((len(texts), TERMS), np.float32)
        data = [(t or "").encode("utf-8", "replace") for t in texts]
        parts = zip(out, data, self.hashes.of(data), self.hashes.of(data, TOKEN_BYTES), self.shapes_of(data), strict=True)
        for row, text, words, tokens, shapes in parts:
            if len(words):
                row[:WORDS] = WORD_PART * np.sqrt(np.bincount((words % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / len(words))
            n = len(tokens)
            if n:
                row[WORDS : WORDS + SHAPES] = np.sqrt(np.bincount((shapes % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES) / n)
            counts = np.unique(tokens, return_counts=True)[1]
            again = int((tokens[1:] == tokens[:-1]).sum())
            for name, value in (
                ("length", min(n.bit_length(), 12)),
                ("again", 8 * again // n if n else -1),
                ("variety", 8 * len(counts) // n if n else -1),
                ("most", 8 * int(counts.max()) // n if n > 20 else -1),
                ("lines", int(8 * min(1.0, text.count(b"\n") * 10 / n)) if n else -1),
            ):
                row[WORDS + SHAPES + zlib.crc32(f"{name}{value}".encode()) % BANDS] += BAND_PART
        return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        for first, n in pieces(batch.column("text"), BLOCK_BYTES, BLOCK):
            part = batch.slice(first, n)
            rows = [r.astype("<f2").tobytes() for r in terms.of(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("pick"), part.column("label"), pa.array(rows, pa.binary())], names=["pick", "label", "terms"])


@dataclass
class Model:
    """Term weights, projection, and the sampled vectors with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms * self.weights) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest vectors, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        cosine = self.project(terms) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        # ties in the cosine go to the vector that comes first
        near = np.argpartition(-cosine.astype(np.float64) + np.arange(cosine.shape[1]) * 1e-12, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 8
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    """Rows that the model may not learn from: crc32(doc_id as text) mod 4 is 2; null ids too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def latent_axes(x: np.ndarray, weights: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading right singular vectors of x * weights (columns), by power iteration from a fixed start.

    Rows are weighted and widened by blocks, so x, which has half floats, is never held whole as anything wider.
    """

    def weighted() -> Iterator[np.ndarray]:
        for i in range(0, len(x), BLOCK):
            yield x[i : i + BLOCK].astype(np.float32) * weights

    rng = np.random.default_rng(5)
    axes = rng.normal(size=(x.shape[1], min(2 * dimensions, *x.shape)))
    for _ in range(6):
        axes = np.linalg.qr(sum(part.T @ (part @ axes) for part in weighted()))[0]
    _, _, turn = np.linalg.svd(np.concatenate([part @ axes for part in weighted()]), full_matrices=False)
    return (axes @ turn.T)[:, :dimensions]


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of term vectors x (half floats, in rows) and their labels y."""
    n = max(1, len(x))
    weights = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.3)
    axes = latent_axes(x, weights) if len(x) else np.zeros((TERMS, 0))
    model = Model(weights, np.ascontiguousarray(axes, np.float32), np.zeros((0, axes.shape[1]), np.float32), y)
    parts = [model.project(x[i : i + BLOCK].astype(np.float32)) for i in range(0, len(x), BLOCK)]
    model.vectors = np.concatenate([model.vectors, *parts]).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Learn from at most `sample` labelled rows of each label, picked by a hash of their ids.

    Only rows that aren't held out count; rows without a label or text are passed over. Texts
    become terms where they are read; what is ordered and collected are terms of bounded size.
    """
    known = labels.select(col("doc_id").alias("id"), col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    pick = F.xxhash64("id", F.lit(17))
    ids = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).dropDuplicates(["id"]).orderBy(pick, "id").limit(sample)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select(col("doc_id").alias("id"), col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(ids), "id").select(pick.alias("pick"), "label", "text").mapInArrow(_terms, "pick bigint, label int, terms binary")
    got = sorted((r.label, bytes(r.terms)) for r in rows.orderBy("pick", "label", "terms").limit(4 * sample).collect())
    y = np.array([g[0] for g in got], np.float64)
    x = np.empty((len(got), TERMS), "<f2")
    for row, (_, terms) in zip(x, got, strict=True):
        row[:] = np.frombuffer(terms, "<f2")
    del got
    model = learn(x, y)
    del x
    give_back()
    return model


def scorer(model: Model):
    """An Arrow function of a text column that gives its score; no other column leaves the JVM."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms()
        for column in texts:
            out = [np.zeros(0)]
            for first, n in pieces(column, BLOCK_BYTES, BLOCK):
                out.append(np.round(model.score(terms.of(column.slice(first, n).to_pylist())), 6))
            yield pa.array(np.concatenate(out))
        pa.default_memory_pool().release_unused()

    return score


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Null and empty texts are scored alike, by their bands alone; very long texts whole. Repeated
    rows keep a row each; null doc_ids are held out; without labelled rows every score is 0.5; an
    empty table gives no rows. Only text enters a score; other columns are not read.
    """
    score = scorer(fit(docs, labels, sample))
    scored = bound_batches(docs).select(col("doc_id").alias("doc_id"), score(col("text").cast("string")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows scored below threshold; columns stay as they are, whatever their names.

    Rows are scored where they are read, so no join follows. Edge cases as score_quality.
    """
    return bound_batches(docs).where(scorer(fit(docs, labels, sample))(col("text").cast("string")) >= threshold)
