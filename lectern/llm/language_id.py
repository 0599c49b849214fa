"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps one bit of each language in every slot. Looking up an n-gram ANDs
the slots of its hashes, which yields at once all languages that contain it. A text's n-grams are
looked up together; each language's popcount, corrected for the filter's false positives, is
its share of known n-grams, and the largest share decides.

The slots are made in tasks and written, 64 languages a word. As many words of all slots as
FILTER_BYTES hold are broadcast together; with more languages, the texts are read once for each
such part, and the two best languages so far go on with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .common import bound_batches, col, mix, slices

#: Bytes of an n-gram, hashes of an n-gram, slots of the filter for each n-gram of the largest language.
N, HASHES, ROOM = 4, 2, 16
#: Labelled rows sampled for each language (expected number).
SAMPLE = 1000
#: An n-gram belongs to a language if this share of its sampled texts have it, and if that is no
#: less than this part of the largest share of any language.
LEAST_SHARE, LEAST_PART = 0.004, 0.35

LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams_of(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the lower-cased words, each word between blanks."""
    if not text:
        return np.empty(0, np.uint64)
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" "
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < N:
        return np.empty(0, np.uint64)
    g = a[: len(a) - N + 1].copy()
    for j in range(1, N):
        g = (g << np.uint32(8)) | a[j : len(a) - N + 1 + j]
    return g.astype(np.uint64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


#: Bytes of a part of the filter that is broadcast.
FILTER_BYTES = 64 << 20


@dataclass
class Filter:
    """Some languages of the bit-sliced filter, those of one or more words of each slot, and their false-positive rates."""

    languages: list[str]
    bits: np.ndarray  # (slots, words)
    false: np.ndarray

    @classmethod
    def of(cls, languages: list[str], bits: np.ndarray) -> Filter:
        out = cls(languages, bits, np.zeros(len(languages)))
        out.false = (out.counts(bits) / len(bits)) ** HASHES
        return out

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram, as bits."""
        out = self.bits[slot_of(grams, 0, len(self.bits))]
        for j in range(1, HASHES):
            out &= self.bits[slot_of(grams, j, len(self.bits))]
        return out

    def counts(self, masks: np.ndarray) -> np.ndarray:
        """How many of the masks have the bit of each language."""
        return np.array([np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.languages))], np.int64)

    def shares(self, masks: np.ndarray) -> np.ndarray:
        """Share of known n-grams for each language, corrected for false positives."""
        return np.clip((self.counts(masks) / max(1, len(masks)) - self.false) / (1 - self.false), 0.0, 1.0)

    def best(self, text: str) -> list[tuple[float, str]]:
        """The two languages with the largest shares, as (share, language)."""
        shares = self.shares(self.masks(grams_of(text)))
        return [(float(shares[i]), self.languages[i]) for i in np.argsort(-shares, kind="stable")[:2]]


def slot_of(grams: np.ndarray, j: int, slots: int) -> np.ndarray:
    return (mix(grams + np.uint64(j << 40)) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class Learned:
    """What is learned: languages in order, the most common one, the number of slots, and the table of (slot, word, bits)."""

    languages: list[str]
    common: str | None
    slots: int
    table: DataFrame | None

    def parts(self, most: int) -> list[tuple[int, int]]:
        """Ranges of words, each of at most `most` bytes over all slots, or one word."""
        words, step = -(-len(self.languages) // 64), max(1, most // (8 * self.slots))
        return [(w, min(w + step, words)) for w in range(0, words, step)]

    def filter(self, first: int, last: int) -> Filter:
        """The languages of the words first..last."""
        bits = np.zeros((self.slots, last - first), np.uint64)
        rows = self.table.where(F.col("word").between(first, last - 1)).toArrow()
        bits[np.asarray(rows.column("slot")), np.asarray(rows.column("word")) - first] = np.asarray(rows.column("bits")).astype(np.int64).view(np.uint64)
        return Filter.of(self.languages[first * 64 : last * 64], bits)


def held_out(name: str):
    """Rows that the filter may not learn from: crc32(doc_id as text) mod 5 is 0; null ids too."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [np.unique(grams_of(t)) for t in batch.column("text").to_pylist()]
        lang = np.repeat(np.array(batch.column("lang").to_pylist(), object), [len(t) for t in texts])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(texts).astype(np.int64))], names=["lang", "gram"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Learned:
    """Learn from about `sample` texts of each language, picked by a hash of their ids.

    Rows without language or text, and held-out rows, are passed over. Only the names of languages
    and their rows come to the driver; n-grams become slots in tasks.
    """
    known = bound_batches(docs).select(col("doc_id").alias("doc_id"), col("lang").cast("string").alias("lang"), col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    # tables of a row for each language, whose sizes Spark knows when it picks the joins
    rates = keep(known.groupBy("lang").agg(F.count("*").alias("rows")).withColumn("rate", F.lit(float(sample)) / F.col("rows")), "languages")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(F.col("text").isNotNull()).join(rates, "lang").where(chance < F.col("rate"))
    texts = keep(chosen.groupBy("lang").agg(F.count("*").alias("texts"), F.first("rows").alias("rows")), "sampled")
    share = chosen.select("lang", "text").mapInArrow(_distinct, "lang string, gram bigint").groupBy("lang", "gram").count().join(texts, "lang")
    share = share.select("lang", "gram", (F.col("count") / F.col("texts")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    top = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("own"))
    sizes = {r["lang"]: r["rows"] for r in texts.collect()}
    languages = sorted(sizes)
    if not languages:
        return Learned([], None, 1, None)
    numbers = docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, number int")
    owned = top.select("gram", F.explode(F.filter("own", lambda s: s["share"] >= LEAST_PART * F.col("top"))).alias("o")).select("gram", F.col("o.lang").alias("lang"))
    owned = keep(owned.join(F.broadcast(numbers), "lang").select("gram", "number"), "grams")
    most = owned.groupBy("number").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << max(10, (ROOM * most - 1).bit_length())
    bits = owned.mapInArrow(_bits(slots), "slot bigint, word int, bits bigint").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    return Learned(languages, min(languages, key=lambda x: (-sizes[x], x)), slots, keep(bits, "filter"))


def _bits(slots: int):
    """(slot, word, bit) of each (gram, number of a language), for each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, number = np.asarray(batch.column("gram")).view(np.uint64), np.asarray(batch.column("number")).astype(np.int64)
            slot = np.concatenate([slot_of(gram, j, slots) for j in range(HASHES)])
            word, bit = np.tile(number // 64, HASHES), np.tile(np.uint64(1) << (number % 64).astype(np.uint64), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word.astype(np.int32)), pa.array(bit.view(np.int64))], names=["slot", "word", "bits"])

    return run


BEST = pa.list_(pa.struct([("share", pa.float64()), ("lang", pa.string())]))


def _judge(part, common: str | None):
    """The two best languages of each text with one more part of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known: Filter | None = part.value if part is not None else None
            out = []
            for text, before in zip(batch.column("text").to_pylist(), batch.column("best").to_pylist(), strict=True):
                if known is None or not has_letter(text):
                    out.append([])
                    continue
                both = [(-b["share"], b["lang"]) for b in before or []] + [(-s, x) for s, x in known.best(text)]
                out.append([{"share": -s, "lang": x} for s, x in sorted(both)[:2]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, BEST)], names=["doc_id", "text", "best"])

    return run


def identify_language(docs: DataFrame, sample: int = SAMPLE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred (a learned language, or und without a letter), score (0 to 1).

    The score is the winner's part of the two largest shares; ties go to the language that sorts
    first. Null texts are und. Repeated rows keep a row each; null doc_ids are held out; with
    nothing to learn from every text is und; an empty table gives no rows. Only text enters a
    prediction. The result doesn't depend on filter_bytes.
    """
    learned = fit(docs, sample)
    kind = docs.select(col("doc_id")).schema[0].dataType.simpleString()
    empty = F.array().cast("array<struct<share:double,lang:string>>").alias("best")
    out = docs.select(col("doc_id").alias("doc_id"), col("text").cast("string").alias("text"), empty)
    parts = [docs.sparkSession.sparkContext.broadcast(learned.filter(*p)) for p in learned.parts(filter_bytes)[:1]] or [None]
    rest = learned.parts(filter_bytes)[1:] if learned.languages else []
    out = out.mapInArrow(_judge(parts[0], learned.common), f"doc_id {kind}, text string, best array<struct<share:double,lang:string>>")
    for p in rest:  # one part after another, so a task never holds two
        before = keep(out, "judged")
        out = before.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(learned.filter(*p)), learned.common), f"doc_id {kind}, text string, best array<struct<share:double,lang:string>>")
    second = F.coalesce(F.get("best", F.lit(1))["share"], F.lit(0.0))
    share = F.get("best", F.lit(0))["share"]
    lang = F.when(F.size("best") == 0, "und").when(share == 0, F.lit(learned.common)).otherwise(F.get("best", F.lit(0))["lang"])
    score = F.when((F.size("best") == 0) | (share == 0), 0.0).otherwise(F.round(share / (share + second), 6))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), lang.alias("lang_pred"), score.alias("score"))
