"""License scans by diagonal voting.

The rolling hashes of every document's word pairs and triples are joined with the places of the
same grams in the templates: pairs for base phrases, triples for passages. A vote lies on the
diagonal `place in document - place in template`; votes are counted by diagonal, and a diagonal is
merged with those that follow it by up to NEIGHBOUR words, which lets a few words come or go. A
span is as long as its template and these few words, however often a text repeats it.

Spans with enough votes are verified: the words of the document are compared with those of the
template word by word, and a span counts if enough of the template's words are there. A phrase
counts where all its words stand on one diagonal. Passages that overlap compete: of two templates
with words in the same place the one with more of its words there stays, or with the greater share if
as many are, so a licence isn't taken for a sibling whose notice differs in a few words.

The templates are a short fixed list, so their side of the join is broadcast. Votes are grouped by
text, so no common line meets in one task and copies are judged once; only texts with a template's
gram bring their words to the verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .common import WordHashes, bound_batches, col, rolling, slices, words_of
from .license_templates import PASSAGES, PHRASES

#: Words of a gram of phrases (the shortest has as many) and of passages.
PHRASE_GRAM, PASSAGE_GRAM = 2, 3
#: Diagonals up to so many words behind one belong to its span.
NEIGHBOUR = 3
#: Share of a passage's grams that vote for a span which is verified, and of its words that then are there.
VOTES, COVERAGE = 0.3, 0.7


def templates() -> list[tuple[int, str, bool, list[str], int]]:
    """(number, label, is base phrase, words, words of a gram) of all templates."""
    both = [(label, text, True, PHRASE_GRAM) for label, text in PHRASES] + [(label, text, False, PASSAGE_GRAM) for label, text in PASSAGES]
    return [(n, label, base, [w.decode() for w in words_of(text.encode())], k) for n, (label, text, base, k) in enumerate(both)]


def _grams(hashes: np.ndarray) -> np.ndarray:
    """All pairs, then all triples of a text."""
    return np.concatenate([rolling(hashes, PHRASE_GRAM), rolling(hashes, PASSAGE_GRAM)]).view(np.int64)


def template_places() -> list[tuple[int, int, int]]:
    """(gram, template, place) of every gram of every template."""
    words = WordHashes()
    return [(int(g), n, i) for n, _, _, own, k in templates() for i, g in enumerate(rolling(words.of([" ".join(own).encode()])[0], k).view(np.int64))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in slices(batches, "text", 1 << 20):
        hashes = words.of(batch.column("text").to_pylist())
        grams = [_grams(h) for h in hashes]
        bounds = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(grams)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(h) for h in hashes], pa.int64()), column], names=["key", "n_words", "grams"])


def _words_of_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the texts that have any gram of a template."""
    words, wanted = WordHashes(), np.unique([g for g, _, _ in template_places()])
    for batch in slices(batches, "text", 1 << 20):
        texts = batch.column("text").to_pylist()
        part = batch.filter(pa.array([np.isin(_grams(h), wanted).any() for h in words.of(texts)], pa.bool_()))
        own = [words_of(t) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(own, pa.list_(pa.binary()))], names=["key", "words"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in slices(batches, "text", 1 << 20):
        n = [len(h) for h in words.of(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(n, pa.int64())], names=["key", "doc_id", "n_words"])


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, base_places, base_labels, labels, score, spans.

    base_places: word places of the base phrases; base_labels and labels: distinct and sorted;
    score: the largest share of a template's words that a verified span holds (0: none); spans:
    (label, first word, end, share) of what counts, of spans of one template that start within
    NEIGHBOUR words the best, or the first of equals.

    Null texts count as empty. Rows that repeat a doc_id are separate documents; null doc_ids
    stay; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    source = bound_batches(docs).select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    keyed = source.withColumn("key", F.unhex(F.md5("text")))
    kind = source.schema["doc_id"].dataType.simpleString()
    grams = keyed.select("key", "text").mapInArrow(_scan, "key binary, n_words bigint, grams array<bigint>")
    pairs = F.greatest(F.col("n_words") - (PHRASE_GRAM - 1), F.lit(0))
    at = F.when(F.col("pos") < pairs, F.col("pos")).otherwise(F.col("pos") - pairs)
    places = grams.select("key", "n_words", F.posexplode("grams").alias("pos", "gram")).select("key", at.cast("int").alias("at"), "gram")
    template = spark.createDataFrame(template_places(), "gram bigint, template int, place int")
    votes = places.join(F.broadcast(template), "gram").select("key", "template", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    diagonals = votes.groupBy("key", "template", "diagonal").agg(F.collect_set("place").alias("places"))

    order = Window.partitionBy("key", "template").orderBy("diagonal")
    merged = F.array_distinct(F.flatten(F.collect_list("places").over(order.rangeBetween(0, NEIGHBOUR))))
    own = spark.createDataFrame([(n, label, base, w, len(w) - k + 1) for n, label, base, w, k in templates()], "template int, label string, base boolean, wanted array<string>, grams int")
    own = own.withColumn("wanted", F.transform("wanted", lambda w: w.cast("binary")))
    voted = diagonals.withColumn("merged", F.size(merged)).join(F.broadcast(own), "template")
    enough = F.when(F.col("base"), F.size("places") == F.col("grams")).otherwise(F.col("merged") >= VOTES * F.col("grams"))
    words = keyed.select("key", "text").mapInArrow(_words_of_hits, "key binary, words array<binary>").dropDuplicates(["key"])
    spans = voted.where(enough).join(words, "key")

    def there(word, i):  # the word of the template stands on one of the span's diagonals
        places = [F.get("words", F.col("diagonal") + i + d) for d in range(NEIGHBOUR + 1)]
        alone = F.coalesce(places[0] == word, F.lit(False))
        return F.when(F.col("base"), alone).otherwise(F.array_contains(F.array(*[F.coalesce(p, F.lit(b"")) for p in places]), word))

    found = F.size(F.filter(F.transform("wanted", there), lambda x: x))
    counted = spans.withColumn("size", F.size("wanted")).withColumn("found", found).withColumn("share", F.col("found") / F.col("size"))
    verified = counted.where(F.when(F.col("base"), F.col("share") == 1).otherwise(F.col("share") >= COVERAGE))
    longest = max(len(w) for _, _, _, w, _ in templates())  # so rivals are the few spans that start near
    rivals = F.collect_list(F.struct("template", "diagonal", "size", "found", "share")).over(Window.partitionBy("key", "base").orderBy("diagonal").rangeBetween(-longest, longest))

    def better(r):
        shares_place = (r["diagonal"] < F.col("diagonal") + F.col("size")) & (F.col("diagonal") < r["diagonal"] + r["size"])
        return (r["template"] != F.col("template")) & shares_place & ((r["found"] > F.col("found")) | ((r["found"] == F.col("found")) & (r["share"] > F.col("share"))))

    checked = verified.withColumn("rivals", F.when(~F.col("base"), rivals)).where(F.col("base") | ~F.exists("rivals", better)).drop("rivals")
    near = order.rangeBetween(-NEIGHBOUR, NEIGHBOUR)
    best = F.max(F.struct("share", (-F.col("diagonal")).alias("first"))).over(near)
    kept = checked.withColumn("best", F.col("base") | (best["first"] == -F.col("diagonal")))
    start = F.greatest(F.col("diagonal"), F.lit(0)).cast("long")
    one = F.struct("label", start.alias("first"), (F.col("diagonal") + F.size("wanted")).cast("long").alias("end"), "share")
    by_key = kept.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("diagonal")))).alias("base_places"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("best"), one))).alias("spans"),
    )
    by_key = keep(by_key, "licenses")  # a table of its own, so that the join can split a text that many rows have
    none = {c: F.coalesce(c, F.array().cast(by_key.schema[c].dataType)) for c in ("base_places", "base_labels", "labels", "spans")}
    sized = keyed.select("key", "doc_id", "text").mapInArrow(_counts, f"key binary, doc_id {kind}, n_words bigint")
    return sized.join(by_key, "key", "left").select("doc_id", "n_words", *[v.alias(c) for c, v in none.items() if c != "spans"], F.coalesce("score", F.lit(0.0)).alias("score"), none["spans"].alias("spans"))
