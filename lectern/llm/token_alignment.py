"""Alignment of the tokens of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes, a space and the text. The last byte of a text ends a token of
either; an interval of tokens that ends at such a shared end is halved: from its middle token on,
the ends of one side are looked up among those of the other by bisection, in turns, until an end
that both share is found, first to the right and then to the left of the middle. The interval is
cut there and both halves are treated alike; an interval without a shared end inside is a group.
All intervals of a piece of texts are halved together, level by level.

A group's last tokens end together, which links them. A pair of linked ids has bytes of which one
is the end of the other, so that the vocabularies bound the number of pairs, whatever the corpus:
`possible_links` counts them. This bounds the table of counts, which is broadcast.

Words are cut before a blank that stands between two characters other than white space. No token
of either tokenizer holds such a blank behind its first byte, so the ends of words are shared cuts:
words are encoded and halved by themselves, and each distinct word once for as long as it is remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .common import Lists, Numbers, bound_batches, col, slices

MARK = "▁"
#: Bytes of text that are aligned together.
PIECE = 1 << 20
#: Linked pairs of ids that may be broadcast: 16 bytes each.
MOST_LINKS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable bytes are their own, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def byte_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizers file; none of ids that it lacks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    words = {i: bytes(letters[c] for c in w) for w, i in spec["model"]["vocab"].items() if all(c in letters for c in w)}
    words |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [words.get(i, b"") for i in range(max(words, default=-1) + 1)]


def piece_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a SentencePiece model: U+2581 is a blank, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = model.id_to_piece(list(range(model.get_piece_size())))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


def possible_links(a: list[bytes], b: list[bytes]) -> int:
    """Pairs of ids that can end together: one's bytes are the end of the other's."""
    from collections import Counter

    def ends(long: list[bytes], short: Counter, least: int) -> int:
        return sum(short[w[i:]] for w in long for i in range(least, len(w)))

    return ends(a, Counter(b), 0) + ends(b, Counter(a), 1)


def words_can_be_cut(byte_tokenizer: str, piece_model: str) -> bool:
    """Whether encoding words one by one gives the ids of whole texts, for what the two files say."""
    from sentencepiece import sentencepiece_model_pb2

    with open(byte_tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    model = sentencepiece_model_pb2.ModelProto()
    with open(piece_model, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    kept = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces and rules.add_dummy_prefix
    apart = model.trainer_spec.model_type == 2 and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces if p.type in (1, 4))
    return bool(plain and kept and apart)


class Side:
    """Ids of numbered words of one tokenizer."""

    def __init__(self, vocabulary: list[bytes]):
        self.bytes = vocabulary
        self.size = np.array([len(w) for w in vocabulary], np.int64)
        self.forget()

    def forget(self) -> None:
        self.words = Lists([], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def parts(self, ids: list[int], text: bytes, ends: np.ndarray) -> np.ndarray | None:
        """Ids of each part of a text, whose parts end at ends; None if its bytes don't come back or a token reaches over an end."""
        if self.joined(ids) != text:
            return None
        tokens = np.cumsum(self.size[ids])
        at = np.searchsorted(tokens, ends)
        return np.diff(at + 1, prepend=0) if (tokens[at] == ends).all() else None


def _shared_near(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For intervals [low, high) of places in a: a place near the middle whose end is in b too; -1 if there is none."""
    out = np.full(len(low), -1, np.int64)
    middle = (low + high) // 2
    live, at = np.arange(len(low)), middle
    while len(live):  # to the right: the next end of b, then the next end of a, until both are one
        end = b[np.searchsorted(b, a[at])]
        met = a[at] == end
        out[live[met]] = at[met]
        live, at = live[~met], np.searchsorted(a, end[~met])
        inside = at < high[live]
        live, at = live[inside], at[inside]
    live = np.flatnonzero((out < 0) & (middle > low))
    at = middle[live] - 1
    while len(live):  # to the left in the same way
        place = np.searchsorted(b, a[at], "right") - 1
        end = np.where(place >= 0, b[np.maximum(place, 0)], -1)
        met = a[at] == end
        out[live[met]] = at[met]
        live, at = live[~met], np.searchsorted(a, end[~met], "right") - 1
        inside = at >= low[live]
        live, at = live[inside], at[inside]
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ascending places in a whose ends are in b too, by halving the intervals first..last, whose last ends are shared.

    a, b: ascending ends of tokens.
    """
    found, low, high = [last], first[first < last], last[first < last]
    while len(low):
        cut = _shared_near(a, b, low, high)
        met = cut >= 0
        found.append(cut[met])
        low, high = np.concatenate([low[met], cut[met] + 1]), np.concatenate([cut[met], high[met]])
        some = low < high
        low, high = low[some], high[some]
    return np.sort(np.concatenate(found))


class Decimals:
    """Text of numbers, each followed by a sign."""

    def __init__(self, most: int):
        text = [str(i).encode() for i in range(most + 1)]
        self.n = np.array([len(t) for t in text], np.int64)
        width = int(self.n.max())
        self.digits = np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(-1, width)

    def of(self, numbers: np.ndarray, signs: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the text, where each number's sign stands)."""
        n = self.n[numbers]
        end = np.cumsum(n + 1)
        begin = end - n - 1
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        for i in range(self.digits.shape[1]):
            some = n > i
            out[begin[some] + i] = self.digits[numbers[some], i]
        out[end - 1] = signs
        return out.tobytes(), end - 1


class BothEncoder:
    """Words by both tokenizers, aligned."""

    #: A cut stands before a blank between two characters that are neither white space nor a mark.
    CUT = re.compile(rf"(?<=[^\s{MARK}])(?= [^\s{MARK}])")
    #: Blanks beside other white space.
    SPACES = re.compile(r" \s|\s ")
    #: Words that are encoded as one text.
    TOGETHER = 256

    def __init__(self, byte_tokenizer: str, piece_model: str, most: int = 200_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(byte_tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.a, self.b = Side(byte_vocabulary(byte_tokenizer)), Side(piece_vocabulary(piece_model))
        self.decimals = Decimals(max(len(self.a.bytes), len(self.b.bytes)))
        self.by_words, self.most = words_can_be_cut(byte_tokenizer, piece_model), most
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.whole = np.zeros(0, bool)  # whether both sides give the bytes of a blank and the word
        self.groups: list[bytes] = []  # a word's groups as text, each with a semicolon behind it
        self.links = Lists([], np.int64)  # the ids that end each group of a word, A's in the upper bits
        self.a.forget()
        self.b.forget()

    def words(self, text: str) -> list[str]:
        """Words of a text, each without the blank before it."""
        if not self.by_words:
            return [text]
        if self.stands_amid(text) and not self.SPACES.search(text):
            return text.split(" ")
        return [w[1:] for w in self.CUT.split(" " + text)]

    @staticmethod
    def stands_amid(word: str) -> bool:
        """Whether a text may be cut on both sides of a word: no white space at its ends and no mark."""
        return bool(word) and not word[0].isspace() and not word[-1].isspace() and MARK not in word

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and each text by both tokenizers."""
        a = self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in a], self.model.encode(texts, num_threads=1)

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of words.

        Words that may stand amid a text are joined by blanks, encoded as one text and cut again.
        If that text's bytes don't come back, its words are encoded one by one.
        """
        amid = [i for i, w in enumerate(new) if self.stands_amid(w)] if self.by_words else []
        batches = [amid[i : i + self.TOGETHER] for i in range(0, len(amid), self.TOGETHER)]
        texts = [" ".join([new[i] for i in batch]) for batch in batches]
        alone, order, sides = np.ones(len(new), bool), [], ([], [])
        for batch, text, *both in zip(batches, texts, *self._ids(texts), strict=True):
            ends = np.cumsum([len(new[i].encode()) + 1 for i in batch])
            want = b" " + text.encode()
            n = [side.parts(ids, want, ends) for side, ids in zip((self.a, self.b), both, strict=True)]
            if all(x is not None for x in n):
                alone[batch] = False
                order += batch
                for made, ids, x in zip(sides, both, n, strict=True):
                    made.append((ids, x))
        whole, rest = np.ones(len(new), bool), np.flatnonzero(alone)
        words = [new[i] for i in rest.tolist()]
        both = self._ids(words)
        whole[rest] = [self.a.joined(x) == self.b.joined(y) == b" " + w.encode() for w, x, y in zip(words, *both, strict=True)]
        place = np.empty(len(new), np.int64)
        place[np.concatenate([np.array(order, np.int64), rest])] = np.arange(len(new))
        for side, made, ids in zip((self.a, self.b), sides, both, strict=True):
            lists = Lists([], np.int64)
            flat = np.fromiter(chain.from_iterable(x for x, _ in made), np.int64)
            lists.add(flat, np.concatenate([np.zeros(0, np.int64), *(n for _, n in made)]))
            one = Lists(ids, np.int64)
            lists.add(one.flat, one.n)
            side.words.add(*lists.of(place))
        self._align(whole)

    def _align(self, whole: np.ndarray) -> None:
        """Keep the groups and links of the words learned last; whole: which of them come back."""
        at = len(self.whole) + np.flatnonzero(whole)
        (ids_a, n_a), (ids_b, n_b) = self.a.words.of(at), self.b.words.of(at)
        ends_a, ends_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        upto_a = np.cumsum(n_a)
        cuts_a = shared_cuts(ends_a, ends_b, upto_a - n_a, upto_a - 1)
        cuts_b = np.searchsorted(ends_b, ends_a[cuts_a])

        # ids of A and of B in turns by group, as text
        size_a, size_b = np.diff(cuts_a, prepend=-1), np.diff(cuts_b, prepend=-1)
        numbers, signs = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        numbers[np.arange(len(ids_a)) + np.repeat(cuts_b + 1 - size_b, size_a)] = ids_a
        numbers[np.arange(len(ids_b)) + np.repeat(cuts_a + 1, size_b)] = ids_b
        signs[cuts_a + cuts_b + 1 - size_b] = ord("|")
        signs[cuts_a + cuts_b + 1] = ord(";")
        text, ends = self.decimals.of(numbers, signs)
        stops = [0, *(ends[np.cumsum(n_a + n_b) - 1] + 1).tolist()]
        groups = iter([text[i:j] for i, j in zip(stops, stops[1:], strict=False)])
        self.groups += [next(groups) if w else b"" for w in whole.tolist()]
        n_links = np.zeros(len(whole), np.int64)
        n_links[whole] = np.bincount(np.searchsorted(upto_a, cuts_a, "right"), minlength=len(at))
        self.links.add((ids_a[cuts_a] << 21) | ids_b[cuts_b], n_links)
        self.whole = np.concatenate([self.whole, whole])

    def _as_one(self, text: str, numbers: np.ndarray) -> int:
        """The number of a text that comes back, though one of its words doesn't, as one word."""
        if (text,) not in self.known:
            for side in (self.a, self.b):
                ids = side.words.of(numbers)[0]
                side.words.add(ids, np.array([len(ids)]))
            self.known[(text,)] = len(self.known)
            self._align(np.ones(1, bool))
        return self.known[(text,)]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of aligned words, words of each text); none of a text whose bytes don't come back."""
        if len(self.known) > self.most:
            self.forget()
        cut = [self.words(t) if t else [] for t in texts]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        n_words = np.array([len(c) for c in cut], np.int64)
        broken = np.flatnonzero(~self.whole[at])
        if len(broken):
            upto = np.cumsum(n_words)
            own = np.split(at, upto[:-1])
            for i in np.unique(np.searchsorted(upto, broken, "right")).tolist():
                own[i] = np.array([self._as_one(texts[i], own[i])] if self._comes_back(texts[i], own[i]) else [], np.int64)
            at, n_words = np.concatenate(own), np.array([len(x) for x in own], np.int64)
        return at, n_words

    def _comes_back(self, text: str, numbers: np.ndarray) -> bool:
        want = b" " + text.encode()
        return all(side.joined(side.words.of(numbers)[0].tolist()) == want for side in (self.a, self.b))


LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))
ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, groups string, links array<struct<a:int,b:int,n:int>>"


def align_texts(encoder: BothEncoder, texts: list[str | None]) -> list[pa.Array]:
    """The columns of ALIGNED for some texts."""
    at, n_words = encoder.numbers(texts)
    upto = np.concatenate([[0], np.cumsum(n_words)])
    keys, n_links = encoder.links.of(at)
    n_a, n_b, n_groups = (np.diff(np.concatenate([[0], np.cumsum(n)])[upto]) for n in (encoder.a.words.n[at], encoder.b.words.n[at], n_links))
    words = list(map(encoder.groups.__getitem__, at.tolist()))
    stops = upto.tolist()
    groups = [b"".join(words[i:j])[:-1] for i, j in zip(stops, stops[1:], strict=False)]

    # distinct links of each text
    owner = np.repeat(np.arange(len(texts)), n_groups)
    key, times = np.unique((owner << 42) | keys, return_counts=True)
    bounds = np.searchsorted(key >> 42, np.arange(len(texts) + 1)).astype(np.int32)
    fields = [pa.array(x.astype(np.int32)) for x in ((key >> 21) & 0x1FFFFF, key & 0x1FFFFF, times)]
    links = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, names=["a", "b", "n"]))
    return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.binary()).cast(pa.string()), links]


def _align(byte_tokenizer: str, piece_model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = BothEncoder(byte_tokenizer, piece_model)
        for batch in slices(batches, "text", PIECE):
            made = align_texts(encoder, batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return run


def align_tokens(docs: DataFrame, byte_tokenizer: str, piece_model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups and links: the tokens of a text by both tokenizers, aligned.

    The files' paths must exist on every executor. A is a byte-level tokenizers file and encodes a
    space and the text, B a SentencePiece model, which adds the space itself; neither takes the
    names of special tokens in a text for them. groups reads `a1,a2|b1;a3|b2,b3`: ids of A and of B in order, a
    group ending where a token of either ends. links counts each distinct pair of ids that end a
    group of the text. A text that is null or empty, or whose bytes don't come back from the ids of
    either side, has no tokens and counts 0. Rows are aligned one by one: repeated rows and null ids stay,
    long texts are aligned whole, an empty table gives no rows, other columns are not read.
    """
    source = bound_batches(docs).select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_align(byte_tokenizer, piece_model), f"doc_id {kind}, {ALIGNED}")


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of all texts hold a pair of ids, and the highest count of its B id."""
    counts = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    return counts.join(best, "b").select("a", "b", "count", "best")


def _score(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, best = counts.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("links"))
            flat = column.flatten()
            a, b, n = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            at = np.searchsorted(key, (a << 21) | b)
            value = count[at] * n if len(at) else n
            top = np.where(best[at], n, 0) if len(at) else n
            bounds = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
            made = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (n, top, value)]
            keep_ = [i for i, name in enumerate(batch.schema.names) if name != "links"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep_), *map(pa.array, made)], names=[*(batch.schema.names[i] for i in keep_), "n_links", "n_best", "count_sum"])

    return run


def score_links(aligned: DataFrame, most: int) -> DataFrame:
    """aligned with n_links, n_best (links whose count is the highest of their B id) and count_sum in place of links.

    `most` is what possible_links says of the two vocabularies. It bounds the table of counts, so
    the table is sent to every task; a bound above MOST_LINKS is an error. aligned is read twice:
    give a written table.
    """
    if most > MOST_LINKS:
        raise ValueError(f"the vocabularies allow {most} pairs, more than can be broadcast")
    counts = link_counts(aligned).toArrow()
    a, b, n, best = (np.asarray(counts.column(c)).astype(np.int64) for c in ("a", "b", "count", "best"))
    if len(n) > most:
        raise ValueError("more pairs than the vocabularies allow")
    key = (a << 21) | b
    order = np.argsort(key)
    sent = aligned.sparkSession.sparkContext.broadcast((key[order], n[order], (n == best)[order]))
    rest = [f for f in aligned.schema.fields if f.name != "links"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return aligned.mapInArrow(_score(sent), f"{ddl}, n_links bigint, n_best bigint, count_sum bigint")


def aligned_digests(docs: DataFrame, byte_tokenizer: str, piece_model: str) -> DataFrame:
    """align_tokens and score_links of docs, the groups as their hash: '' without tokens."""
    aligned = align_tokens(docs, byte_tokenizer, piece_model)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    written = keep(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest, "links"), "aligned")
    return score_links(written, possible_links(byte_vocabulary(byte_tokenizer), piece_vocabulary(piece_model)))
