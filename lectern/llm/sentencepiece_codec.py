"""SentencePiece encoding and decoding with a shared-prefix trie of marked words.

A task sorts the distinct marked words of its texts, which is a depth-first walk of their trie:
between two neighbours only the part after their common prefix is new. For each prefix the
forward table keeps how its encoding ends, so a word continues from the table of the prefix that
it shares with the word before.

For a unigram model the table holds the best score of each prefix (Viterbi). The given model is a
BPE model, for which the largest sum of scores isn't the encoding: merges by rank are. There the
table holds the last piece of the encoding of each prefix. Of all pieces that end at a position,
exactly one can follow the last piece of the prefix before it without a merge between the two,
and walking back along these last pieces gives the encoding by merges. The trie of many words is
walked by levels: the prefixes of one length take their last pieces together, as arrays.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Lists, Numbers, bound_batches, col, give_back, pieces, unused

MARK = "▁"
#: Words of a text: a run of marks with what follows, cut before and after characters without a piece.
UNIGRAM, BPE = 1, 2


def _model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted key among ascending keys, whether it is there)."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Levels:
    """What a BPE model says of its pieces, as arrays: prefixes of one length are encoded together.

    Symbols are the pieces and the characters in them, numbered from 1; 0 is none, and a number above
    `last` is the character with that code point that stands in no piece. The longest piece
    at the end of each prefix, and the shorter ones after it, come from the trie of the pieces with
    links to the longest suffix of a state that is a state too.
    """

    SLOTS = 19

    def __init__(self, codec: Codec):
        symbols = ["", *sorted(set(codec.ids).union(*codec.ids))]
        number = {s: i for i, s in enumerate(symbols)}
        self.symbols, self.last = symbols, len(symbols) - 1
        self.size = np.array([len(s) for s in symbols], np.int32)
        self.spelt = Lists([codec.ids_of(s) if s else [] for s in symbols], np.uint32)
        self.rank = np.array([codec.rank.get(s, -1.0) if len(s) > 1 else -1.0 for s in symbols])
        #: Symbols whose rank says when they are formed; marks are doubled in, end or begin a symbol.
        self.plain = np.array([len(s) < 2 or s in codec.rank for s in symbols])
        self.marks = [np.array([test(s) for s in symbols]) for test in (lambda s: MARK * 2 in s, lambda s: s.endswith(MARK), lambda s: s.startswith(MARK))]
        halves = [codec.halves_of(s) if len(s) > 1 and s in codec.rank else ("", "") for s in symbols]
        self.left, self.right = (np.array([number.get(h[i], 0) for h in halves], np.int64) for i in (0, 1))
        self.reached = np.array([not s or codec.reachable(s) for s in symbols])
        joins = {number[s[:i]] * len(symbols) + number[s[i:]]: r for s, r in codec.rank.items() for i in range(1, len(s)) if s[:i] in number and s[i:] in number}
        self.joins = np.array(sorted(joins), np.int64)
        self.join_rank = np.array([joins[k] for k in self.joins.tolist()])

        #: Pairs compared last, by the upper bits of a product.
        self.slot_key, self.slot_holds = np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, bool)

        #: The class of each code point: characters in pieces count from 1.
        letters = [s for s in symbols if len(s) == 1]
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        self.own = np.array([0, *(number[c] for c in letters)], np.int64)
        # states by length, so that a state's link is known before those of longer ones
        states = ["", *sorted({p[:i] for p in codec.ids for i in range(1, len(p) + 1)}, key=lambda s: (len(s), s))]
        state = {s: i for i, s in enumerate(states)}
        parent = np.array([state[s[:-1]] for s in states], np.int64)
        by = np.array([self.letter[ord(s[-1])] if s else 0 for s in states], np.int64)
        steps = parent[1:] * self.letters + by[1:]
        order = np.argsort(steps)
        self.steps, self.step_to = steps[order], order + 1
        self.link = np.zeros(len(states), np.int64)
        piece = np.array([number[s] if s in codec.ids else 0 for s in states], np.int64)
        self.piece, self.shorter = piece.copy(), np.zeros(len(symbols), np.int64)
        bounds = np.cumsum([0, *np.bincount([len(s) for s in states])])
        for first, end in zip(bounds[1:-1], bounds[2:], strict=True):
            at = np.arange(first, end)
            if first > 1:
                self.link[at] = self.step(self.link[parent[at]], by[at])
            linked = self.piece[self.link[at]]
            self.shorter[piece[at][piece[at] > 0]] = linked[piece[at] > 0]
            self.piece[at] = np.where(piece[at] > 0, piece[at], linked)

    def step(self, state: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The longest state that ends each state and one more letter."""
        out = np.zeros(len(state), np.int64)
        live = np.flatnonzero(by > 0)
        state = state[live]
        while len(live):
            at, there = _found(self.steps, state * self.letters + by[live])
            out[live[there]] = self.step_to[at[there]]
            on = ~there & (state > 0)
            live, state = live[on], self.link[state[on]]
        return out

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Codec.stay_apart of pairs of symbols."""
        out = np.ones(len(left), bool)
        live, before, after = np.arange(len(left)), np.full(len(left), np.inf), np.full(len(left), -1.0)
        while len(live):
            at, there = _found(self.joins, left * len(self.size) + right)
            across = self.join_rank[at]
            joined = there & ((across < before) | (across == after))
            out[live[joined]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~joined & ((a >= 0) | (b >= 0))
            live, left, right, a, b = live[on], left[on], right[on], a[on], b[on]
            first = a > b
            before, after = np.where(first, a, b), np.where(first, -1.0, b)
            left, right = np.where(first, self.right[left], left), np.where(first, right, self.left[right])
        return out

    def can_follow(self, left: np.ndarray, right: np.ndarray, codec: Codec) -> np.ndarray:
        """Codec.can_follow of pairs of symbols; a character that stands in no piece is as nothing on the left."""
        keys = np.where(left > self.last, 0, left) * len(self.size) + right
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out, known = self.slot_holds[slot], self.slot_key[slot] == keys
        new = np.flatnonzero(~known)
        if len(new):
            fresh, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            holds = self._compare(fresh, codec)
            out[new] = holds[back]
            at = slot[new[first]]
            at, some = np.unique(at, return_index=True)
            self.slot_key[at], self.slot_holds[at] = fresh[some], holds[some]
        return out

    def _compare(self, keys: np.ndarray, codec: Codec) -> np.ndarray:
        left, right = keys // len(self.size), keys % len(self.size)
        out = self.reached[right]
        doubled, ends, begins = self.marks
        plain = self.plain[left] & self.plain[right] & ~(doubled[left] | doubled[right] | (ends[left] & begins[right]))
        some = np.flatnonzero(out & (left > 0) & plain)
        out[some] = self.stay_apart(left[some], right[some])
        for i in np.flatnonzero(out & (left > 0) & ~plain).tolist():
            out[i] = codec.can_follow(self.symbols[left[i]], self.symbols[right[i]])
        return out

    def encode(self, words: list[str], codec: Codec) -> tuple[np.ndarray, np.ndarray]:
        """(ids of ascending words one after another, ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max())
        points = np.ascontiguousarray(np.array(words, f"U{longest}").view(np.uint32).reshape(len(words), longest).T)
        last = np.zeros((longest, len(words)), np.int32)  # the last symbol of each prefix
        state, live = np.zeros(len(words), np.int64), np.arange(len(words))
        same = np.zeros(len(words), bool)  # whether a word shares the prefix with the one before
        same[1:] = True
        for d in range(longest):
            live = live[sizes[live] > d]
            same[1:] &= points[d, 1:] == points[d, :-1]
            same[1:] &= sizes[:-1] > d
            new = ~same[live]
            node = live[new]
            point = points[d, node]
            by = self.letter[point]
            at = self.step(state[node], by)
            found = np.where(by > 0, self.own[by], self.last + 1 + point.astype(np.int64))
            rest, piece = np.arange(len(node)), self.piece[at]
            while True:
                some = piece > 0
                rest, piece = rest[some], piece[some]
                if not len(rest):
                    break
                begin = d - self.size[piece]
                left = np.where(begin < 0, 0, last[begin, node[rest]]).astype(np.int64)
                fits = self.can_follow(left, piece, codec)
                found[rest[fits]] = piece[fits]
                rest, piece = rest[~fits], self.shorter[piece[~fits]]
            owner = np.cumsum(new) - 1
            last[d, live], state[live] = found[owner], at[owner]

        # back from the ends of the words
        rows, end, taken = np.arange(len(words)), sizes.copy(), []
        while len(rows):
            symbol = last[end - 1, rows].astype(np.int64)
            taken.append((rows, symbol))
            end = end - np.where(symbol > self.last, 1, self.size[np.minimum(symbol, self.last)])
            rows, end = rows[end > 0], end[end > 0]
        n = np.bincount(np.concatenate([r for r, _ in taken]), minlength=len(words))
        upto, symbols = np.cumsum(n), np.empty(int(n.sum()), np.int64)
        for i, (row, symbol) in enumerate(taken):
            symbols[upto[row] - 1 - i] = symbol
        strange = np.unique(symbols[symbols > self.last])
        spelt = self.spelt
        if len(strange):
            spelt = Lists([], np.uint32)
            spelt.add(self.spelt.flat, self.spelt.n)
            more = Lists([codec.ids_of(chr(s - self.last - 1)) for s in strange.tolist()], np.uint32)
            spelt.add(more.flat, more.n)
            symbols = np.where(symbols > self.last, self.last + 1 + np.searchsorted(strange, symbols), symbols)
        ids, each = spelt.of(symbols)
        return ids, np.add.reduceat(each, upto - n)


@lru_cache(maxsize=2)
def _levels(path: str, size: int, changed: int) -> Levels:
    return Levels(Codec(path))


def levels(path: str) -> Levels:
    """The arrays of a BPE model, made once in a worker."""
    about = os.stat(path)
    return _levels(path, about.st_size, about.st_mtime_ns)


class Decoder:
    """The bytes of a SentencePiece model's pieces: all that decoding needs."""

    def __init__(self, path: str):
        model = _model(path)
        self.dummy = MARK if model.normalizer_spec.add_dummy_prefix else ""
        special = {3: b"", 2: " ⁇ ".encode()}
        self.back = Lists([bytes([int(p.piece[3:5], 16)]) if p.type == 6 else special[p.type] if p.type in special else p.piece.replace(MARK, " ").encode() for p in model.pieces], np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the mark that encoding put first."""
        text = self.back.of(ids)[0].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


class Codec:
    """A SentencePiece model's pieces, encoded without its library."""

    #: So many words of like length are encoded by levels; fewer are walked one by one.
    many = 24

    def __init__(self, path: str, most: int = 200_000):
        self.path = path
        model = _model(path)
        spec, self.kind = model.normalizer_spec, model.trainer_spec.model_type
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is are supported")
        self.dummy = MARK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that join words aren't supported")
        self.longest = max(map(len, self.ids))
        self.single = {p for p in self.ids if len(p) == 1}
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.follows: dict[str, bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: Score of a character without a piece: the library's penalty below its smallest score.
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        #: Rank of each merge; pieces whose rank doesn't say when they are formed are compared by merging.
        self.rank = {p: -s for p, s in self.scores.items() if s > -1e8}
        self.known = Numbers()
        self.kept = Lists([], np.uint32)
        self.most = most

    # -- one word -------------------------------------------------------------------------

    def merged(self, word: str) -> list[str]:
        """BPE of a short string by its definition: join the best pair until none is left."""
        parts = list(word)
        while len(parts) > 1:
            pairs = [(-self.scores.get(a + b, -np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            score, i = min(pairs)
            if score == np.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves_of(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge completes a piece."""
        found = self.halves.get(piece)
        if found is None:
            score, parts, reached = self.scores.get, list(piece), True
            scores = [score(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            while len(parts) > 2:
                best = max(scores)
                i = scores.index(best)
                reached &= best != -np.inf
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                for j in (i - 1, i):
                    if 0 <= j < len(scores):
                        scores[j] = score(parts[j] + parts[j + 1], -np.inf)
            found = self.halves[piece] = (parts[0], parts[1])
            self.follows[piece] = reached and scores[0] != -np.inf
        return found

    def reachable(self, piece: str) -> bool:
        """Whether merging the characters of a piece gives the piece."""
        if len(piece) < 2:
            return True
        self.halves_of(piece)
        return self.follows[piece]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether no merge across the boundary of two pieces comes before the merges within them.

        Goes back in time: the later of the two pieces is taken apart, and what then touches the
        boundary must not merge across it before that piece was complete. Of equal ranks the merge
        further left comes first.
        """
        rank = self.rank
        before, after = np.inf, -1.0
        while True:
            across = rank.get(left + right)
            if across is not None and (across < before or across == after):
                return False
            a, b = rank.get(left, -1.0) if len(left) > 1 else -1.0, rank.get(right, -1.0) if len(right) > 1 else -1.0
            if a < 0 and b < 0:
                return True
            if a > b:
                before, after, left = a, -1.0, self.halves_of(left)[1]
            else:
                before, after, right = b, b, self.halves_of(right)[0]

    def can_follow(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when encoded together (nothing on the left: whether right is reached)."""
        if not left:
            return self.reachable(right)
        own = self.pairs.get(left)
        if own is None:
            own = self.pairs[left] = {}
        found = own.get(right)
        if found is None:
            found = own[right] = self._compare(left, right)
            self.n_pairs += 1
        return found

    def _compare(self, left: str, right: str) -> bool:
        if not self.reachable(right):
            return False
        known = self.rank
        if (len(left) == 1 or left in known) and (len(right) == 1 or right in known) and MARK * 2 not in left + right:
            return self.stay_apart(left, right)
        return self.merged(left + right) == [left, right]

    def _last_piece(self, word: str, end: int, ends: list[str]) -> str:
        """The last piece of the encoding of word[:end]; ends: the same for all shorter prefixes."""
        pieces, begin = [], end - 1
        while begin >= 0:
            piece = word[begin:end]
            if piece not in self.tails:
                break
            if piece in self.ids:
                pieces.append((begin, piece))
            begin -= 1
        for begin, piece in reversed(pieces):
            if self.can_follow(ends[begin - 1] if begin else "", piece):
                return piece
        return word[end - 1]

    def _best_piece(self, word: str, end: int, best: list[float]) -> str:
        """Viterbi: the piece that ends the best-scored segmentation of word[:end]."""
        options = []
        for begin in range(max(0, end - self.longest), end):
            piece = word[begin:end]
            score = self.scores.get(piece, self.worst if end - begin == 1 else None)
            if score is not None:
                options.append((score + (best[begin - 1] if begin else 0.0), -begin, piece))
        score, _, piece = max(options)
        best.append(score)
        return piece

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words: those of like length share a trie, walked by levels or, if they are few, depth-first."""
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))[order]
        kinds = np.searchsorted(4 ** np.arange(1, 31), sizes, "right")  # to 3, 15, 63 and so on
        made, number = Lists([], np.uint32), np.empty(len(words), np.int64)
        for kind in np.unique(kinds).tolist():
            own = order[kinds == kind]
            group = [words[i] for i in own.tolist()]
            number[own] = len(made.n) + np.arange(len(own))
            if self.kind == BPE and len(group) >= self.many:
                made.add(*levels(self.path).encode(group, self))
            else:
                walked = Lists(self._walk(group), np.uint32)
                made.add(walked.flat, walked.n)
        self.kept.add(*made.of(number))

    def _walk(self, words: list[str]) -> list[list[int]]:
        """Walk the trie of ascending words depth-first: the ids of each."""
        if self.n_pairs > 200_000:
            self.pairs.clear()
            self.n_pairs = 0
        ends: list[str] = []
        best: list[float] = []
        made: list[list[int]] = []
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del ends[shared:], best[shared:]
            for end in range(shared + 1, len(word) + 1):
                ends.append(self._last_piece(word, end, ends) if self.kind == BPE else self._best_piece(word, end, best))
            out: list[str] = []
            at = len(word)
            while at:
                out.append(ends[at - 1])
                at -= len(ends[at - 1])
            made.append([i for piece in reversed(out) for i in self.ids_of(piece)])
            before = word
        return made

    def ids_of(self, piece: str) -> list[int]:
        """The id of a piece; the bytes of a character that has none."""
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    # -- texts ----------------------------------------------------------------------------

    #: A word: marks and what follows them, or a run of line ends and tabs, which no piece joins.
    WORD = re.compile(f"[\n\t\r]+|{MARK}+[^{MARK}\n\t\r]*|[^{MARK}\n\t\r]+")

    def words(self, text: str) -> list[str]:
        marked = self.dummy + text.replace(" ", MARK) if text else ""
        if any(c in self.single for c in "\n\t\r"):
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
        return self.WORD.findall(marked)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > self.most:
            self.known, self.kept = Numbers(), Lists([], np.uint32)
        cut = [self.words(t) if t else [] for t in texts]
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        ids, n = self.kept.of(numbers)
        upto = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, cut)])]
        out = [ids[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]
        return out if self.bytes else [self._one_unknown(ids) for ids in out]

    def _one_unknown(self, ids: np.ndarray) -> np.ndarray:
        """ids with each run of unknown characters as one."""
        unknown = ids == self.unknown
        return ids[~(unknown & np.concatenate([[False], unknown[:-1]])[: len(ids)])]


def encoder(path: str):
    """An Arrow function of a text column that gives its ids as little-endian uint32."""

    @F.arrow_udf("binary")
    def encode_texts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        for column in texts:
            out: list[bytes | None] = []
            for first, n in pieces(column, 1 << 20):
                part = column.slice(first, n).to_pylist()
                out += [None if t is None else i.astype("<u4").tobytes() for t, i in zip(part, codec.encode(part), strict=True)]
            yield pa.array(out, pa.binary())
        del codec
        give_back()

    return encode_texts


def decoder(path: str):
    """An Arrow function of a column of ids that gives their text."""

    @F.arrow_udf("string")
    def decode_ids(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Decoder(path)
        for column in ids:
            out: list[str | None] = []
            for first, n in pieces(column):
                out += [None if i is None else codec.decode(np.frombuffer(i, "<u4")) for i in column.slice(first, n).to_pylist()]
            yield pa.array(out, pa.string())
        del codec
        give_back()

    return decode_ids


def checker(path: str):
    """An Arrow function of a text column that gives its ids and whether they decode to it: one worker does both."""

    @F.arrow_udf("ids binary, round_trip boolean")
    def check_texts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, back = Codec(path), Decoder(path)
        for column in texts:
            out: list[bytes | None] = []
            same: list[bool] = []
            for first, n in pieces(column, 1 << 20):
                part = column.slice(first, n).to_pylist()
                for t, i in zip(part, codec.encode(part), strict=True):
                    out.append(None if t is None else i.astype("<u4").tobytes())
                    same.append(t is None or back.decode(i) == t)
            yield pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(same, pa.bool_())], names=["ids", "round_trip"])
        del codec, back
        give_back()

    return check_texts


def _n_ids() -> Column:
    return F.coalesce(F.octet_length("ids") / 4, F.lit(0)).cast("bigint").alias("n_ids")


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with n_ids and ids (little-endian uint32) of the text, as the SentencePiece library gives them.

    `model` is the path of a model file that exists on every executor. A null text has null ids
    and n_ids 0; an empty one has none; very long words are encoded whole. A mark (U+2581) in a
    text is a blank to the model and comes back as one; all else comes back as it was. Rows are
    encoded one by one, so repeats, null ids and other columns stay; columns named n_ids or ids are
    replaced, other names don't matter; an empty table gives no rows. Only the text leaves the JVM.
    """
    rest = [col(c) for c in docs.columns if c.lower() not in ("n_ids", "ids")]
    encoded = bound_batches(docs).select(*rest, encoder(model)(col(text).cast("string")).alias("ids"))
    return encoded.select(*rest, _n_ids(), "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with decoded: the text of its ids; null ids give null. Other columns and rows stay."""
    rest = [col(c) for c in encoded.columns if c.lower() != "decoded"]
    return bound_batches(encoded).select(*rest, decoder(model)(F.col("ids")).alias("decoded"))


def encode_checked(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """As encode(), with round_trip: whether decode() of the ids gives the text back (true of a null text).

    The text is encoded and decoded where it is, so a task needs one Python worker and not two side by side.
    """
    (both,) = unused(docs, "both")
    rest = [col(c) for c in docs.columns if c.lower() not in ("n_ids", "ids", "round_trip")]
    checked = bound_batches(docs).select(*rest, checker(model)(col(text).cast("string")).alias(both))
    return checked.select(*rest, col(both)["ids"].alias("ids"), col(both)["round_trip"].alias("round_trip")).select(*rest, _n_ids(), "ids", "round_trip")
