"""Conversations whose roles are put in order with the fewest edits, as a stream of sorted turns.

Turns are dealt by conversation and sorted by turn; mapInPandas reads them in that order and
carries the state of a dynamic programme from row to row and from batch to batch, so a task holds
no conversation. The state says, for each of the four states of the pattern of roles

    START --s--> LED --u--> ASKED --a--> ANSWERED --u--> ASKED, and START --u--> ASKED

what the cheapest edits of the rows so far cost, how they compare as strings, and the hash of the
text that they leave. Costs are kept relative to the least, so there are few distinct steps; each
is worked out once and then looked up. What leads back from a row is the number of its step, four
bytes, which go to a scratch file once a conversation is long. After its last row, the steps are
read backwards and give the edits.

Edits before a row are some inserts and then what happens to the row. All strings that lead to the
same row hold as many letters K, R and D and end with one, so none is the beginning of another:
their order doesn't change as they grow, and the order of the four is all that ties need.

Whether a turn repeats an earlier one is found before, by a window over equal turns, so the
stream needs no memory of texts.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, col

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
START, LED, ASKED, ANSWERED = range(4)
#: States after a role's initial.
NEXT = {(START, "s"): LED, (START, "u"): ASKED, (LED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
#: The role that can follow a state besides s, and the inserts that complete it.
WANTED = {START: "user", LED: "user", ASKED: "assistant", ANSWERED: "user"}
TO_END = {START: 0, LED: 2, ASKED: 1, ANSWERED: 0}
#: Steps of a conversation that are held in memory before they go to the scratch file.
HELD = 1 << 18
BLANK = " \t\n\x0b\f\r"
FINE, BLANK_TURN, DUPLICATE, TRUNCATED = range(4)


class Steps:
    """Steps of the programme: (costs, order, kind of row) -> (number, costs, order, least cost, ways)."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.ways: list[tuple] = []

    def of(self, costs: tuple, order: tuple, initial: str, fault: int) -> tuple:
        key = (costs, order, initial, fault)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._make(costs, order, initial, fault)
        return found

    def _make(self, costs: tuple, order: tuple, initial: str, fault: int) -> tuple:
        best: list[tuple | None] = [None] * 4  # (cost, place in the order, letters, state before, inserts)
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for before in range(4):
            if costs[before] is None:
                continue
            state = before
            for inserts in range(3):  # three would come back to a state at a cost
                cost = costs[before] + INSERT_COST * inserts
                options = [("D", cost + DELETE_COST, state)]
                if fault in (FINE, TRUNCATED):
                    options.append(("R", cost + REROLE_COST + more, NEXT[state, WANTED[state][0]]))
                    if (state, initial) in NEXT:
                        options.append(("K", cost + KEEP_COST + more, NEXT[state, initial]))
                for letter, total, to in options:
                    way = (total, order[before], "I" * inserts + letter, before, inserts)
                    if best[to] is None or way < best[to]:
                        best[to] = way
                state = NEXT[state, WANTED[state][0]]
        least = min(b[0] for b in best if b)
        ranked = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        after = [0] * 4
        for place, (_, _, to) in enumerate(ranked):
            after[to] = place
        ways = tuple(None if b is None else (b[3], b[4], b[2][-1]) for b in best)
        self.ways.append(ways)
        return len(self.ways) - 1, tuple(None if b is None else b[0] - least for b in best), tuple(after), least, ways


class Conversation:
    """State of the conversation that streams by."""

    def __init__(self, steps: Steps) -> None:
        self.steps = steps
        self.costs, self.order, self.base = (0, None, None, None), (0, 0, 0, 0), 0
        self.texts: list = [None] * 4  # hash of the lines so far; None: no lines
        self.held, self.file = array("I"), None
        self.counts = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.least = self.most = self.last = None
        self.distinct = 0

    @staticmethod
    def _line(text, line: bytes):
        if text is None:
            return hashlib.sha256(line)
        text = text.copy()
        text.update(b"\n" + line)
        return text

    def add(self, turn: str | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            value, self.last = int(turn), turn
            self.least = value if self.least is None else self.least
            self.most, self.distinct = value, self.distinct + 1
        self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        number, self.costs, self.order, least, ways = self.steps.of(self.costs, self.order, initial if initial in ("s", "u", "a") else "", fault)
        self.base += least
        self.held.append(number)
        if len(self.held) >= HELD:
            self._spill()
        texts, content = self.texts, None
        self.texts = [None] * 4
        for to, way in enumerate(ways):
            if way is None:
                continue
            state, inserts, letter = way
            made = texts[state]
            for _ in range(inserts):
                made = self._line(made, WANTED[state].encode() + b":")
                state = NEXT[state, WANTED[state][0]]
            if letter != "D":
                content = text.encode() if content is None else content
                made = self._line(made, (role if letter == "K" else WANTED[state]).encode() + b":" + content)
            self.texts[to] = made

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # has no name, so it is gone with the task
        self.held.tofile(self.file)
        self.held = array("I")

    def _backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        if self.file is not None:
            size = self.held.itemsize * HELD
            for part in range(self.file.tell() // size - 1, -1, -1):
                self.file.seek(part * size)
                steps = array("I")
                steps.frombytes(self.file.read(size))
                yield from reversed(steps)
            self.file.close()

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of the repaired text."""
        done = [(c + INSERT_COST * TO_END[s], self.order[s], s) for s, c in enumerate(self.costs) if c is not None]
        cost, _, state = min(done)
        made, at = self.texts[state], state
        for _ in range(TO_END[state]):
            made = self._line(made, WANTED[at].encode() + b":")
            at = NEXT[at, WANTED[at][0]]
        parts = ["I" * TO_END[state]]
        for number in self._backwards():
            before, inserts, letter = self.steps.ways[number][state]
            parts.append(letter + "I" * inserts)
            state = before
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return gaps, *self.counts[1:], self.illegal, self.base + cost, "".join(parts)[::-1], (made or hashlib.sha256()).hexdigest()


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT_DDL = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps = Steps()
    name, now = None, None
    for batch in batches:
        out = []
        for conv, turn, gone, role, text, fault in zip(*(batch[c].tolist() for c in ("conv", "turn", "gone", "role", "text", "fault")), strict=True):
            if now is None or conv != name:
                if now is not None:
                    out.append((name, *now.result()))
                name, now = conv, Conversation(steps)
            if not gone:
                now.add(turn, role, text, fault)
        yield pd.DataFrame(out, columns=["conv", *RESULT])
    if now is not None:
        yield pd.DataFrame([(name, *now.result())], columns=["conv", *RESULT])


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults planted by a hash of conv_id and turn; `gone` marks rows that are dropped.

    Null roles and texts are one space from here on, and a null conv_id or turn counts as one in
    the hash. Of 20 rows one is dropped, one loses its text, one its signs that end sentences, one
    is repeated, and one becomes the user's.
    """
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select(col("conv_id").alias("conv_id"), col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _fault(text: Column, repeats: Column) -> Column:
    end = F.rtrim(text, F.lit(BLANK))
    return F.when(end == "", BLANK_TURN).when(repeats, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)


def with_faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone) with `fault`: the first that holds of blank, duplicate and truncated; 0 if none does."""
    digest = F.when(~F.col("gone"), F.sha2("text", 256))
    same = Window.partitionBy("conv_id", "role", digest, "gone").orderBy(F.col("turn").asc_nulls_first())
    return turns.withColumn("repeats", F.row_number().over(same)).withColumn("fault", _fault(F.col("text"), F.col("repeats") > 1))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, counts of faults, and the cheapest edits of each conversation: cost, audit, hash of what they leave.

    turns: conv_id, turn, role, text, and `gone` for rows that only name their conversation. Rows
    go by turn, nulls first, rows of one turn by role and text. K keeps a row, R gives it the role
    of user or assistant (3), D deletes it (4, and blank and duplicate rows must go), I inserts an
    empty turn (3); a truncated row that stays costs 3 more. The edits leave roles whose initials
    read (s?(ua)+)?; of equal costs the least string of edits wins. Roles count by their first
    character; one with another initial, or none, can't be kept. Null roles and texts are one
    space. A null conv_id is a conversation of its own, and a conversation without rows, or all of
    whose rows are gone, has zeros, no edits and the hash of nothing. An empty table gives no
    rows; other columns are not read.
    """
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    rows = bound_batches(turns).select(col("conv_id").alias("conv_id"), col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), col("gone").alias("gone"))
    by_turn = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "repeats"]
    dealt = with_faults(rows).repartition("conv_id").sortWithinPartitions(*by_turn)
    kept = lambda c: F.when(~F.col("gone"), F.col(c)).otherwise("").alias(c)
    stream = dealt.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "gone", kept("role"), kept("text"), "fault")
    kind = rows.schema["conv_id"].dataType
    return stream.mapInPandas(_stream, f"conv string, {RESULT_DDL}").select(F.col("conv").cast(kind).alias("conv_id"), *RESULT)


def repaired_turns(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, seq, role, text: the turns that the edits in `repaired` leave, numbered from 1.

    The audit is cut into the inserts before each row and the row's letter, joined to the rows by
    their numbers, and the roles follow from the numbers of the turns that are left.
    """
    blank = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    rows = turns.where(~F.col("gone")).select(col("conv_id").alias("conv_id"), col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    numbered = rows.withColumn("at", at)
    edits = repaired.select(F.col("conv_id").alias("c"), F.posexplode(F.regexp_extract_all("audit", F.lit(r"I*[KRD]|I+\z"), F.lit(0))).alias("p", "edit"))
    met = edits.join(numbered, edits["c"].eqNullSafe(numbered["conv_id"]) & (edits["p"] + 1 == numbered["at"]), "left")
    single = met.select("c", "p", "role", "text", F.posexplode(F.split("edit", "")).alias("k", "letter")).where("letter IN ('K', 'R', 'I')")
    over = Window.partitionBy("c").orderBy("p", "k")
    placed = single.withColumn("seq", F.row_number().over(over)).withColumn("led", F.first(F.when(F.col("letter") == "K", F.substring("role", 1, 1) == "s").otherwise(F.lit(False))).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    asks = (F.col("seq") - F.col("led").cast("int")) % 2 == 1
    role = F.when(F.col("letter") == "K", F.col("role")).when(asks, "user").otherwise("assistant")
    text = F.when(F.col("letter") == "I", "").otherwise(F.col("text"))
    return placed.select(F.col("c").alias("conv_id"), "seq", role.alias("role"), text.alias("text"))
