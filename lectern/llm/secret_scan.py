"""Secret scans through an inverted index of trigrams, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: every match must
contain all trigrams of at least one alternative. The index holds, for the trigrams that any
query names, the documents whose lower-cased text contains them. Intersecting the postings of an
alternative gives its candidates, and only candidates meet the rule's regular expression. A rule
without mandatory trigrams is a candidate everywhere, that is a full scan.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .common import col, unused

# The rules, (kind, pattern, least length of the match or of its second group).
# The first three are the base kinds; the order is that of the kinds in results.
RULES: list[tuple[str, str, int, int]] = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("code_host", r"(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("cloud", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
]
BASE = ("assign", "access", "hex")


#: Most strings that a part of an expression is written out as, and most characters of a class.
STRINGS, CLASS = 64, 8


def _written_out(items) -> set[str] | None:
    """All strings, lower-cased, that a part of a parsed expression matches; None if they are many or not bounded."""
    from re import _constants as C

    out = {""}
    for op, value in items:
        if op is C.LITERAL:
            own = {chr(value).lower()}
        elif op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in value):
            chars = [chr(c) for o, v in value for c in ([v] if o is C.LITERAL else range(v[0], min(v[1], v[0] + CLASS) + 1))]
            own = {c.lower() for c in chars} if len(chars) <= CLASS else None
        elif op is C.SUBPATTERN:
            own = _written_out(value[-1])
        elif op is C.BRANCH:
            branches = [_written_out(b) for b in value[1]]
            own = None if None in branches else set().union(*branches)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] <= 2:
            body = _written_out(value[2])
            own = None if body is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(body, repeat=n)}
        else:
            own = None
        if own is None or len(out) * len(own) > STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which each match has one whole: sets of lower-cased trigrams.

    An empty set among the alternatives means that nothing is mandatory. Parts that follow each
    other are written out together as long as they match few strings, alternatives and small
    classes included, so that trigrams reach across them; what matches more ends a run. An
    alternative that holds all of another is left out, as the other says as much.
    """
    from re import _constants as C
    from re import _parser as parser

    def least(query: list[frozenset[str]]) -> list[frozenset[str]]:
        return [frozenset()] if frozenset() in query else [a for a in set(query) if not any(b < a for b in query)]

    def of(items) -> list[frozenset[str]]:
        parts: list[list[frozenset[str]]] = []
        run = {""}

        def close() -> None:
            nonlocal run
            grams = least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run])
            if frozenset() not in grams:
                parts.append(grams)
            run = {""}

        for item in items:
            own = _written_out([item])
            if own is not None:
                if len(run) * len(own) > STRINGS:
                    close()
                run = {a + b for a in run for b in own}
                continue
            close()
            op, value = item
            if op is C.SUBPATTERN:
                parts.append(of(value[-1]))
            elif op is C.BRANCH:
                parts.append([grams for branch in value[1] for grams in of(branch)])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
                parts.append(of(value[2]))
        close()
        parts = [p for p in parts if frozenset() not in p]
        while prod(map(len, parts)) > STRINGS:  # fewer terms: the part with most alternatives says least
            parts.remove(max(parts, key=len))
        return least([frozenset().union(*choice) for choice in product(*parts)]) if parts else [frozenset()]

    return sorted(of(parser.parse(pattern)), key=sorted)


def build_index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The postings (gram, key) of the trigrams that queries name: one row for each of texts (key, text) that has it."""
    low = texts.select("key", F.lower("text").alias("low"))
    has = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])
    return low.select("key", F.array_compact(has).alias("grams")).select("key", F.explode("grams").alias("gram"))


def candidates(texts: DataFrame, rules: list[tuple[str, str, int, int]]) -> DataFrame:
    """(key, kinds): for each of texts (key, text) the rules of which it has all trigrams of an alternative."""
    terms = [(kind, i, gram, len(alt)) for kind, pattern, _, _ in rules for i, alt in enumerate(trigram_query(pattern)) for gram in sorted(alt)]
    postings = build_index(texts, sorted({t[2] for t in terms}))
    # as literals: rows given to createDataFrame would pass through Python workers
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("alternative"), F.lit(g).alias("gram"), F.lit(n).alias("grams")) for k, i, g, n in terms]
    query = texts.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    met = postings.join(F.broadcast(query), "gram").groupBy("key", "kind", "alternative", "grams").agg(F.count_distinct("gram").alias("n"))
    return met.where("n = grams").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """Leftmost matches as structs (start, kind order, end, kind) in code points, short ones dropped.

    Places come from the lengths of what lies between the matches and of the matches themselves.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, i: F.struct(F.char_length(between[i]).alias("gap"), F.char_length(m).alias("n"), F.char_length(measured[i]).alias("size")))
    kind_of = [F.lit(order).alias("kind_no"), F.lit(kind).alias("kind")]
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), kind_of[0], (start + s["n"]).alias("end"), kind_of[1])
        return F.struct((start + s["n"]).alias("at"), F.when(s["size"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(steps, zero, step, lambda acc: acc["out"]))


def _with_spans(docs: DataFrame, rules: list[tuple[str, str, int, int]] | None, text: str, out: str) -> DataFrame:
    """docs with a column `out` of secret spans; texts are known to the index by their MD5, so copies share postings."""
    rules = RULES if rules is None else rules
    scanned = [r for r in rules if frozenset() in trigram_query(r[1])]
    indexed = [r for r in rules if r not in scanned]
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    found = [_matches(body, *r, rules.index(r)) for r in scanned]
    names = [col(c) for c in docs.columns]
    if indexed:
        digest = F.unhex(F.md5(body.cast("binary")))
        key, own, kinds = unused(docs, "key", "own", "kinds")
        hits = keep(candidates(docs.select(digest.alias("key"), body.alias("text")), indexed), "candidates")
        docs = docs.withColumn(own, digest).join(hits.select(F.col("key").alias(key), F.col("kinds").alias(kinds)), F.col(own) == F.col(key), "left")
        found += [F.when(F.array_contains(kinds, r[0]), _matches(body, *r, rules.index(r))) for r in indexed]
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    return docs.select(*names, F.array_sort(F.concat(*[F.coalesce(f, none) for f in found])).alias(out))


def find_secrets(docs: DataFrame, rules: list[tuple[str, str, int, int]] | None = None, text: str = "text") -> DataFrame:
    """All columns of docs and `secrets`: an array of (start, kind_no, end, kind) by start and kind.

    Places are code points, the end exclusive; matches of one kind never overlap, those of
    different kinds may. A null text counts as empty; very long ones are read whole. Rows are
    judged by their text alone, so repeats and null ids stay; an empty table gives no rows. A
    column named secrets is replaced; other names don't matter.
    """
    return _with_spans(docs.drop("secrets"), rules, text, "secrets")


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: list[tuple[str, str, int, int]] | None = None, text: str = "text") -> DataFrame:
    """docs with every secret span of the text replaced by `mask`; all other columns and rows stay, whatever their names.

    Overlapping spans become one mask. A null text stays null. Edge cases as find_secrets.
    """
    (spans,) = unused(docs, "spans")
    found = _with_spans(docs, rules, text, spans)
    body = col(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"))

    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    masked = F.when(F.size(spans) > 0, clean).otherwise(body).alias(text)
    return found.select(*[masked if c == text else col(c) for c in docs.columns])


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in BASE]))
