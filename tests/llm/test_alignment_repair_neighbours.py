"""Conversation repair, nearest neighbours and token alignment against brute force, with nulls, empty
and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import conversation_repair, neighbours, token_alignment
from lectern.llm import queries as corpus

# -- conversation repair ------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, gone boolean, fault string, repeats int"


def cheapest(rows, faults):
    """(cost, audit, lines) by trying all edits: every string of letters that is no dearer than the best so far."""
    wanted = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    fits = lambda before, initial: (before, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {(0, ""): (0, "", ())}  # (rows used, last initial) -> cost, audit, lines
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for (at, last), (cost, audit, lines) in list(best.items()):
                if at == i:
                    role = wanted[last]
                    key, new = (i, role[0]), (cost + 3, audit + "I", (*lines, role + ":"))
                    if key not in best or new[:2] < best[key][:2]:
                        best[key] = new
        if i == len(rows):
            break
        role, text = rows[i]
        more = 3 if faults[i] == 3 else 0
        for (at, last), (cost, audit, lines) in list(best.items()):
            if at != i:
                continue
            ways = [((i + 1, last), (cost + 4, audit + "D", lines))]
            if faults[i] in (0, 3):
                to = wanted[last]
                ways.append(((i + 1, to[0]), (cost + 3 + more, audit + "R", (*lines, f"{to}:{text}"))))
                if fits(last, role[:1]):
                    ways.append(((i + 1, role[:1]), (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for key, new in ways:
                if key not in best or new[:2] < best[key][:2]:
                    best[key] = new
    done = [v for (at, last), v in best.items() if at == len(rows) and last in ("", "a")]
    return min(done, key=lambda v: v[:2])


def every_audit(rows, faults, most):
    """(cost, audit) of all edits up to a cost, without any dynamic programme."""
    out = []

    def go(i, initials, cost, audit):
        if cost > most or not re.fullmatch(r"(s?(ua)*u?)?|s", initials):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            out.append((cost, audit))
        for role in ("u", "a"):
            go(i, initials + role, cost + 3, audit + "I")
        if i < len(rows):
            more = 3 if faults[i] == 3 else 0
            go(i + 1, initials, cost + 4, audit + "D")
            if faults[i] in (0, 3):
                for role in ("u", "a"):
                    go(i + 1, initials + role, cost + 3 + more, audit + "R")
                if rows[i][0][:1]:
                    go(i + 1, initials + rows[i][0][0], cost + more, audit + "K")

    go(0, "", 0, "")
    return min(out)


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def repaired(turns):
    """conv_id -> the row that repair_conversations should give, for (conv_id, turn, role, text, gone)."""
    groups = defaultdict(list)
    for conv, turn, role, text, gone in turns:
        groups[conv] += [] if gone else [(turn is not None, turn or 0, " " if role is None else role, " " if text is None else text)]
    out = {}
    for conv, rows in groups.items():
        rows.sort()
        numbers = [t for known, t, _, _ in rows if known]
        pairs = [(r, x) for _, _, r, x in rows]
        faults = faults_of(pairs)
        cost, audit, lines = cheapest(pairs, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = Counter(faults)
        out[conv] = (gaps, count[1], count[2], count[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, role, text, kind == 0


def test_the_programme_finds_what_trying_all_edits_finds():
    draw = random.Random(5)
    for _ in range(250):
        rows = [(draw.choice(["system", "user", "assistant", "user", "assistant", "tool"]), draw.choice(["a.", "b", "c!", ""])) for _ in range(draw.randrange(5))]
        faults = faults_of(rows)
        cost, audit, _ = cheapest(rows, faults)
        assert (cost, audit) == every_audit(rows, faults, cost)


@pytest.fixture(scope="module")
def turns():
    draw = random.Random(7)
    rows = []
    for conv in range(150):
        for turn in range(draw.randrange(1, 9)):
            rows.append((conv, draw.choice([turn, turn, turn + 2, None, 3]), draw.choice(["user", "assistant", "system", "tool", None, "", "U"]), draw.choice(["yes.", "no", " ", None, "", "why?  ", "é!", "x."]), draw.random() < 0.1))
    rows += [(None, 1, "user", "a.", False), (None, 1, "user", "a.", False), (None, None, None, None, False), (1000, 1, "user", "a.", True), (1001, None, "user", "long " * 20_000 + ".", False)]
    rows += [(2000, i, "user" if i % 2 else "assistant", f"t{i % 700}{'.' if i % 3 else ''}", i % 11 == 0) for i in range(3000)]
    return rows


def test_conversations_equal_brute_force(spark, turns):
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], TURNS).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_conversations(df).collect()}
    assert got == repaired(turns)
    assert got[1000] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.repair_conversations(df.limit(0)).count() == 0


def test_repaired_turns_have_the_hash(spark, turns):
    df = spark.createDataFrame([(*t, "x", 1) for t in turns if t[0] != 1001], TURNS)
    result = conversation_repair.repair_conversations(df)
    lines = defaultdict(list)
    for r in conversation_repair.repaired_turns(df, result).orderBy("seq").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in result.collect():
        assert hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in lines[r.conv_id]))


def test_steps_are_spilled(monkeypatch):
    rows = [("user" if i % 3 else "assistant", f"t{i}.") for i in range(1000)]

    def run():
        now = conversation_repair.Conversation(conversation_repair.Steps())
        for i, (role, text) in enumerate(rows):
            now.add(str(i), role, text, 0)
        return now.result()

    whole = run()
    monkeypatch.setattr(conversation_repair, "HELD", 64)
    assert run() == whole
    assert whole[5:7] == cheapest(rows, [0] * 1000)[:2]


def test_damage_and_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in corpus.QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == repaired(list(damaged(rows))) and any("I" in v[6] or "D" in v[6] for v in got.values())
    odd = spark.createDataFrame([(None, None, None, None), (None, 2, "user", "a.b!"), (3, None, "x", None)], "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(str, (tuple(r) for r in conversation_repair.damage(odd).collect()))) == sorted(map(str, damaged([tuple(r) for r in odd.collect()])))


# -- nearest neighbours -------------------------------------------------------------------


def exact(rows, k=20, every=20):
    """query_id -> [(score, vec_id)] by brute force, one list for each row that asks."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        scores = (x * x[i]).sum(axis=1)
        others = [(s, v) for j, (s, v) in enumerate(zip(scores.tolist(), ids.tolist(), strict=True)) if j != i]
        out.append((int(ids[i]), sorted(others, key=lambda t: (-t[0], t[1]))[:k]))
    return out


def results(df):
    out = defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in out[r.query_id]
        out[r.query_id][r["rank"]] = (r.score, r.vec_id)
    return {q: [v[i] for i in sorted(v)] for q, v in out.items()}


def test_neighbours_of_clusters(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((40, 16)) * 2
    x = centres[draw.integers(0, 40, 4000)] + draw.standard_normal((4000, 16))
    x[1500:2800] = x[1500]  # a vector that a third of the rows hold
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, part string, row int").repartition(5)
    index, routers = neighbours.index_vectors(df, part_rows=300)
    assert index.count() == 4000 and routers[16].parts > 4 and routers[16].visits < routers[16].parts
    got = results(neighbours.nearest(df, part_rows=300, block=500))
    want = dict(exact(rows))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    for q, found in got.items():
        assert found == sorted(found, key=lambda t: (-t[0], t[1])) and q not in {v for _, v in found}
        assert all(s == float((x[q] * x[v]).sum()) for s, v in found)
    recall = np.mean([len({v for _, v in got[q]} & {v for _, v in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_edge_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, -0.0]), (2, [0.5, 2.0]), (20, [-1.0, 1.0]), (7, [3.0, 4.0]), (8, [3.0, 4.0]), (9, [1e300, 1.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (3, [None, 1.0]), (4, [inf, 1.0]), (5, [nan, 1.0]), (None, [1.0, 1.0]), (80, []), (100, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, k=5).collect())
    want = sorted((q, i + 1, v, s) for q, best in exact(rows, 5) for i, (s, v) in enumerate(best))
    assert got == want
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(2).standard_normal((2000, 8))
    graph = neighbours.neighbour_graph(x, 10)
    part = neighbours.balanced_parts(graph, 7)
    sizes = np.bincount(part, minlength=7)
    assert sizes.min() >= 2000 // 7 - 3 and sizes.max() <= 2000 // 7 + 4
    inside = (part[graph] == part[:, None]).mean()
    assert inside > 2 / 7


def test_neighbours_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = results(corpus.QUERIES["op12_nearest"](spark, sf)), dict(exact(rows))
    assert set(got) == set(want)
    assert np.mean([len({v for _, v in got[q]} & {v for _, v in want[q]}) / len(want[q]) for q in want]) >= 0.9


# -- token alignment ----------------------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "e", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "日本", "🙂", " ", "　", "\x85", "\x1c", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "23", ".", "'s", "Z", "ﬁ", "\x00", "​", " a", " tion"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), token_alignment.byte_vocabulary(A), token_alignment.piece_vocabulary(B)


def aligned(libraries, text):
    """[(ids of A, ids of B)] of each group by the libraries and plain sets of ends."""
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    want = (" " + text).encode()
    if any(b"".join(table[i] for i in ids) != want for table, ids in ((bytes_a, ids_a), (bytes_b, ids_b))):
        return []
    ends_a, ends_b = (list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((bytes_a, ids_a), (bytes_b, ids_b)))
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return out


def test_alignment_equals_brute_force(spark, libraries):
    draw = random.Random(11)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(30))) for _ in range(1500)]
    texts += [None, "", " ", "a", "the the", "word " * 30_000, "x" * 20_000, "plain words, of a line.\nAnd another one!", "plain words, of a line.\nAnd another one!"]
    df = spark.createDataFrame([(None if i % 50 == 0 else i, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, links string, n_a int").repartition(4)
    want_groups = {t: aligned(libraries, t) for t in set(texts)}
    counts = Counter((x[-1], y[-1]) for t in texts for x, y in want_groups[t])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    want = []
    for i, t in enumerate(texts):
        groups = want_groups[t]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = [(x[-1], y[-1]) for x, y in groups]
        want.append((None if i % 50 == 0 else i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), hashlib.sha256(text.encode()).hexdigest() if groups else "",
                     len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)))
    got = token_alignment.aligned_digests(df, A, B).select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(bool(g) for g in want_groups.values()) > 500
    assert token_alignment.aligned_digests(df.limit(0), A, B).count() == 0


def test_words_are_encoded_together(libraries):
    """New words are encoded as few joined texts; those that don't come back so, one by one; all equal the libraries."""
    a, b, *_ = libraries
    encoder = token_alignment.BothEncoder(A, B, most=3000)

    class Counted:
        asked = 0

        def encode_batch_fast(self, texts, **how):
            self.asked += len(texts)
            return a.encode_batch_fast(texts, **how)

    encoder.tokenizer = Counted()
    draw = random.Random(17)
    plain = ["".join(draw.choice("etaoinshrdlu.,'é") for _ in range(draw.randrange(1, 12))) for _ in range(5000)]
    texts = [" ".join(plain[i : i + 50]) for i in range(0, len(plain), 50)]
    numbers, _ = encoder.numbers(texts)
    assert encoder.tokenizer.asked < 50
    for side, library in ((encoder.a, lambda t: a.encode(" " + t, add_special_tokens=False).ids), (encoder.b, b.encode)):
        assert side.words.of(numbers)[0].tolist() == [i for t in texts for i in library(t)]

    for _ in range(40):  # words of hard characters beside plain ones; none of a text that doesn't come back
        some = [" ".join("".join(draw.choice(PIECES) for _ in range(draw.randrange(6))) if draw.random() < 0.5 else draw.choice(plain) for _ in range(30)) for _ in range(20)]
        some += [None, "", "plain words", "a▁b c"]
        for text, groups in zip(some, token_alignment.align_texts(encoder, some)[3].to_pylist(), strict=True):
            assert groups == as_text(aligned(libraries, text)), text


def as_text(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_words_are_aligned_once(libraries, monkeypatch):
    """The halving takes each distinct word once, and a text of which one word alone doesn't come back as one word."""
    taken = []
    halved = token_alignment.shared_cuts
    monkeypatch.setattr(token_alignment, "shared_cuts", lambda a, b, first, last: (taken.append(len(a)), halved(a, b, first, last))[1])
    encoder = token_alignment.BothEncoder(A, B)
    texts = ["the anagram of a name"] * 300 + ["a name of the anagram"] * 300
    for _ in range(2):
        n_a, n_b, n_groups, groups, _ = (c.to_pylist() for c in token_alignment.align_texts(encoder, texts))
        assert groups == [as_text(aligned(libraries, t)) for t in texts]
    assert sum(taken) < 30
    encoder.whole[encoder.known["name"]] = False
    for _ in range(2):
        again = [c.to_pylist() for c in token_alignment.align_texts(encoder, texts)]
        assert again[:4] == [n_a, n_b, n_groups, groups]
    assert (texts[0],) in encoder.known and len(encoder.known) == len(encoder.groups) == len(encoder.whole) == len(encoder.links.n) == len(encoder.a.words.n)


def test_joined_words_that_do_not_come_back(libraries):
    """A side that loses bytes of one word leaves the other words of its text as they are."""
    encoder = token_alignment.BothEncoder(A, B)
    encoder.b.bytes = [b"?" if w == b"z" else w for w in encoder.b.bytes]
    texts = ["one two three", "a zzzzqz b", "four five"]
    n_a, n_b, _, groups, _ = (c.to_pylist() for c in token_alignment.align_texts(encoder, texts))
    assert n_a[1] == n_b[1] == 0 and groups == [as_text(aligned(libraries, texts[0])), "", as_text(aligned(libraries, texts[2]))]


def test_groups_are_given(spark, libraries):
    df = spark.createDataFrame([(1, "the anagram of a name")], "doc_id bigint, text string")
    row = token_alignment.align_tokens(df, A, B).collect()[0]
    groups = aligned(libraries, "the anagram of a name")
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert sorted((x.a, x.b, x.n) for x in row.links) == sorted((a, b, n) for (a, b), n in Counter((x[-1], y[-1]) for x, y in groups).items())


def test_shared_cuts():
    draw = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(np.append(draw.integers(1, 60, draw.integers(1, 40)), 60)) for _ in range(2))
        cuts = token_alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        assert a[cuts].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_links_are_bounded():
    assert token_alignment.possible_links([b"ab", b"b", b"c"], [b"b", b"xb", b"c", b"c"]) == 5  # ab-b, b-b, b-xb, c-c twice


def test_query_runs(spark, sf):
    rows = corpus.QUERIES["op13_token_alignment"](spark, sf).agg(F.count("*").alias("n"), F.sum("n_links").alias("links"), F.min(F.col("n_links") == F.col("n_groups")).alias("same")).collect()[0]
    assert rows.n == spark.read.parquet(f"{sf}/documents.parquet").count() and rows.links > 0 and rows.same
