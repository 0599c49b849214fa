"""The registered query of each corpus operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table
from . import conversation_repair, decontamination, language_id, license_scan, near_dedup, neighbours, quality, secret_scan, sentencepiece_codec, token_alignment, token_store, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.col("matches.n")), F.lit(0)).alias("longest_match"),
        F.array_min(F.col("matches.doc_start")).alias("first_match"),
    )


#: Lower-case A-Z alone, and the words that all word-based contracts take.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: A run of windows that follow each other both in the document and in the item is one match.
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT bid, item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0),
win AS (SELECT bid, item_id, size, j, array_to_string(w[j:j + size - 1], ' ') AS t FROM bw),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes),
hit AS (SELECT dw.rid, dw.i, dw.size, win.item_id, win.bid, win.j FROM dw JOIN win ON dw.size = win.size AND array_to_string(dw.w[dw.i:dw.i + dw.size - 1], ' ') = win.t),
places AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid),
runs AS (SELECT rid, bid, i - j AS diagonal, size, i - row_number() OVER (PARTITION BY rid, bid, i - j ORDER BY i) AS run, i FROM hit),
matches AS (SELECT rid, min(i) - 1 AS start, count(*) - 1 + size AS n FROM runs GROUP BY rid, bid, diagonal, size, run),
longest AS (SELECT rid, max(n) AS n, min(start) AS start FROM matches GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated,
       CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_match, CAST(longest.start AS BIGINT) AS first_match
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid) LEFT JOIN longest USING (rid)
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


_TEMPLATES = license_scan.templates()

#: Votes of grams by diagonal, the spans of a diagonal and its next ones, then their words one by one, then the best where spans overlap.
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
t(n, label, base, k, w) AS (VALUES {", ".join(f"({n}, '{label}', {base}, {k}, string_split('{' '.join(w)}', ' '))" for n, label, base, w, k in _TEMPLATES)}),
tg AS (SELECT n, k, i - 1 AS place, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)),
dg AS (SELECT rid, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t))),
v AS (SELECT DISTINCT rid, n, place, pos - place AS diagonal FROM dg JOIN tg USING (k, g)),
diag AS (SELECT rid, n, diagonal, count(*) AS votes FROM v GROUP BY ALL),
merged AS (SELECT diag.rid, diag.n, diag.diagonal, diag.votes, count(DISTINCT v.place) AS m FROM diag JOIN v ON v.rid = diag.rid AND v.n = diag.n AND v.diagonal BETWEEN diag.diagonal AND diag.diagonal + {license_scan.NEIGHBOUR} GROUP BY ALL),
span AS (SELECT rid, n, diagonal, label, base, t.w AS tw, d.w AS dw FROM merged JOIN t USING (n) JOIN d USING (rid)
  WHERE CASE WHEN base THEN votes = len(t.w) - k + 1 ELSE m >= {license_scan.VOTES} * (len(t.w) - k + 1) END),
word AS (SELECT *, unnest(range(len(tw))) AS p FROM span),
same AS (SELECT rid, n, diagonal, label, base, len(tw) AS size, count(*) FILTER (
    CASE WHEN base THEN diagonal + p >= 0 AND dw[diagonal + p + 1] = tw[p + 1]
    ELSE {" OR ".join(f"(diagonal + p + {e} >= 0 AND dw[diagonal + p + {e} + 1] = tw[p + 1])" for e in range(license_scan.NEIGHBOUR + 1))} END) AS found FROM word GROUP BY ALL),
met AS (SELECT *, found / size AS share FROM same WHERE CASE WHEN base THEN found = size ELSE found / size >= {license_scan.COVERAGE} END),
ok AS (SELECT * FROM met a WHERE base OR NOT EXISTS (SELECT 1 FROM met b WHERE b.rid = a.rid AND NOT b.base AND b.n <> a.n AND b.diagonal < a.diagonal + a.size AND a.diagonal < b.diagonal + b.size
  AND (b.found > a.found OR b.found = a.found AND b.share > a.share))),
named AS (SELECT rid, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN named USING (rid)
"""


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.withColumn("is_first", F.col("doc_id") == F.col("class_id"))


#: Exact: all pairs that share a shingle, then the smallest doc_id that links lead to.
OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT min(doc_id) AS doc_id, w FROM d WHERE len(w) > 0 GROUP BY w),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t)),
c AS (SELECT doc_id, s, count(*) AS n FROM g GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS n FROM c x JOIN c y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE p.n >= 0.8 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
m AS (SELECT d.doc_id, CASE WHEN len(d.w) = 0 THEN d.doc_id ELSE k.class_id END AS class_id FROM d LEFT JOIN t ON t.w = d.w LEFT JOIN k ON k.doc_id = t.doc_id)
SELECT doc_id, class_id, doc_id = class_id AS is_first FROM m
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("secrets")
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(spans, k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.spans_text(secret_scan.base_spans(spans)), 256).alias("base_sha256"),
        secret_scan.spans_text(spans).alias("spans"),
    )


def _kind_sql(kind: str, pattern: str, group: int, least: int, order: int) -> str:
    """SQL for the places of one kind: what lies between matches and the matches, summed up."""
    p = re.sub(r"\(\?i:([a-z_?|]+)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern).replace("'", "''")
    return rf"""
SELECT rid, {order} AS o, '{kind}' AS kind, CAST(list_sum(gap[1:i]) + coalesce(list_sum(n[1:i - 1]), 0) AS BIGINT) AS s, n[i] AS len
FROM (SELECT rid, list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS gap,
             list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS n,
             list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS m,
             unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d)
WHERE m[i] >= {least}"""


OP6_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_kind_sql(*r, order=i) for i, r in enumerate(secret_scan.RULES))
    + r"""),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, o) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "method_verdict")


OP9_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(base, verdict, rule) AS (VALUES {", ".join(f"({base}, '{v}', '{r}')" for base, own in ((True, url_filter.RULES), (False, url_filter.METHOD_RULES)) for v, r in own)}),
parts AS (SELECT base, verdict, rule, regexp_extract(rule, '^[^/]*') AS rh, regexp_extract(rule, '^[^/]*(.*)', 1) AS rp FROM rules),
fit AS (SELECT rid, base, rule, verdict, row_number() OVER (PARTITION BY rid, base ORDER BY length(rule) DESC, verdict DESC) AS n FROM u JOIN parts
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
m AS (SELECT u.*, b.rule, b.verdict, coalesce(o.verdict, 'allow') AS method_verdict FROM u
  LEFT JOIN fit b ON u.rid = b.rid AND b.base AND b.n = 1 LEFT JOIN fit o ON u.rid = o.rid AND NOT o.base AND o.n = 1)
SELECT page_id, host, path, rule, coalesce(verdict, method_verdict) AS verdict, method_verdict FROM m
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    same = F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull())
    return back.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/lectern-tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(conversation_repair.damage(table(spark, sf_dir, "conversations")))


_CRC = """xor(list_reduce(list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b: list_reduce(range(0, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295), 4294967295)"""
_LINE = "CASE WHEN x.t IS NULL THEN '' ELSE x.t || chr(10) END"
_WANTED = "CASE x.s WHEN 2 THEN 'assistant' ELSE 'user' END"
_AFTER = "CASE x.s WHEN 2 THEN 3 ELSE 2 END"
_INSERT = f"lambda x: {{'c': x.c + 3, 'a': x.a || 'I', 's': {_AFTER}, 't': {_LINE} || {_WANTED} || ':'}}"
#: Row by row, the cheapest edits that lead to each state (0 start, 1 led, 2 asked, 3 answered), by cost and then as strings.
OP11_SQL = f"""
WITH RECURSIVE k AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC.format(key="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, again, copy) AS i, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
r(k, i, best) AS (SELECT DISTINCT k, 0::BIGINT, [{{'c': 0::BIGINT, 'a': '', 's': 0::INT, 't': NULL::VARCHAR}}] FROM k
  UNION ALL SELECT k, i, list_filter(list_transform(range(0, 4), lambda z: list_sort(list_filter(ways, lambda x: x.s = z))[1]), lambda x: x IS NOT NULL) FROM (
    SELECT k, i, list_concat(list_transform(l, lambda x: {{'c': x.c + 4, 'a': x.a || 'D', 's': x.s, 't': x.t}}), CASE WHEN fault IN (1, 2) THEN [] ELSE list_concat(
      list_transform(l, lambda x: {{'c': x.c + 3 + more, 'a': x.a || 'R', 's': {_AFTER}, 't': {_LINE} || {_WANTED} || ':' || text}}),
      list_transform(list_filter(l, lambda x: (x.s = 0 AND initial = 's') OR (x.s <> 2 AND initial = 'u') OR (x.s = 2 AND initial = 'a')),
        lambda x: {{'c': x.c + more, 'a': x.a || 'K', 's': CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 't': {_LINE} || role || ':' || text}})) END) AS ways
    FROM (SELECT k, i, role, text, fault, left(role, 1) AS initial, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more, list_concat(best, one, list_transform(one, {_INSERT})) AS l
      FROM (SELECT n.k, n.i, n.role, n.text, n.fault, r.best, list_transform(r.best, {_INSERT}) AS one FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)))),
e AS (SELECT k, list_sort(list_transform(best, lambda x: CASE x.s WHEN 1 THEN {{'c': x.c + 6, 'a': x.a || 'II', 't': {_LINE} || 'user:' || chr(10) || 'assistant:'}}
  WHEN 2 THEN {{'c': x.c + 3, 'a': x.a || 'I', 't': {_LINE} || 'assistant:'}} ELSE {{'c': x.c, 'a': x.a, 't': x.t}} END))[1] AS x FROM (SELECT k, arg_max(best, i) AS best FROM r GROUP BY k)),
p AS (SELECT k, left(lag(role) OVER (PARTITION BY k ORDER BY i), 1) || left(role, 1) AS two, turn, fault, i FROM n),
g AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY k),
i AS (SELECT DISTINCT k, conv_id FROM k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(x.c AS BIGINT) AS cost, x.a AS audit, sha256(coalesce(x.t, '')) AS repaired_sha256 FROM i JOIN e USING (k) LEFT JOIN g USING (k)
"""


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = token_alignment.aligned_digests(table(spark, sf_dir, "documents"), *files)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_store": op8_token_store,
    "op9_url_filter": op9_url_filter,
    "op10_topk": op10_topk,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_nearest": op12_nearest,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op3_near_dedup": OP3_SQL,
    "op6_secret_scan": OP6_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_topk": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
}
