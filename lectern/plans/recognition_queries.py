"""Queries of statistics and recognition operators over pixels, lines and symbols derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import recognition as R
from ..operators import statistics as St
from ..operators import windows as W
from ..session import table
from .geometry_queries import LINES_ONCE, lines

WIDTH, HEIGHT = 48, 32
PIXELS = f"""SELECT l_suppkey AS image, CAST(l_partkey % {WIDTH} AS INT) AS x, CAST(l_orderkey % {HEIGHT} AS INT) AS y,
  CAST(max(l_quantity * 5) AS INT) AS r, CAST(max((l_partkey * 7) % 256) AS INT) AS g, CAST(max((l_orderkey * 3) % 256) AS INT) AS b FROM lineitem GROUP BY 1, 2, 3"""
LUM = "CAST(floor(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b) AS INT)"
SYMBOLS = """SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_suppkey % 4 AS INT) AS variant, chr(CAST(19968 + max(l_partkey) % 3 AS INT)) AS "char",
  CAST(max(40 + l_quantity) AS INT) AS confidence FROM lineitem GROUP BY 1, 2, 3"""


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lectern_lineitem")
    return spark.sql(query.replace("FROM lineitem", "FROM lectern_lineitem").replace('"char"', "char"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PIXELS).withColumn("lum", St.luminance(F.col("r"), F.col("g"), F.col("b")))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned symbols of four variants; the character code is made in Spark, whose chr() is of bytes."""
    text = "SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_suppkey % 4 AS INT) AS variant, CAST(max(l_partkey) % 3 AS INT) AS c, CAST(max(40 + l_quantity) AS INT) AS confidence FROM lineitem GROUP BY 1, 2, 3"
    return _sql(spark, sf_dir, text).select("image", "pos", "variant", F.element_at(F.array(F.lit("一"), F.lit("丁"), F.lit("丂")), F.col("c") + 1).alias("char"), "confidence")


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("chars", F.col("l_linenumber").cast("bigint"))
    keys = ["l_returnflag"]
    plain = St.upper_median(rows, keys, "l_extendedprice", "upper_median")
    weighted = St.weighted_upper_median(rows, keys, "l_quantity", "chars", name="weighted_median")
    top = St.top_share(rows, keys, "l_extendedprice", name="top")
    return plain.join(weighted, keys).join(top, keys)


MEDIANS_SQL = """
WITH a AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) - 1 AS j,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
w AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS upto, l_linenumber AS own, sum(l_linenumber) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT m.l_returnflag, upper_median, weighted_median, top FROM (SELECT l_returnflag, l_extendedprice AS upper_median FROM a WHERE i = n // 2) m
  JOIN (SELECT l_returnflag, max(l_quantity) AS weighted_median FROM w WHERE n // 2 < upto AND n // 2 >= upto - own GROUP BY 1) x USING (l_returnflag)
  JOIN (SELECT l_returnflag, l_extendedprice AS top FROM a WHERE j = floor(n * 0.05::DOUBLE)) t USING (l_returnflag)
"""


def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.otsu(St.histogram(pixels(spark, sf_dir).withColumnRenamed("lum", "bin"), ["image"], "bin"), ["image"])


OTSU_SQL = f"""
WITH p AS ({PIXELS}), h AS (SELECT image, {LUM} AS bin, count(*) AS c FROM p GROUP BY ALL),
v AS (SELECT image, bin, sum(c) OVER (PARTITION BY image) AS n, sum(bin * c) OVER (PARTITION BY image) AS total, sum(c) OVER w AS wb, sum(bin * c) OVER w AS sb FROM h WINDOW w AS (PARTITION BY image ORDER BY bin ROWS UNBOUNDED PRECEDING)),
k AS (SELECT image, bin, CASE WHEN n > wb THEN CAST(wb AS DOUBLE) * CAST(n - wb AS DOUBLE) * (CAST(sb AS DOUBLE) / CAST(wb AS DOUBLE) - CAST(total - sb AS DOUBLE) / CAST(n - wb AS DOUBLE)) * (CAST(sb AS DOUBLE) / CAST(wb AS DOUBLE) - CAST(total - sb AS DOUBLE) / CAST(n - wb AS DOUBLE)) ELSE 0 END AS between_ FROM v)
SELECT image, CASE WHEN between_ > 0 THEN bin ELSE 127 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY between_ DESC, bin) AS i FROM k) WHERE i = 1
"""


def image_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean brightness, ink polarity and border colour of every image."""
    p = pixels(spark, sf_dir)
    edge = St.border_mean(p, ["image"], WIDTH, HEIGHT).select("image", *[F.col(c).alias(f"pad_{c}") for c in "rgb"])
    return St.polarity(p, ["image"]).select("image", F.round("mean", 6).alias("mean"), "dark_ink").join(edge, "image", "left")


LEVELS_SQL = f"""
WITH p AS ({PIXELS}), m AS (SELECT image, avg((r + g + b) / 3) AS mean FROM p GROUP BY image),
e AS (SELECT *, CASE WHEN x IN (0, {WIDTH - 1}) THEN 1 ELSE 0 END + CASE WHEN y IN (0, {HEIGHT - 1}) THEN 1 ELSE 0 END AS n FROM p),
b AS (SELECT image, CAST(floor(sum(r * n) / sum(n) + 0.5::DOUBLE) AS INT) AS pad_r, CAST(floor(sum(g * n) / sum(n) + 0.5::DOUBLE) AS INT) AS pad_g, CAST(floor(sum(b * n) / sum(n) + 0.5::DOUBLE) AS INT) AS pad_b FROM e WHERE n > 0 GROUP BY image)
SELECT image, round(mean, 6) AS mean, mean >= 128 AS dark_ink, pad_r, pad_g, pad_b FROM m LEFT JOIN b USING (image)
"""


#: Strokes of two rows and columns in every few, on white, so that images have bands of ink.
STROKES = f"""SELECT image, x, y, CASE WHEN paper THEN 255 ELSE r END AS r, CASE WHEN paper THEN 255 ELSE g END AS g, CASE WHEN paper THEN 250 ELSE b END AS b
  FROM (SELECT *, (y + image) % (4 + image % 5) >= 2 OR (x + image * 3) % (3 + image % 7) >= 2 AS paper FROM ({PIXELS}) p) q"""


def ink_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of ink of every image along both sides: number, largest thickness and pitch, 0 without a pitch."""
    p = _sql(spark, sf_dir, STROKES)
    level, sides = St.polarity(p, ["image"]), []
    for at, size in (("y", HEIGHT), ("x", WIDTH)):
        runs = W.bands(St.ink_profile(p, ["image"], level, at, size), ["image"], at, F.col("ink") > 0)
        pitch = runs.withColumn("pitch", F.col("start") - F.lag("start").over(W.Window.partitionBy("image").orderBy("start")))
        median = St.upper_median(pitch.where("pitch IS NOT NULL"), ["image"], "pitch", "pitch", rounds=0)  # a picture has few bands
        total = runs.groupBy("image").agg(F.count("*").alias("n_bands"), F.max("thickness").alias("thickest"))
        sides.append(total.join(median, "image", "left").select("image", F.lit(at).alias("side"), "n_bands", "thickest", F.coalesce("pitch", F.lit(0)).cast("int").alias("pitch")))
    return sides[0].unionByName(sides[1])


BANDS_SQL = f"""
WITH p AS ({STROKES}), m AS (SELECT image, avg((r + g + b) / 3) AS mean FROM p GROUP BY image),
k AS (SELECT p.image, x, y FROM p JOIN m USING (image) WHERE CASE WHEN mean >= 128 THEN (r + g + b) / 3 < mean - 30 ELSE (r + g + b) / 3 > mean + 30 END),
f AS (SELECT DISTINCT image, 'y' AS side, y AS place FROM k UNION ALL SELECT DISTINCT image, 'x', x FROM k),
i AS (SELECT image, side, place, place - row_number() OVER (PARTITION BY image, side ORDER BY place) AS isle FROM f),
b AS (SELECT image, side, min(place) AS start, count(*) AS thickness FROM i GROUP BY image, side, isle),
d AS (SELECT image, side, start - lag(start) OVER (PARTITION BY image, side ORDER BY start) AS pitch FROM b),
o AS (SELECT image, side, pitch, row_number() OVER (PARTITION BY image, side ORDER BY pitch) - 1 AS i, count(*) OVER (PARTITION BY image, side) AS n FROM d WHERE pitch IS NOT NULL)
SELECT t.image, t.side, n_bands, thickest, coalesce(o.pitch, 0) AS pitch FROM (SELECT image, side, count(*) AS n_bands, max(thickness) AS thickest FROM b GROUP BY image, side) t
  LEFT JOIN o ON o.image = t.image AND o.side = t.side AND o.i = o.n // 2
"""


def text_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _sql(spark, sf_dir, STROKES)
    cells = St.grid_scores(p.join(St.polarity(p, ["image"]), "image"), ["image"], St.is_ink(), 8)
    return St.best_patch(cells, ["image"], 2, 2).select("image", "cx", "cy", F.col("total").cast("long").alias("total"))


PATCH_SQL = f"""
WITH s AS ({STROKES}), m AS (SELECT image, avg((r + g + b) / 3) AS mean FROM s GROUP BY image),
p AS (SELECT s.image, x, y, CASE WHEN mean >= 128 THEN (r + g + b) / 3 < mean - 30 ELSE (r + g + b) / 3 > mean + 30 END AS ink, x // 8 AS cx, y // 8 AS cy FROM s JOIN m USING (image) WHERE y % 2 = 0),
t AS (SELECT image, cx, cy, ink, CASE WHEN ink <> lag(ink, 1, false) OVER (PARTITION BY image, cy, y, cx ORDER BY x) THEN 1 ELSE 0 END AS turn FROM p),
c AS (SELECT image, cx, cy, CASE WHEN sum(CASE WHEN ink THEN 1 ELSE 0 END) / 32 > 0.03 AND sum(CASE WHEN ink THEN 1 ELSE 0 END) / 32 < 0.6 THEN sum(turn) ELSE 0 END AS score FROM t GROUP BY ALL),
s2 AS (SELECT a.image, a.cx, a.cy, a.score + b.score + d.score + e.score AS total FROM c a JOIN c b ON b.image = a.image AND b.cx = a.cx + 1 AND b.cy = a.cy JOIN c d ON d.image = a.image AND d.cx = a.cx AND d.cy = a.cy + 1
  JOIN c e ON e.image = a.image AND e.cx = a.cx + 1 AND e.cy = a.cy + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY total DESC, cy, cx) AS i FROM s2 WHERE total > 0)
SELECT image, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, CAST(total AS BIGINT) AS total FROM r WHERE i = 1
"""

SYMBOLS_SQL = """s AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_suppkey % 4 AS INT) AS variant, ['一', '丁', '丂'][CAST(max(l_partkey) % 3 AS INT) + 1] AS c,
  CAST(max(40 + l_quantity) AS INT) AS confidence FROM lineitem GROUP BY 1, 2, 3)"""


def fuse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(symbols(spark, sf_dir), ["image"])


FUSE_SQL = f"""
WITH {SYMBOLS_SQL},
v AS (SELECT image, pos, c, sum(confidence) AS score, min(variant) AS first FROM s GROUP BY ALL),
b AS (SELECT image, pos, c AS winner FROM (SELECT *, row_number() OVER (PARTITION BY image, pos ORDER BY score DESC, first) AS i FROM v) WHERE i = 1),
w AS (SELECT image, pos, max(c) FILTER (variant = 0) AS base, max(confidence) FILTER (variant = 0) AS confidence, count(*) FILTER (variant > 0) AS n, min(c) FILTER (variant > 0) AS low, max(c) FILTER (variant > 0) AS high FROM s GROUP BY ALL),
u AS (SELECT *, n >= 2 AND coalesce(low = high AND low <> base, false) AS unanimous FROM w WHERE base IS NOT NULL)
SELECT image, pos, CASE WHEN unanimous THEN low WHEN confidence < 88 THEN winner ELSE base END AS "char", unanimous FROM u JOIN b USING (image, pos)
"""


#: Denser variants for dictionary work: every position of an order in four variants.
def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kanji = F.array(*[F.lit(c) for c in "一丁丂"])
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("bigint").alias("pos")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    dense = items.withColumn("variant", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    code = F.when(F.col("variant") == 0, F.col("p") % 3).otherwise((F.col("p") + F.floor((F.col("s") + F.col("variant")) / 3) % 2) % 3)
    chars = dense.select("image", "pos", "variant", F.element_at(kanji, code.cast("int") + 1).alias("char"), F.lit(50).alias("confidence"))
    part = table(spark, sf_dir, "part").where("p_partkey % 3 <> p_size % 3")
    words = part.select(F.concat(F.element_at(kanji, (F.col("p_partkey") % 3).cast("int") + 1), F.element_at(kanji, (F.col("p_size") % 3).cast("int") + 1)).alias("word")).distinct()
    return chars, words


def dictionary_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dictionary_candidates(*(lambda s, w: (s, ["image"], w))(*_dense(spark, sf_dir))).select("image", "start", F.col("len").cast("int").alias("len"), "word", "support")


DICTIONARY_SQL = """
WITH i AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS pos, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
d AS (SELECT image, pos, v AS variant, ['一', '丁', '丂'][CAST(CASE WHEN v = 0 THEN p % 3 ELSE (p + ((s + v) // 3) % 2) % 3 END AS INT) + 1] AS c FROM i, (VALUES (0), (1), (2), (3)) t(v)),
lex AS (SELECT DISTINCT ['一', '丁', '丂'][CAST(p_partkey % 3 AS INT) + 1] || ['一', '丁', '丂'][CAST(p_size % 3 AS INT) + 1] AS word FROM part WHERE p_partkey % 3 <> p_size % 3),
n(len) AS (VALUES (2), (3), (4)),
w AS (SELECT a.image, a.pos AS start, n.len, a.variant, string_agg(b.c, '' ORDER BY b.pos) AS word, count(*) AS k FROM d a JOIN n ON true JOIN d b ON b.image = a.image AND b.variant = a.variant AND b.pos >= a.pos AND b.pos < a.pos + n.len GROUP BY ALL HAVING count(*) = n.len),
o AS (SELECT w.* FROM w WHERE variant = 0 AND word NOT IN (SELECT word FROM lex))
SELECT w.image, w.start, CAST(w.len AS INT) AS len, w.word, count(*) AS support FROM o JOIN w ON w.image = o.image AND w.start = o.start AND w.len = o.len AND w.variant > 0 AND w.word <> o.word
WHERE w.word IN (SELECT word FROM lex) GROUP BY ALL HAVING count(*) >= 2
"""


def dictionary_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, words = _dense(spark, sf_dir)
    chosen = R.choose_windows(R.dictionary_candidates(chars, ["image"], words), ["image"])
    base = chars.where("variant = 0").groupBy("image").agg(F.array_sort(F.collect_list(F.struct("pos", "char"))).alias("c"))
    subs = chosen.groupBy("image").agg(F.collect_list(F.struct("start", "len", "word")).alias("subs"))
    text = F.array_join(F.transform("c", lambda s: s["char"]), "")
    at = F.transform("subs", lambda s: F.struct((F.array_position(F.transform("c", lambda x: x["pos"]), s["start"]) - 1).alias("start"), s["len"].alias("len"), s["word"].alias("word")))
    after = F.when(F.col("subs").isNull(), text).otherwise(R.substitute(text, at))
    return base.join(subs, "image", "left").select("image", text.alias("before"), after.alias("after"))


#: Candidates in their order of preference, taken one by one while no place is taken yet.
CHOICE_OF_WORDS_SQL = f"""
WITH c AS ({DICTIONARY_SQL}), i AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS pos, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
b AS (SELECT image, list(pos ORDER BY pos) AS places, list(['一', '丁', '丂'][CAST(p % 3 AS INT) + 1] ORDER BY pos) AS cs FROM i GROUP BY image),
o AS (SELECT image, list({{'s': start, 'n': len, 'w': word}} ORDER BY len DESC, support DESC, start, word) AS l FROM c GROUP BY image),
t AS (SELECT image, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x.s + x.n AND x.s < y.s + y.n)) > 0 THEN acc ELSE list_append(acc, x) END, [l[1]]) AS taken FROM o)
SELECT b.image, array_to_string(cs, '') AS before, array_to_string(list_transform(range(1, len(cs) + 1), lambda k: coalesce(
  list_filter(list_transform(taken, lambda y: CASE WHEN places[k] >= y.s AND places[k] < y.s + y.n THEN substr(y.w, CAST(places[k] - y.s + 1 AS BIGINT), 1) END), lambda z: z IS NOT NULL)[1], cs[k])), '') AS after
FROM b LEFT JOIN t USING (image)
"""


def align_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower(F.concat("p_type", F.lit(" "), "p_brand")).alias("other"))
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["base"].cast("string"), F.lit(":"), p["other"].cast("string"))), ",").alias("pairs")
    return R.align_variants(rows, ["p_partkey"], "p_name", "other").select("p_partkey", "distance", pairs)


#: Alignment of the lists of pr(id, a, b): rows of the table of costs, then the way back; al(id, i, j) are its diagonal steps.
ALIGN_CTE = """dp(id, i, r) AS (SELECT id, 0::BIGINT, range(0, len(b) + 1) FROM pr UNION ALL
  SELECT dp.id, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(r[j + 1] + 1, acc[j] + 1, r[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END)), [i + 1]) FROM dp JOIN pr ON pr.id = dp.id WHERE i < len(a)),
tb(id, i, j, met) AS (SELECT id, len(a)::BIGINT, len(b)::BIGINT, false FROM pr UNION ALL
  SELECT id, CASE WHEN diagonal OR up THEN i - 1 ELSE i END, CASE WHEN diagonal OR NOT up THEN j - 1 ELSE j END, diagonal FROM (
    SELECT tb.id, tb.i, tb.j, x.r[tb.j + 1] = y.r[tb.j] + CASE WHEN a[tb.i] = b[tb.j] THEN 0 ELSE 1 END AS diagonal, x.r[tb.j + 1] = y.r[tb.j + 1] + 1 AS up
    FROM tb JOIN pr ON pr.id = tb.id JOIN dp x ON x.id = tb.id AND x.i = tb.i JOIN dp y ON y.id = tb.id AND y.i = tb.i - 1 WHERE tb.i > 0 AND tb.j > 0)),
al AS (SELECT id, i, j FROM tb WHERE met)"""
ALIGN_SQL = f"""
WITH RECURSIVE pr AS (SELECT p_partkey AS id, string_split(p_name, '') AS a, string_split(lower(p_type || ' ' || p_brand), '') AS b FROM part), {ALIGN_CTE},
g AS (SELECT id, string_agg(i || ':' || j, ',' ORDER BY i) AS pairs FROM al GROUP BY id)
SELECT p_partkey, levenshtein(p_name, lower(p_type || ' ' || p_brand)) AS distance, coalesce(pairs, '') AS pairs FROM part LEFT JOIN g ON g.id = p_partkey
"""

#: Symbols of four recognitions of a text: others lack a symbol, have one too many at the start, or read one otherwise.
_LENGTH, _KANJI = "(6 + p_partkey % 8)", "['一', '丁', '丂', '七', '丄']"
_CODE = f"CASE WHEN v > 0 AND i = (p_size + 2 * v) % {_LENGTH} THEN (p_size + v) % 5 ELSE (p_partkey * (i + 3)) % 5 END"
_CONFIDENCE = "CAST(60 + (p_size * 7 + i * 11 + v * 5) % 40 AS INT)"
_GONE = f"v > 0 AND (p_partkey + v) % 3 = 0 AND i = (p_partkey + v) % {_LENGTH}"


def fused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the first recognition and what the others, aligned with it, make of them."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(*[F.lit(v) for v in range(4)])).alias("v"))
    symbol = f"named_struct('text', array({_KANJI[1:-1]})[CAST({_CODE} AS INT)], 'confidence', {_CONFIDENCE})"
    read = f"transform(filter(sequence(0, {_LENGTH} - 1), i -> NOT ({_GONE})), i -> {symbol})"
    more = "CASE WHEN v > 0 AND (p_partkey * v) % 4 = 0 THEN array(named_struct('text', '一', 'confidence', 50)) ELSE array() END"
    variants = part.select("p_partkey", F.col("v").alias("variant"), F.expr(f"concat({more}, {read})").alias("symbols"))
    fused = R.fuse(R.aligned_symbols(variants, ["p_partkey"]), ["p_partkey"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda s: s["char"]), "").alias("fused")
    before = F.array_join(F.transform("symbols", lambda s: s["text"]), "").alias("before")
    return variants.where("variant = 0").select("p_partkey", before).join(fused.groupBy("p_partkey").agg(text), "p_partkey")


FUSED_SQL = f"""
WITH RECURSIVE s0 AS (SELECT p_partkey, p_size, v, i FROM part, (VALUES (0), (1), (2), (3)) t(v), LATERAL (SELECT unnest(range(0, {_LENGTH})) AS i)),
sy AS (SELECT p_partkey, v, i, {_KANJI}[CAST({_CODE} AS INT) + 1] AS c, {_CONFIDENCE} AS conf FROM s0 WHERE NOT ({_GONE}) UNION ALL SELECT p_partkey, v, -1, '一', 50 FROM part, (VALUES (1), (2), (3)) t(v) WHERE (p_partkey * v) % 4 = 0),
l AS (SELECT p_partkey, v, list(c ORDER BY i) AS cs, list(conf ORDER BY i) AS fs FROM sy GROUP BY ALL),
pr AS (SELECT o.p_partkey * 4 + o.v AS id, b.cs AS a, o.cs AS b, o.fs FROM l o JOIN l b ON b.p_partkey = o.p_partkey AND b.v = 0 WHERE o.v > 0), {ALIGN_CTE},
s AS (SELECT p_partkey AS image, i - 1 AS pos, 0 AS variant, cs[i] AS c, fs[i] AS confidence FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM l WHERE v = 0)
  UNION ALL SELECT al.id // 4, al.i, al.id % 4, pr.b[al.j + 1], pr.fs[al.j + 1] FROM al JOIN pr ON pr.id = al.id),
v AS (SELECT image, pos, c, sum(confidence) AS score, min(variant) AS first FROM s GROUP BY ALL),
b AS (SELECT image, pos, c AS winner FROM (SELECT *, row_number() OVER (PARTITION BY image, pos ORDER BY score DESC, first) AS i FROM v) WHERE i = 1),
w AS (SELECT image, pos, max(c) FILTER (variant = 0) AS base, max(confidence) FILTER (variant = 0) AS confidence, count(*) FILTER (variant > 0) AS n, min(c) FILTER (variant > 0) AS low, max(c) FILTER (variant > 0) AS high FROM s GROUP BY ALL),
u AS (SELECT *, n >= 2 AND coalesce(low = high AND low <> base, false) AS unanimous FROM w),
f AS (SELECT image, string_agg(base, '' ORDER BY pos) AS before, string_agg(CASE WHEN unanimous THEN low WHEN confidence < 88 THEN winner ELSE base END, '' ORDER BY pos) AS fused FROM u JOIN b USING (image, pos) GROUP BY image)
SELECT image AS p_partkey, before, fused FROM f
"""


def refinement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales at which a text is read again, by its branch, for pictures, budgets and earlier readings derived from orders."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(8 + o_orderkey % 30 AS DOUBLE) AS glyph", "CAST(o_totalprice * 12 AS BIGINT) AS area", "o_custkey % 2 = 0 AS twofold", "o_orderkey % 4 AS budget", "o_custkey % 50 + 50 AS confidence")
    branch = R.refinement_branch(F.lit("primary"), F.col("glyph"), F.col("confidence"))
    scales = F.when(F.col("branch") == "fusion", F.array(F.lit(1.5), F.lit(2.0), F.lit(3.0))).when(F.col("branch") == "rerank", G.rerank_scales(F.col("glyph"))).otherwise(F.array().cast("array<double>"))
    made = R.upscaling_steps(F.col("scales"), F.col("area"), F.col("twofold"), F.col("budget"))
    return o.withColumn("branch", branch).withColumn("scales", scales).select("o_orderkey", "branch", F.array_join(F.transform(made, lambda x: F.format_number(x, 2)), ",").alias("scales"))


PLAN_SQL = """
WITH o AS (SELECT o_orderkey, CAST(8 + o_orderkey % 30 AS DOUBLE) AS glyph, CAST(trunc(o_totalprice * 12) AS BIGINT) AS area, o_custkey % 2 = 0 AS twofold, o_orderkey % 4 AS budget, o_custkey % 50 + 50 AS confidence FROM orders),
b AS (SELECT *, CASE WHEN glyph < 18 THEN 'fusion' WHEN confidence < 92 THEN 'rerank' ELSE 'none' END AS branch FROM o),
x AS (SELECT *, CASE branch WHEN 'fusion' THEN [1.5::DOUBLE, 2, 3] WHEN 'rerank' THEN list_filter(list_transform([20, 24, 30], lambda s: floor(s / glyph * 100 + 0.5::DOUBLE) / 100), lambda s: s <> 1 AND s >= 0.4 AND s <= 3) ELSE [] END AS l FROM b),
u AS (SELECT o_orderkey, i, l[i] AS s, area * l[i] * l[i] <= 8400000 AS fits, twofold, budget FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM x)),
c AS (SELECT *, sum(CASE WHEN NOT fits OR (s = 2 AND twofold) THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS spent FROM u),
m AS (SELECT o_orderkey, string_agg(format('{:.2f}', s), ',' ORDER BY i) AS scales FROM c WHERE fits AND spent <= budget GROUP BY o_orderkey)
SELECT o_orderkey, branch, coalesce(scales, '') AS scales FROM b LEFT JOIN m USING (o_orderkey)
"""

#: Texts of lines, and the words of small ones as they come from reading them again.
_BODY = "array_join(transform(sequence(0, chars % 10 + 2), i -> CASE WHEN (i + image) % 3 = 0 THEN 'の' WHEN i = 1 THEN ' 漢' ELSE '漢' END), '')"
_SPLIT = "x0 + (x1 - x0) * (CAST(0.3 AS DOUBLE) + CAST(seq % 4 AS DOUBLE) / 10)"


def ruby_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every image with the readings above them put in place of what they stand above; null where that fails."""
    rows = lines(spark, sf_dir)
    text = F.when(F.col("size") >= 12, F.expr(_BODY)).when(F.col("seq") % 5 == 0, "注").otherwise("かな")
    words = rows.where("size < 12").select("image", "seq", F.inline(F.array(
        F.struct(F.lit(0).alias("word_no"), F.expr("repeat('か', CAST(seq % 3 + 1 AS INT))").alias("text"), F.col("x0").alias("start"), F.expr(_SPLIT).alias("end")),
        F.struct(F.lit(1).alias("word_no"), F.expr("CASE WHEN image % 11 = 0 THEN 'ab' ELSE repeat('き', CAST(image % 4 + 1 AS INT)) END").alias("text"), F.expr("x0 + (x1 - x0) * CAST(0.6 AS DOUBLE)").alias("start"), F.col("x1").alias("end")),
    )))
    return R.ruby_text(rows.withColumn("text", text), words, ["image"], most=2).select("image", F.col("text").alias("ruby_text"))


RUBY_LINES_SQL = f"""
WITH r AS ({LINES_ONCE}), t AS (SELECT *, y1 - y0 AS height, CASE WHEN size >= 12 THEN array_to_string(list_transform(range(0, chars % 10 + 3), lambda i: CASE WHEN (i + image) % 3 = 0 THEN 'の' WHEN i = 1 THEN ' 漢' ELSE '漢' END), '')
  WHEN seq % 5 = 0 THEN '注' ELSE 'かな' END AS text FROM r),
n AS (SELECT *, replace(text, ' ', '') AS flat, length(replace(text, ' ', '')) AS n FROM t),
c AS (SELECT image, height, sum(n) OVER (PARTITION BY image ORDER BY height, seq ROWS UNBOUNDED PRECEDING) AS upto, n AS own, sum(n) OVER (PARTITION BY image) AS total FROM n WHERE height > 0),
z AS (SELECT image, max(height) AS body FROM c WHERE total >= 4 AND total // 2 < upto AND total // 2 >= upto - own GROUP BY image),
k AS (SELECT n.*, z.body, coalesce(text NOT LIKE '%漢%' AND text NOT LIKE '%注%' AND height > 0 AND height < body * 0.6::DOUBLE, false) AS aid FROM n LEFT JOIN z USING (image)),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY seq) AS k FROM k WHERE aid) WHERE k <= 2),
b AS (SELECT * FROM k WHERE NOT aid AND body IS NOT NULL),
p AS (SELECT a.image, a.seq AS small, b.seq AS seq, row_number() OVER (PARTITION BY a.image, a.seq ORDER BY b.y0 - a.y1, b.seq) AS i FROM a JOIN b ON a.image = b.image AND b.y0 - a.y1 >= -a.body AND b.y0 - a.y1 <= 1.5::DOUBLE * a.body AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0),
w AS (SELECT image, seq, body, 0 AS no, repeat('か', CAST(seq % 3 + 1 AS INT)) AS word, x0 AS s, {_SPLIT} AS e FROM k WHERE size < 12
  UNION ALL SELECT image, seq, body, 1, CASE WHEN image % 11 = 0 THEN 'ab' ELSE repeat('き', CAST(image % 4 + 1 AS INT)) END, x0 + (x1 - x0) * CAST(0.6 AS DOUBLE), x1 FROM k WHERE size < 12),
v AS (SELECT *, no = 1 AND s - lag(e) OVER (PARTITION BY image, seq ORDER BY no) > body * 0.6::DOUBLE AS opens FROM w),
g AS (SELECT image, seq AS small, CASE WHEN no = 0 THEN 0 WHEN opens THEN 1 ELSE 0 END AS no2, string_agg(word, '' ORDER BY no) AS reading, min(s) AS s, max(e) AS e FROM v GROUP BY ALL),
h AS (SELECT g.*, p.seq, b.flat, b.n, b.x0, b.x1 FROM g JOIN p ON p.image = g.image AND p.small = g.small AND p.i = 1 JOIN b ON b.image = p.image AND b.seq = p.seq),
o AS (SELECT *, (x1 - x0) / n AS unit, least(x0 + i * ((x1 - x0) / n) + (x1 - x0) / n, e) - greatest(x0 + i * ((x1 - x0) / n), s) AS ov FROM (SELECT *, unnest(range(0, n)) AS i FROM h WHERE x1 > x0 AND regexp_matches(reading, '^[かき]+$'))),
q AS (SELECT *, i - row_number() OVER (PARTITION BY image, small, no2 ORDER BY i) AS isle FROM o WHERE ov > unit * 0.35::DOUBLE AND substr(flat, CAST(i + 1 AS BIGINT), 1) IN ('漢', '注')),
u AS (SELECT image, seq, small, no2, reading, min(i) AS start, count(*) AS len, sum(ov) AS score FROM q GROUP BY image, seq, small, no2, reading, isle),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, small, no2 ORDER BY score DESC, start) AS best FROM u) WHERE best = 1 AND length(reading) <= len * 4),
f AS (SELECT image, seq, list({{'start': start, 'len': len, 'word': reading}} ORDER BY start DESC, small, no2) AS subs FROM d GROUP BY image, seq),
m AS (SELECT b.image, b.seq, b.n, b.x1, b.body, CASE WHEN subs IS NULL THEN b.text ELSE list_reduce(subs, lambda acc, x: CASE WHEN x.start + x.len > acc.l THEN acc
    ELSE {{'t': substr(acc.t, 1, CAST(x.start AS BIGINT)) || x.word || substr(acc.t, CAST(x.start + x.len + 1 AS BIGINT)), 'l': CAST(x.start AS BIGINT)}} END, {{'t': b.flat, 'l': CAST(b.n AS BIGINT)}}).t END AS read FROM b LEFT JOIN f ON f.image = b.image AND f.seq = b.seq),
e AS (SELECT *, max(x1) OVER (PARTITION BY image) - x1 > 1.5::DOUBLE * body AND lead(seq) OVER (PARTITION BY image ORDER BY seq) IS NOT NULL AS ends FROM m),
j AS (SELECT image, string_agg(read || CASE WHEN ends THEN chr(10) ELSE '' END, chr(10) ORDER BY seq) AS said, sum(n) AS kept FROM e GROUP BY image),
x AS (SELECT image, sum(n) AS total, bool_or(aid) AS aided FROM k GROUP BY image)
SELECT x.image, CASE WHEN aided AND kept > 0 AND kept >= total * 0.3::DOUBLE THEN said END AS ruby_text FROM x LEFT JOIN j USING (image)
"""


def ruby_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a reading-aid line in recognizer order, grouped where a gap opens."""
    rows = W.gap_groups(lines(spark, sf_dir), ["image"], "seq", F.col("x0"), F.col("x1"), F.lit(7.2))
    word = F.concat(F.lit("か"), F.col("seq").cast("string"))
    grouped = rows.withColumn("w", word).groupBy("image", "group_no").agg(F.min("x0").alias("start"), F.max("x1").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "w"))), lambda s: s["w"]), "").alias("text"))
    return grouped.select("image", F.col("group_no").cast("long").alias("group_no"), F.col("start").alias("start_x"), F.col("end").alias("end_x"), "text")


GROUPS_SQL = f"""
WITH r AS ({LINES_ONCE}), m AS (SELECT *, max(x1) OVER (PARTITION BY image ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 7.2::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY image ORDER BY seq ROWS UNBOUNDED PRECEDING) AS group_no FROM m)
SELECT image, CAST(group_no AS BIGINT) AS group_no, min(x0) AS start_x, max(x1) AS end_x, string_agg('か' || seq, '' ORDER BY seq) AS text FROM g GROUP BY image, group_no
"""


def paragraph_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.paragraph_ends(lines(spark, sf_dir), ["image"], "seq", "x1", F.lit(12.0)).select("image", F.col("seq").cast("int").alias("seq"), "paragraph_end")


PARAGRAPH_SQL = f"""
WITH r AS ({LINES_ONCE})
SELECT image, CAST(seq AS INT) AS seq, max(x1) OVER (PARTITION BY image) - x1 > 18 AND lead(seq) OVER (PARTITION BY image ORDER BY seq) IS NOT NULL AS paragraph_end FROM r
"""


def ruby_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kanji a reading belongs to: lines of kanji and kana, readings at places from other columns."""
    o = table(spark, sf_dir, "orders")
    chars = F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 9 + 1).cast("int")), lambda i: F.when((i + F.col("o_orderkey")) % 3 == 0, F.lit("の")).otherwise(F.lit("一")))
    p0, p1 = F.lit(0.0), (F.size("chars") * 12).cast("double")
    start = (F.col("o_orderkey") % 60).cast("double")
    end = start + (F.col("o_custkey") % 40).cast("double")
    reading = F.when(F.col("o_orderkey") % 11 == 0, "ab").otherwise(F.repeat(F.lit("か"), (F.col("o_custkey") % 12 + 1).cast("int")))
    run = R.ruby_run(F.col("chars"), p0, p1, start, end, reading)
    return o.withColumn("chars", chars).withColumn("run", run).select("o_orderkey", F.col("run.start").alias("run_start"), F.col("run.len").alias("run_len"))


RUBY_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, o_custkey % 9 + 2 AS n, CAST(o_orderkey % 60 AS DOUBLE) AS s, CAST(o_orderkey % 60 + o_custkey % 40 AS DOUBLE) AS e, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey % 12 + 1 END AS kana FROM orders),
c AS (SELECT *, least(i * 12 + 12, e) - greatest(i * 12, s) AS ov, (i + o_orderkey) % 3 <> 0 AS kanji FROM (SELECT *, unnest(range(0, n)) AS i FROM o)),
w AS (SELECT *, i - row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS isle FROM c WHERE kanji AND ov > 12 * 0.35::DOUBLE),
r AS (SELECT o_orderkey, kana, min(i) AS start, count(*) AS len, sum(ov) AS score FROM w GROUP BY o_orderkey, kana, isle),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, start) AS k FROM r) WHERE k = 1 AND kana > 0 AND kana <= len * 4)
SELECT o.o_orderkey, CAST(b.start AS INT) AS run_start, CAST(b.len AS INT) AS run_len FROM o LEFT JOIN b USING (o_orderkey)
"""


def variant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which recognition is used and what may follow, for confidences derived from orders."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CAST(40 + o_custkey % 60 AS DOUBLE) AS a", "CAST(45 + o_orderkey % 55 AS DOUBLE) AS b", "CAST(50 + (o_custkey + o_orderkey) % 50 AS DOUBLE) AS c", "CAST(30 + (o_custkey * 3) % 60 AS DOUBLE) AS d",
        "CAST(8 + o_orderkey % 30 AS DOUBLE) AS glyph", "o_custkey % 2 = 0 AS ruby", "CAST(100 + o_custkey * 7 AS BIGINT) AS ms", "CAST(o_totalprice * 4 AS BIGINT) AS area",
    )
    v = F.create_map(F.lit("primary"), F.col("a"), F.lit("twofold"), F.col("b"), F.lit("binarized"), F.col("c"), F.lit("turned"), F.col("d"))
    chosen = R.choose_variant(v, F.col("glyph"), F.col("ruby"))
    best = F.when(chosen == "primary", F.col("a")).when(chosen == "twofold", F.col("b")).when(chosen == "binarized", F.col("c")).otherwise(F.col("d"))
    return o.select(
        "o_orderkey", chosen.alias("chosen"), R.refinement_budget(F.col("ms"), F.col("area")).alias("budget"), R.refinement_branch(chosen, F.col("glyph"), best).alias("branch"),
        F.when(F.col("a") >= F.col("d"), "horizontal").otherwise("vertical").alias("orientation"), R.keeps_enough(F.col("a"), F.col("b") * 3).alias("keeps"), R.is_ruby_line(~F.col("ruby"), F.col("glyph"), F.lit(30.0)).alias("ruby_line"),
    )


CHOICE_SQL = """
WITH o AS (SELECT o_orderkey, 40 + o_custkey % 60 AS a, 45 + o_orderkey % 55 AS b, 50 + (o_custkey + o_orderkey) % 50 AS c, 30 + (o_custkey * 3) % 60 AS d, 8 + o_orderkey % 30 AS glyph, o_custkey % 2 = 0 AS ruby,
  100 + o_custkey * 7 AS ms, CAST(trunc(o_totalprice * 4) AS BIGINT) AS area FROM orders),
t AS (SELECT *, a < 92 AND glyph < 24 AND b >= a + 3 AND a < CASE WHEN ruby THEN 60 ELSE 75 END AS two FROM o),
x AS (SELECT *, CASE WHEN two THEN b ELSE a END AS best FROM t), y AS (SELECT *, best < 92 AND c >= best + 3 AND (NOT ruby OR best < 60) AS bin FROM x),
z AS (SELECT *, CASE WHEN bin THEN c ELSE best END AS after FROM y), q AS (SELECT *, after < 55 AND d > after AS turn FROM z),
r AS (SELECT *, CASE WHEN turn THEN 'turned' WHEN bin THEN 'binarized' WHEN two THEN 'twofold' ELSE 'primary' END AS chosen, CASE WHEN turn THEN d ELSE after END AS conf FROM q)
SELECT o_orderkey, chosen, CAST(CASE WHEN area > 1200000 THEN 0 ELSE greatest(floor((15000 - ms) / ms), 0) END AS INT) AS budget,
  CASE WHEN chosen <> 'primary' THEN 'none' WHEN glyph < 18 THEN 'fusion' WHEN conf < 92 THEN 'rerank' ELSE 'none' END AS branch, CASE WHEN a >= d THEN 'horizontal' ELSE 'vertical' END AS orientation,
  a >= b * 3 * 0.3::DOUBLE AS keeps, ruby AND glyph < 30 * 0.6::DOUBLE AS ruby_line FROM r
"""


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested recognition results, built from conversations, taken apart to symbols and put together again."""
    words = F.transform(F.split("text", " ", -1), lambda w: F.struct(F.transform(F.filter(F.split(w, "", -1), lambda c: c != ""), lambda c: F.struct(c.alias("text"), F.lit(90).alias("confidence"))).alias("symbols")))
    tree = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", words.alias("words")))), lambda l: F.struct(l["words"].alias("words"))).alias("lines"))
    blocks = tree.select("conv_id", F.array(F.struct(F.array(F.struct("lines")).alias("paragraphs"))).alias("blocks"))
    out = R.rebuild_lines(R.flatten_tree(blocks, ["conv_id"]), ["conv_id"])
    return out.select("conv_id", F.col("line").cast("long").alias("line"), "text")


TREE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, line, array_to_string(w, ' ') AS text FROM t WHERE len(w) > 0
"""

QUERIES = {
    "medians": (medians, MEDIANS_SQL),
    "otsu": (otsu, OTSU_SQL),
    "image_levels": (image_levels, LEVELS_SQL),
    "ink_bands": (ink_bands, BANDS_SQL),
    "text_patch": (text_patch, PATCH_SQL),
    "fuse_variants": (fuse_variants, FUSE_SQL),
    "dictionary_rerank": (dictionary_rerank, DICTIONARY_SQL),
    "dictionary_choice": (dictionary_choice, CHOICE_OF_WORDS_SQL),
    "align_names": (align_names, ALIGN_SQL),
    "fused_texts": (fused_texts, FUSED_SQL),
    "refinement_plan": (refinement_plan, PLAN_SQL),
    "ruby_lines": (ruby_lines, RUBY_LINES_SQL),
    "ruby_groups": (ruby_groups, GROUPS_SQL),
    "paragraph_ends": (paragraph_ends, PARAGRAPH_SQL),
    "ruby_runs": (ruby_runs, RUBY_SQL),
    "variant_choice": (variant_choice, CHOICE_SQL),
    "tree_lines": (tree_lines, TREE_SQL),
}
