"""Queries of the validation rules and pixel kernels over inputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import kernels as K
from ..operators import validation as V
from ..session import dealt, table
from .recognition_queries import HEIGHT, LUM, PIXELS, WIDTH, pixels

# messages derived from events, in SQL that both engines read alike
_TYPES = V.REQUESTS + V.NOTICES + ["BOGUS"]
MESSAGE = f"""event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CASE event_id % {len(_TYPES)} {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES))} END END AS type,
  event_id % 41 <> 0 AS internal, CASE WHEN event_id % {len(_TYPES)} >= {len(V.REQUESTS)} AND event_id % 7 <> 0 THEN 'background' END AS target, event_id % 29 <> 0 AS from_offscreen,
  CASE WHEN event_id % 13 = 0 THEN -1 WHEN event_id % 17 <> 0 THEN user_id END AS tab_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS sender_tab,
  CASE event_id % 3 WHEN 0 THEN 'options' WHEN 1 THEN 'capture' END AS page, value / 200 AS progress, CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 19 = 0 THEN repeat('x', 200001) ELSE event_type END AS text,
  CASE WHEN event_id % 23 = 0 THEN repeat('e', 2001) WHEN event_id % 2 = 0 THEN '' END AS error, CAST(value * 5000 AS BIGINT) AS speaker_id, user_id % 3 AS frame_id,
  CAST(value - 2 AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y, CAST(value * 40 AS DOUBLE) AS width, CAST(user_id * 900 AS DOUBLE) AS height, CAST(user_id * 1200 - 1200 AS DOUBLE) AS viewport"""


def message_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("lectern_events")
    m = spark.sql(f"SELECT {MESSAGE} FROM lectern_events")
    columns = {c: F.col(c) for c in m.columns} | {"bad_rect": V.bad_rect(*[F.col(c) for c in ("x", "y", "width", "height", "viewport")]), "data_url_chars": (F.col("value_chars") if "value_chars" in m.columns else F.lit(10))}
    return m.select("event_id", V.request_reason(columns).alias("reason"))


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


MESSAGE_SQL = f"""
WITH m AS (SELECT {MESSAGE} FROM events), b AS (SELECT *, trim(coalesce(text, '')) = '' AS blank,
  NOT (x >= 0 AND y >= 0 AND width >= 1 AND height >= 1 AND width <= 100000 AND height <= 100000 AND width * height <= 100000000 AND viewport >= 1 AND viewport <= 100000) AS bad FROM m)
SELECT event_id, CASE WHEN type IS NULL THEN 'message' WHEN NOT internal THEN 'sender' WHEN coalesce(target, '') = 'background' THEN CASE
  WHEN NOT from_offscreen THEN 'sender' WHEN type NOT IN {_in(V.NOTICES)} THEN 'type' WHEN coalesce(tab_id, 0) < 0 THEN 'tab' WHEN type = 'OCR_PROGRESS' AND NOT (progress BETWEEN 0 AND 1) THEN 'progress'
  WHEN type IN {_in(V.NOTICES[:2])} AND tab_id IS NULL THEN 'tab' WHEN type = 'OCR_COMPLETE' AND blank AND coalesce(error, '') = '' THEN 'result' WHEN type = 'OCR_COMPLETE' AND length(text) > 200000 THEN 'text-size'
  WHEN type = 'OCR_COMPLETE' AND coalesce(length(error), 0) > 2000 THEN 'error-size' WHEN type = 'PLAYBACK_ERROR' AND coalesce(length(error), 9999) > 2000 THEN 'error-size' END
ELSE CASE WHEN type NOT IN {_in(V.REQUESTS)} THEN 'type' WHEN type IN {_in(V.FROM_TAB)} AND sender_tab IS NULL THEN 'sender-tab' WHEN type IN {_in(V.FROM_OPTIONS)} AND coalesce(page, '') <> 'options' THEN 'page'
  WHEN type IN {_in(V.FROM_READER)} AND sender_tab IS NULL AND coalesce(page, '') <> 'capture' THEN 'page' WHEN type = 'GENERATE_VOICE' AND blank THEN 'no-text' WHEN type = 'GENERATE_VOICE' AND length(text) > 200000 THEN 'text-size'
  WHEN type = 'GET_SPEAKER_ICON' AND NOT (speaker_id BETWEEN 0 AND 1000000) THEN 'speaker' WHEN type = 'CAPTURE_OCR_REGION' AND frame_id <> 0 THEN 'frame' WHEN type = 'CAPTURE_OCR_REGION' AND bad THEN 'rect' END END AS reason FROM b
"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = {"speakerId": F.when(F.col("p_size") % 7 == 0, "x").otherwise((F.col("p_partkey") - 20).cast("string")), "speedScale": F.col("p_size") / 10.0, "pitchScale": F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 100.0 - 0.25), "intonationScale": F.col("p_size") / 20.0, "volumeScale": F.when(F.col("p_size") % 3 == 0, "loud").otherwise("1.5"), "pauseLengthScale": F.lit(None).cast("double")}
    return p.select("p_partkey", V.sanitized(raw).alias("s")).select("p_partkey", "s.*")


SETTINGS_SQL = """
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 AND p_partkey - 20 BETWEEN 0 AND 1000000 THEN CAST(p_partkey - 20 AS INT) ELSE 1 END AS "speakerId", greatest(0.5::DOUBLE, least(2.0::DOUBLE, p_size / 10)) AS "speedScale",
  CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE ELSE greatest(-0.15::DOUBLE, least(0.15::DOUBLE, p_size / 100 - 0.25::DOUBLE)) END AS "pitchScale", greatest(0.0::DOUBLE, least(2.0::DOUBLE, p_size / 20)) AS "intonationScale",
  CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS "volumeScale", 1.0::DOUBLE AS "pauseLengthScale" FROM part
"""


def payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads, data URLs, audio headers, byte limits, versions, selections and queued texts from orders."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).withColumn("k", F.col("o_orderkey"))
    url = F.concat(F.lit("data:image/"), F.when(F.col("k") % 3 == 0, "png").when(F.col("k") % 3 == 1, "svg").otherwise("JPEG"), F.lit(";base64,AAAA"))
    content = F.concat(F.when(F.col("k") % 2 == 0, "RIFF").otherwise("OggS"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), F.when(F.col("k") % 5 == 0, "AVI ").otherwise("WAVE"), F.repeat(F.lit("x"), (F.col("k") % 60).cast("int"))).cast("binary")
    version = lambda c: F.concat_ws(".", F.lit("1"), (c % 12).cast("string"), (c % 4).cast("string"))
    texts = F.array(F.col("o_orderstatus"), F.lit(" "), F.repeat(F.lit("y"), (F.col("o_custkey") % 40 * 6000).cast("int")))
    queued = V.queue_texts(texts)
    return o.select(
        "o_orderkey", V.image_url_ok(url).alias("url_ok"), V.upload_ok(F.lit("image/png"), F.col("o_custkey") * 3000, F.col("o_custkey") * 30, F.col("k") % 9000).alias("upload_ok"), V.is_wav(content).alias("wav"),
        V.within_bytes(content, F.when(F.col("k") % 4 == 0, F.col("k") % 200), 50).alias("within"), V.version_before(version(F.col("k")), version(F.col("o_custkey"))).alias("before"),
        V.selected_text(F.when(F.col("k") % 9 == 0, "password").otherwise("text"), F.col("o_orderpriority"), F.lit(1), F.lit(4)).alias("selected"), F.coalesce(F.size(queued), F.lit(-1)).cast("long").alias("n_queued"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("listed"),
    )


PAYLOAD_SQL = """
WITH o AS (SELECT *, o_orderkey AS k, 12 + o_orderkey % 60 AS size FROM orders)
SELECT o_orderkey, k % 3 <> 1 AS url_ok, o_custkey * 3000 <= 2097152 AND o_custkey * 30 <= 16384 AND o_custkey * 30 * (k % 9000) <= 41943040 AS upload_ok, k % 2 = 0 AND k % 5 <> 0 AS wav,
  size <= 50 AND NOT (k % 4 = 0 AND k % 200 > 50) AS within, (k % 12, k % 4) < (o_custkey % 12, o_custkey % 4) AS before, CASE WHEN k % 9 = 0 THEN '' ELSE trim(substr(o_orderpriority, 2, 3)) END AS selected,
  CASE WHEN 1 + o_custkey % 40 * 6000 <= 200000 THEN CASE WHEN o_custkey % 40 = 0 THEN 1 ELSE 2 END ELSE -1 END AS n_queued, o_orderpriority IN ('1-URGENT', '2-HIGH') AS listed FROM o
"""

_SPEAKER = """'[{"name":" ' || c_name || ' ","speaker_uuid":"u' || c_custkey || '","styles":[{"id":' || c_nationkey || ',"name":"' || c_mktsegment || '"},{"id":-1,"name":"bad"},{"id":' || (c_nationkey + 100) || ',"name":"soft"}]},{"name":"  ","styles":[{"id":1,"name":"a"}]},{"name":"bare","styles":[]}]'"""


def speaker_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("raw", F.expr(_SPEAKER)).withColumn("listed", V.speakers(F.col("raw")))
    options = V.style_options(c, ["c_custkey", "c_nationkey", "listed"], "listed")
    return options.select("c_custkey", "style_id", "label", V.speaker_of_style(F.col("listed"), F.col("c_nationkey")).alias("speaker"))


SPEAKER_SQL = """
SELECT c_custkey, c_nationkey AS style_id, c_name || ' (' || c_mktsegment || ')' AS label, c_name AS speaker FROM customer
UNION ALL SELECT c_custkey, c_nationkey + 100, c_name || ' (soft)', c_name FROM customer
"""


def image_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived image padded and greyed, binarized, and squared: sizes, and sums of the bytes of the first two."""
    images = K.pack(pixels(spark, sf_dir), ["image"], WIDTH, HEIGHT)
    out = K.byte_sums(K.apply(images, ["image"], lambda a: K.gray(K.pad(a, 4))), ["image"], "gray_sum").withColumnRenamed("w", "padded_w")
    ink = K.byte_sums(K.apply(images, ["image"], K.binarize), ["image"], "binary_sum").withColumnRenamed("w", "binary_w")
    icon = K.apply(images, ["image"], K.square_icon).select("image", F.col("w").alias("icon_w"))
    return out.join(ink, "image").join(icon, "image")


_MIX = "round_even(((1 - fx) * {0}00 + fx * {0}01) * (1 - fy) + ((1 - fx) * {0}10 + fx * {0}11) * fy, 0)"
_LUM = "0.299::DOUBLE * {0} + 0.587::DOUBLE * {1} + 0.114::DOUBLE * {2}"
KERNELS_SQL = f"""
WITH p AS ({PIXELS}), i AS (SELECT DISTINCT image FROM p), g AS (SELECT image, x, y, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b
  FROM (SELECT * FROM i, (SELECT unnest(range(0, {WIDTH})) AS x), (SELECT unnest(range(0, {HEIGHT})) AS y)) LEFT JOIN p USING (image, x, y)),
e AS (SELECT image, CASE WHEN x IN (0, {WIDTH - 1}) THEN 1 ELSE 0 END + CASE WHEN y IN (0, {HEIGHT - 1}) THEN 1 ELSE 0 END AS n, r, g, b FROM g),
m AS (SELECT image, floor(sum(r * n) / sum(n) + 0.5::DOUBLE) AS r, floor(sum(g * n) / sum(n) + 0.5::DOUBLE) AS g, floor(sum(b * n) / sum(n) + 0.5::DOUBLE) AS b FROM e WHERE n > 0 GROUP BY image),
k AS (SELECT g.image, sum(round_even({_LUM.format("g.r", "g.g", "g.b")}, 0)) AS inner_sum, sum(g.r + g.g + g.b) AS plain_sum FROM g GROUP BY g.image),
c AS (SELECT image, bx, b_y, greatest(least((bx + 0.5::DOUBLE) / 2 - 0.5, {WIDTH - 1}), 0) AS xs, greatest(least((b_y + 0.5::DOUBLE) / 2 - 0.5, {HEIGHT - 1}), 0) AS ys
  FROM i, (SELECT unnest(range(0, {WIDTH * 2})) AS bx), (SELECT unnest(range(0, {HEIGHT * 2})) AS b_y)),
d AS (SELECT *, CAST(floor(xs) AS INT) AS x0, CAST(floor(ys) AS INT) AS y0, CAST(least(floor(xs) + 1, {WIDTH - 1}) AS INT) AS x1, CAST(least(floor(ys) + 1, {HEIGHT - 1}) AS INT) AS y1, xs - floor(xs) AS fx, ys - floor(ys) AS fy FROM c),
q AS (SELECT d.*, a.r AS r00, a.g AS g00, a.b AS b00, b.r AS r01, b.g AS g01, b.b AS b01, u.r AS r10, u.g AS g10, u.b AS b10, v.r AS r11, v.g AS g11, v.b AS b11 FROM d
  JOIN g a ON a.image = d.image AND a.x = d.x0 AND a.y = d.y0 JOIN g b ON b.image = d.image AND b.x = d.x1 AND b.y = d.y0 JOIN g u ON u.image = d.image AND u.x = d.x0 AND u.y = d.y1 JOIN g v ON v.image = d.image AND v.x = d.x1 AND v.y = d.y1),
l AS (SELECT image, CAST(floor({_LUM.format(_MIX.format("r"), _MIX.format("g"), _MIX.format("b"))}) AS INT) AS lum FROM q),
h AS (SELECT image, lum AS bin, count(*) AS c FROM l GROUP BY ALL),
w AS (SELECT image, bin, sum(c) OVER (PARTITION BY image) AS n, sum(bin * c) OVER (PARTITION BY image) AS total, sum(c) OVER z AS wb, sum(bin * c) OVER z AS sb FROM h WINDOW z AS (PARTITION BY image ORDER BY bin ROWS UNBOUNDED PRECEDING)),
o AS (SELECT image, bin, CASE WHEN n > wb THEN wb::DOUBLE * (n - wb)::DOUBLE * power(sb::DOUBLE / wb::DOUBLE - (total - sb)::DOUBLE / (n - wb)::DOUBLE, 2) ELSE 0 END AS between_ FROM w),
t AS (SELECT image, CASE WHEN between_ > 0 THEN bin ELSE 127 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY between_ DESC, bin) AS i FROM o) WHERE i = 1),
f AS (SELECT image, count(*) AS n, count(*) FILTER (lum < threshold) AS dark FROM l JOIN t USING (image) GROUP BY image),
s AS (SELECT *, CASE WHEN 2 * dark <= n THEN dark ELSE n - dark END AS ink FROM f)
SELECT image, {WIDTH + 8} AS padded_w, CAST(3 * (inner_sum + {(WIDTH + 8) * (HEIGHT + 8) - WIDTH * HEIGHT} * round_even({_LUM.format("m.r", "m.g", "m.b")}, 0)) AS BIGINT) AS gray_sum,
  CASE WHEN ink / n BETWEEN 0.002::DOUBLE AND 0.4::DOUBLE THEN {WIDTH * 2} ELSE {WIDTH} END AS binary_w, CAST(CASE WHEN ink / n BETWEEN 0.002::DOUBLE AND 0.4::DOUBLE THEN 765 * (n - ink) ELSE plain_sum END AS BIGINT) AS binary_sum, 64 AS icon_w
FROM k JOIN m USING (image) JOIN s USING (image)
"""


def reencoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived image as PNG whose data URL fits into 3000 characters, scaled down where it must be."""
    made = K.reencoded(K.pack(pixels(spark, sf_dir), ["image"], WIDTH, HEIGHT), ["image"], 3000)
    return made.select("image", "w", "h", F.char_length(T.data_url(F.col("data"), F.lit("image/png"))).alias("chars"), (F.substring("data", 2, 3).cast("string") == "PNG").alias("png"))


# requests to recognize, in SQL that both engines read alike
REQUEST = """o_orderkey, concat('data:image/', CASE o_orderkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'gif' ELSE 'jpeg' END, ';base64,', repeat('A', CAST(CASE WHEN o_orderkey % 5000 = 0 THEN 12582890 + o_custkey % 2 ELSE 4 END AS INT))) AS data_url,
  CAST(o_custkey % 50 - 2 AS DOUBLE) AS x, CAST(o_custkey % 40 AS DOUBLE) AS y, CAST(o_custkey % 30 AS DOUBLE) AS width, CAST(o_orderkey * 7 AS DOUBLE) AS height, CAST(o_custkey * 90 AS DOUBLE) AS viewport,
  CAST(o_orderkey % 9 - 1 AS DOUBLE) / CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS tab_id, CASE o_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN '"true"' END AS remove_ruby,
  CASE WHEN o_orderkey % 6 = 0 THEN 'large' ELSE CAST(o_custkey % 90 AS VARCHAR(9)) END AS icon"""


def queued_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to recognize and icon sizes from orders: what may be queued of them."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("lectern_orders")
    m = spark.sql(f"SELECT {REQUEST} FROM lectern_orders")
    made = V.recognition_request({c: F.col(c) for c in m.columns})
    return m.withColumn("q", made).select("o_orderkey", F.col("q").isNotNull().alias("accepted"), F.char_length("q.data_url").alias("chars"), F.col("q.rect.width").alias("width"), F.col("q.tab_id").alias("tab_id"), F.col("q.remove_ruby").alias("remove_ruby"), V.icon_size(F.col("icon")).alias("icon"))


REQUESTS_SQL = f"""
WITH m AS (SELECT {REQUEST} FROM orders), a AS (SELECT *, o_orderkey % 4 <> 2 AND length(data_url) <= 12582912 AND x >= 0 AND width >= 1 AND height >= 1 AND height <= 100000 AND width * height <= 100000000
  AND viewport >= 1 AND viewport <= 100000 AND tab_id >= 0 AND tab_id = floor(tab_id) AS ok FROM m)
SELECT o_orderkey, ok AS accepted, CASE WHEN ok THEN length(data_url) END AS chars, CASE WHEN ok THEN width END AS width, CASE WHEN ok THEN CAST(tab_id AS BIGINT) END AS tab_id, CASE WHEN ok THEN coalesce(remove_ruby = 'true', false) END AS remove_ruby,
  greatest(16.0::DOUBLE, least(64.0::DOUBLE, coalesce(TRY_CAST(icon AS DOUBLE), 16.0::DOUBLE))) AS icon FROM a
"""


def image_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("image", F.col("lum").alias("bin")).count().withColumnRenamed("count", "n")


HISTOGRAM_SQL = f"SELECT image, {LUM} AS bin, count(*) AS n FROM ({PIXELS}) z GROUP BY ALL"


def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon from lines of text: distinct words, blanks dropped, kept apart from part names by an anti join."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"[ \n]", -1)).alias("word")).where("trim(word) <> ''").distinct()
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ", -1)).alias("word"))
    return words.join(names, "word", "left_anti").select("word", F.char_length("word").cast("long").alias("n"))


LEXICON_SQL = """
SELECT DISTINCT word, length(word) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM conversations) WHERE trim(word) <> '' AND word NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part)
"""

QUERIES = {
    "message_checks": (message_checks, MESSAGE_SQL),
    "settings": (settings, SETTINGS_SQL),
    "payload_checks": (payload_checks, PAYLOAD_SQL),
    "speaker_options": (speaker_options, SPEAKER_SQL),
    "image_kernels": (image_kernels, KERNELS_SQL),
    "reencoded_images": (reencoded_images, None),
    "queued_requests": (queued_requests, REQUESTS_SQL),
    "image_histograms": (image_histograms, HISTOGRAM_SQL),
    "lexicon_words": (lexicon_words, LEXICON_SQL),
}
