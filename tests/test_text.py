"""Text functions on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import windows as W


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first().r


SPLITS = [
    ("え！？次。", ["え！", "次。"]),
    ("。。。", ["。。。"]),
    ("A. B.", ["A. B."]),
    ("", []),
    (None, []),
    ("一。\n\n　二", ["一。", "二"]),
]


@pytest.mark.parametrize("given,expected", SPLITS)
def test_split(spark, given, expected):
    assert one(spark, T.split_text(F.col("t")), t=given) == expected


def test_split_long(spark):
    assert list(map(len, one(spark, T.split_text(F.col("t")), t="あ" * 12_000))) == [5000, 5000, 2000]


@pytest.mark.parametrize(
    "function,given,expected",
    [
        (T.clean_message, "見て https://a.b/c?d=1 。", "見て URL省略 。"),
        (lambda c: T.clean_message(c, True), "a \n\n b", "a\nb"),
        (T.clean_message, None, ""),
        (T.normalize_recognized, "確認し ましょう", "確認しましょう"),
        (T.normalize_recognized, "見出し語\nこれは本文の長い行", "見出し語、これは本文の長い行"),
        (T.normalize_recognized, "one two\nthree four five", "one two、three four five"),
        (T.normalize_recognized, None, ""),
        (T.clean_for_speech, "うわー|ー|1||っ", "うわーっ"),
        (T.clean_for_speech, "サーバー1台", "サーバー1台"),
        (T.clean_for_speech, "a || b", "a || b"),
        (T.clean_for_speech, "――待て", "ー待て"),
        (T.strip_style_suffix, "Mika (calm)", "Mika"),
    ],
)
def test_functions(spark, function, given, expected):
    assert one(spark, function(F.col("t")), t=given) == expected


def units(spark, *rows):
    schema = "units array<struct<text:string,block:int,kind:string,left:double,top:double,right:double,bottom:double>>"
    df = spark.createDataFrame([([(*r, *[None] * (7 - len(r))) for r in rows],)], schema)
    return df.select(T.join_units(F.col("units")).alias("t")).first().t


def test_join_units(spark):
    assert units(spark, ("あ い", 1)) == "あい"
    assert units(spark, ("同じ文章です", 1), ("同じ文章です", 2), ("次", 2)) == "同じ文章です\n次"
    assert units(spark, ("a", 1), (" ", 1), ("b", 2)) == "a\nb"
    assert units(spark, ("(ア)", 1), ("本文です", 1)) == "(ア)\n本文です"
    assert units(spark, ("ア", 1, "text", 0.0, 0.0, 10.0, 10.0), ("本文", 1, "text", 20.0, 0.0, 30.0, 10.0)) == "ア\n本文"
    assert units(spark, ("ア", 1, "text", 0.0, 0.0, 10.0, 10.0), ("本文", 1, "text", 10.0, 0.0, 30.0, 10.0)) == "ア本文"
    assert units(spark) == ""


def test_html_units():
    from lectern.sources.html import units_of

    html = "<p>a<script>var t='</p>'</script><b>b</b></p><div><!-- c -->d &amp; e</div><title>t</title>"
    assert units_of(html) == [("a", 1), ("b", 1), ("d & e", 3)]
    assert units_of(None) == [] and units_of("") == []


def test_adjacent_duplicates_and_groups(spark):
    rows = spark.createDataFrame([(1, 0, "same line"), (1, 1, " "), (1, 2, "same  line"), (1, 3, "abc"), (1, 4, "abc"), (2, 0, None)], "d int, seq int, t string")
    assert [r.seq for r in W.drop_adjacent_duplicates(rows, ["d"], "seq", "t").orderBy("seq").collect()] == [0, 3, 4]
    spans = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 2.0, 4.0), (1, 2, 12.0, 13.0), (1, 3, 30.0, 31.0)], "g int, seq int, s double, e double")
    got = W.gap_groups(spans, ["g"], "seq", F.col("s"), F.col("e"), F.lit(5.0)).orderBy("seq").collect()
    assert [r.group_no for r in got] == [1, 1, 1, 2]


def test_references_without_semicolon():
    from lectern.sources.html import units_of

    assert units_of("<p>a &amp;&amp") == [("a &&", 1)] and units_of("<p>a &amp;&amp", bare=False) == [("a &&amp", 1)]
    assert units_of("<p>&copy; &copy &#65; &#x41; &#65 &nosuch; &", bare=False) == [("© &copy A A &#65 &nosuch; &", 1)]
