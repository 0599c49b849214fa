"""Text functions as Column expressions; all stay inside the JVM.

White space follows the Unicode class that script engines use, which is wider than Java's \\s.
Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns, in Java syntax.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
URL = r"https?://[\w/:%#$&?()~.=+\-]+"
URL_SPOKEN = "URL省略"
SENTENCE = r"[^。！？\n]+[。！？\n]?"
CJK_BETWEEN = r"[\u3000-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F]"
CJK_ADJACENT = r"[\u3001-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF01-\uFF9F]"
BULLET = (
    r"^(?:[-・･*+●○◦■□▪▶▷›»→◆◇☆★#]|"
    r"[(（【\[]?" + SPACE + r"*(?:[0-9]{1,3}|[０-９]{1,3}|[一二三四五六七八九十]{1,3})" + SPACE + r"*[.)）】\].、:：])"
)
ENDS_SENTENCE = r"[。．！？!?…]\z"
ENDS_PUNCTUATION = r"[、，。．！？!?｡､：:；;]\z"
ENDS_HIRAGANA = r"[ぁ-ゖ]\z"
DASH_RUN = r"[ー―—–−|｜lI1/\\]"
LABEL_CLEAR = (
    r"^(?:[\u2460-\u2473\u3251-\u325F]"
    r"|[(（\[［{｛【]" + SPACE + r"*[0-9０-９A-Za-z\u30A1-\u30F6一二三四五六七八九十]{1,3}" + SPACE + r"*[)）\]］}｝】]"
    r"|[0-9０-９一二三四五六七八九十]{1,3}" + SPACE + r"*[.．、,，)）:：])\z"
)
LABEL_BARE = r"^(?:[\u30A1-\u30F6]|[A-Za-z\uFF21-\uFF3A\uFF41-\uFF5A])\z"
KANJI = r"[\u3400-\u4DBF\u4E00-\u9FFF]"
KANA_ONLY = r"^[ぁ-ゖァ-ヺーゝゞヽヾ]+\z"
MAX_CHUNK = 5000


def trim(text: Column) -> Column:
    """text without leading and trailing white space."""
    return F.trim(text, F.lit(SPACES))


def without_space(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def without_urls(text: Column) -> Column:
    """text with URLs as one spoken word; empty for null."""
    return once(F.coalesce(text, F.lit("")), lambda t: F.when(F.contains(t, F.lit("://")), F.regexp_replace(t, URL, URL_SPOKEN)).otherwise(t))


def char_count(text: Column) -> Column:
    """Characters that aren't white space; 0 of null."""
    return F.char_length(F.coalesce(without_space(text), F.lit("")))


def clean_message(text: Column, keep_paragraphs: bool = False) -> Column:
    """URLs become one spoken word; line ends become blanks, or single line ends if paragraphs stay."""
    spoken = without_urls(text)
    if keep_paragraphs:
        return trim(_line_ends(spoken))
    return trim(F.regexp_replace(spoken, r"\n+", " "))


def _line_ends(text: Column) -> Column:
    """Runs of line ends, and the blanks around and between them, as one line end."""
    return F.regexp_replace(text, r"[ \t]*+\n[ \t\n]*+", "\n")


def split_text(text: Column, most: int = MAX_CHUNK) -> Column:
    """Sentences as an array, each of at most `most` characters; empty for a null or empty text.

    A sentence keeps one terminator; further ones right behind it are dropped. A text of
    terminators or white space alone is one chunk as it stands.
    """


    def cut(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / most)), lambda i: F.substring(s, (i * most + 1).cast("int"), F.lit(most)))
        return F.when(F.char_length(s) <= most, F.array(s)).otherwise(parts)

    def chunks(t: Column) -> Column:
        sentences = lambda m: F.filter(F.transform(F.when(F.size(m) > 0, m).otherwise(F.array(t)), trim), lambda s: s != "")
        whole = lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.substring(t, 1, most)))
        found = once(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), sentences)
        return F.when(t == "", F.array().cast("array<string>")).otherwise(once(F.flatten(F.transform(found, cut)), whole))

    return once(F.coalesce(text, F.lit("")), chunks)


def normalize_recognized(text: Column) -> Column:
    """One line of recognized lines: pauses where a paragraph ends, blanks or nothing where a line wraps.

    What stands between two lines depends on these lines and on blank lines between them alone,
    so each separator is computed from its neighbours without a fold.
    """
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\u3000]+", " ")
    squeezed = F.regexp_replace(squeezed, f"(?<={CJK_ADJACENT}) +| +(?={CJK_ADJACENT})", "")
    lines = F.transform(F.split(squeezed, "\n", -1), lambda s, i: F.struct(trim(s).alias("line"), i.alias("i")))
    kept = F.filter(lines, lambda s: s["line"] != "")

    def joined(kept: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.get(kept, i - 1)
            prev, line = before["line"], s["line"]
            heading = (F.char_length(prev) <= 8) & ~prev.rlike(ENDS_PUNCTUATION) & ~prev.rlike(ENDS_HIRAGANA) & (F.char_length(line) > F.char_length(prev))
            boundary = (s["i"] - before["i"] > 1) | line.rlike(BULLET) | prev.rlike(BULLET) | prev.rlike(ENDS_SENTENCE) | heading
            pause = F.when(prev.rlike(ENDS_PUNCTUATION), F.lit("")).otherwise(F.lit("、"))
            wrap = F.when(prev.rlike(CJK_ADJACENT + r"\z") | line.rlike("^" + CJK_ADJACENT), F.lit("")).otherwise(F.lit(" "))
            return F.when(i == 0, line).otherwise(F.concat(F.when(boundary, pause).otherwise(wrap), line))

        return F.array_join(F.transform(kept, piece), "")

    # the filtered lines are bound once, else every lookup of the line before would filter again
    return trim(once(kept, joined))


def clean_for_speech(text: Column) -> Column:
    """As clean_message, and broken runs of dashes, bars and look-alikes become one long-vowel mark.

    A run counts as broken if it holds a dash, or a long-vowel mark together with a bar. Whether a
    run holds them is asked at its start, so no callback is needed.
    """
    spoken = without_urls(text)
    run = rf"(?=(?:{DASH_RUN}*[―—–])|(?:(?={DASH_RUN}*ー){DASH_RUN}*[|｜/\\])){DASH_RUN}{{2,}}"
    return trim(F.regexp_replace(F.regexp_replace(spoken, run, "ー"), r"\n+", " "))


def is_label(text: Column) -> Column:
    """clear: a mark that can't be part of a word; bare: one letter that may be; else null."""
    return F.when(trim(text).rlike(LABEL_CLEAR), "clear").when(trim(text).rlike(LABEL_BARE), "bare")


def has_kanji(text: Column) -> Column:
    return text.rlike(KANJI)


def is_kana(text: Column) -> Column:
    return text.rlike(KANA_ONLY)


def alt_text(tag: Column, role: Column, aria_label: Column, alt: Column) -> Column:
    """Spoken text of an element: for images the label or the alternative text unless it is decoration."""
    label = F.when(trim(F.coalesce(aria_label, F.lit(""))) != "", aria_label)
    image = F.when(role.isin("presentation", "none"), F.lit("")).otherwise(F.coalesce(label, alt, F.lit("")))
    return trim(F.when(F.upper(tag) == "IMG", image).otherwise(F.coalesce(label, F.lit(""))))


def strip_style_suffix(name: Column) -> Column:
    """A name without its trailing (style), at most 100 characters."""
    return F.substring(F.regexp_replace(name, SPACE + r"*\([^)]*\)\z", ""), 1, 100)


def join_units(units: Column, joined_between: str = CJK_BETWEEN) -> Column:
    """Text units array<struct<text, block, kind, left, top, right, bottom>> in order, as one text.

    Blank units vanish; a unit that repeats the one before (4 characters or more) is read once; a
    change of block ends the line; a label at the start of a block is followed by a line end if
    the next unit goes on in that block; blanks between two CJK characters go.
    """
    flat = F.transform(units, lambda u, i: F.struct(F.regexp_replace(u["text"], SPACE + "+", " ").alias("text"), u["block"].alias("block"), i.alias("i"), u.alias("u")))
    full = F.filter(flat, lambda u: trim(u["text"]) != "")

    def dropped(full: Column) -> Column:
        key = lambda u: without_space(u["text"])
        same = lambda u, i: (i > 0) & (F.char_length(key(u)) >= 4) & (key(u) == key(F.get(full, i - 1)))
        return F.filter(full, lambda u, i: ~F.coalesce(same(u, i), F.lit(False)))

    def spoken(kept: Column) -> Column:
        def piece(u: Column, i: Column) -> Column:
            before = F.get(kept, i - 1)
            # a unit without a block breaks like any change of block, unless text without one follows another
            starts = (i == 0) | ~u["block"].eqNullSafe(before["block"]) | (u["block"].isNull() & u["u"]["kind"].isin("alt", "label"))
            raw = F.get(units, u["i"] + 1)
            follows = raw.isNotNull() & (trim(raw["text"]) != "") & raw["block"].eqNullSafe(u["block"])
            a, b = u["u"], raw
            apart = (b["top"] >= a["bottom"] - 1) | (b["left"] - a["right"] >= 3)
            kind = is_label(u["text"])
            pause = starts & follows & F.coalesce((kind == "clear") | ((kind == "bare") & apart), F.lit(False))
            return F.concat(F.when((i > 0) & starts, "\n").otherwise(""), u["text"], F.when(F.coalesce(pause, F.lit(False)), "\n").otherwise(""))

        return F.array_join(F.transform(kept, piece), "")

    text = once(once(full, dropped), spoken)
    text = F.regexp_replace(text, f"({joined_between}) +(?={joined_between})", "$1")
    return trim(_line_ends(text))


def without_repeats(lines: Column, least: int = 4) -> Column:
    """Lines as array<struct<seq, line>> that have text and don't repeat the line before, as drop_adjacent_duplicates."""
    keyed = F.transform(lines, lambda s, i: F.struct(i.alias("seq"), s.alias("line"), without_space(s).alias("key")))

    def fresh(full: Column) -> Column:
        return F.filter(full, lambda s, i: (F.char_length(s["key"]) < least) | (i == 0) | (s["key"] != F.get(full, i - 1)["key"]))

    return F.transform(once(F.filter(keyed, lambda s: s["key"] != ""), fresh), lambda s: F.struct(s["seq"].alias("seq"), s["line"].alias("line")))


def playback_error(message: Column) -> Column:
    """What is said when playback fails: a plain hint if the engine can't be reached, else the message behind a remark."""
    reason = F.coalesce(F.nullif(message, F.lit("")), F.lit("unknown error"))
    return F.when(F.coalesce(message, F.lit("")).rlike("(?i)failed to fetch|networkerror|err_connection"), "offline").otherwise(F.concat(F.lit("playback failed: "), reason))


def capture_error(message: Column) -> Column:
    """What is said when a capture fails: a plain hint if captures follow too fast, else the message."""
    return F.when(message.rlike("(?i)MAX_CAPTURE_VISIBLE_TAB_CALLS_PER_SECOND"), "too many requests").otherwise(message)


def data_url(content: Column, kind: Column) -> Column:
    """Bytes as a data URL of a type."""
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def data_of_url(url: Column) -> Column:
    """The bytes of a base64 data URL; null for any other text."""
    body = F.regexp_extract(url, r"(?s)^data:[^,]*;base64,([A-Za-z0-9+/]*={0,2})\z", 1)
    return F.when(url.rlike(r"(?s)^data:[^,]*;base64,[A-Za-z0-9+/]*={0,2}\z") & (F.char_length(body) % 4 == 0), F.unbase64(body))
