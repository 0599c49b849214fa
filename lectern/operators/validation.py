"""Message, settings and payload checks as column expressions: each gives the first reason to reject, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

MAX_TEXT, MAX_TEXTS, MAX_DATA_URL, MAX_PICTURE = 200_000, 5000, 64 << 20, 12 << 20
# Message types by who may send them, and settings with default, least and most.
NOTICES = ["OCR_PROGRESS", "OCR_COMPLETE", "PLAYBACK_STARTED", "PLAYBACK_ENDED", "PLAYBACK_ERROR", "PLAYBACK_STOPPED"]
REQUESTS = ["CLAIM_UPDATE_NOTICE", "SHORTCUT_PRESSED", "OPEN_OPTIONS", "CHECK_CONNECTION", "GET_SPEAKERS", "GET_SPEAKER_ICON", "GENERATE_VOICE", "STOP_ALL", "CAPTURE_OCR_REGION"]
FROM_TAB = ["CLAIM_UPDATE_NOTICE", "SHORTCUT_PRESSED", "CAPTURE_OCR_REGION"]
FROM_OPTIONS = ["GET_SPEAKERS", "GET_SPEAKER_ICON"]
FROM_READER = ["GENERATE_VOICE", "STOP_ALL"]
SETTINGS = {"speedScale": (1.0, 0.5, 2.0), "pitchScale": (0.0, -0.15, 0.15), "intonationScale": (1.0, 0.0, 2.0), "volumeScale": (1.0, 0.0, 2.0), "pauseLengthScale": (1.0, 0.0, 2.0)}


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def bad_rect(x: Column, y: Column, width: Column, height: Column, viewport: Column) -> Column:
    """Whether a selection is out of bounds or not finite."""
    finite = is_finite(x) & is_finite(y) & is_finite(width) & is_finite(height) & is_finite(viewport)
    inside = (x >= 0) & (y >= 0) & (width >= 1) & (height >= 1) & (width <= 100_000) & (height <= 100_000) & (width * height <= 100_000_000)
    return ~(finite & F.coalesce(inside & (viewport >= 1) & (viewport <= 100_000), F.lit(False)))


def request_reason(m: dict[str, Column]) -> Column:
    """Why a message to the background is rejected; null if it may pass.

    m: type, internal, target, from_offscreen, tab_id, sender_tab, page, progress, text, error,
    speaker_id, frame_id, bad_rect, data_url_chars.
    """
    kind, blank = m["type"], F.trim(F.coalesce(m["text"], F.lit(""))) == ""
    bad_tab = F.coalesce(m["tab_id"] < 0, F.lit(False))
    # null fails a membership test here as any unknown value does
    among = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    to_background = F.coalesce(m["target"] == "background", F.lit(False))
    notice = (
        F.when(~m["from_offscreen"], "sender")
        .when(~among(kind, NOTICES), "type")
        .when(bad_tab, "tab")
        .when((kind == "OCR_PROGRESS") & ~F.coalesce((m["progress"] >= 0) & (m["progress"] <= 1), F.lit(False)), "progress")
        .when(among(kind, NOTICES[:2]) & m["tab_id"].isNull(), "tab")
        .when((kind == "OCR_COMPLETE") & blank & F.coalesce(m["error"] == "", F.lit(True)), "result")
        .when((kind == "OCR_COMPLETE") & F.coalesce(F.char_length(m["text"]) > MAX_TEXT, F.lit(False)), "text-size")
        .when((kind == "OCR_COMPLETE") & F.coalesce(F.char_length(m["error"]) > 2000, F.lit(False)), "error-size")
        .when((kind == "PLAYBACK_ERROR") & F.coalesce(F.char_length(m["error"]) > 2000, F.lit(True)), "error-size")
    )
    request = (
        F.when(~among(kind, REQUESTS), "type")
        .when(among(kind, FROM_TAB) & m["sender_tab"].isNull(), "sender-tab")
        .when(among(kind, FROM_OPTIONS) & ~among(m["page"], ["options"]), "page")
        .when(among(kind, FROM_READER) & m["sender_tab"].isNull() & ~among(m["page"], ["capture"]), "page")
        .when((kind == "GENERATE_VOICE") & blank, "no-text")
        .when((kind == "GENERATE_VOICE") & (F.char_length(m["text"]) > MAX_TEXT), "text-size")
        .when((kind == "GET_SPEAKER_ICON") & ~F.coalesce((m["speaker_id"] >= 0) & (m["speaker_id"] <= 1_000_000), F.lit(False)), "speaker")
        .when((kind == "CAPTURE_OCR_REGION") & F.coalesce(m["frame_id"] != 0, F.lit(False)), "frame")
        .when((kind == "CAPTURE_OCR_REGION") & m["bad_rect"], "rect")
        .when(F.coalesce(m["data_url_chars"] > MAX_DATA_URL, F.lit(False)), "data-size")
    )
    return F.when(kind.isNull(), "message").when(~m["internal"], "sender").when(to_background, notice).otherwise(request)


def _chars(text: Column) -> Column:
    """Characters of a text; of plain ASCII they are its bytes, which is seen much faster than they are counted."""
    size = F.octet_length(text)
    return F.when(F.octet_length(F.decode(text.cast("binary"), "ISO-8859-1")) == size, size).otherwise(F.char_length(text))


def queue_texts(texts: Column) -> Column:
    """The texts that may be queued: blank ones are dropped; null if there are none or too many.

    A character has one to four bytes, so characters are counted only where the bytes leave it open.
    """

    def fit(kept: Column) -> Column:
        total = lambda size: F.aggregate(kept, F.lit(0).cast("long"), lambda a, t: a + size(t))
        few = once(total(F.octet_length), lambda n: (n <= MAX_TEXT) | ((n <= 4 * MAX_TEXT) & (total(_chars) <= MAX_TEXT)))
        return F.when((F.size(texts) >= 1) & (F.size(texts) <= MAX_TEXTS) & (F.size(kept) > 0) & few, kept)

    return once(F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != "")), fit)


def recognition_request(m: dict[str, Column]) -> Column:
    """A request to recognize a picture as it may be queued, reduced to what is known of it; null if it is rejected.

    m: data_url, x, y, width, height, viewport, tab_id, remove_ruby (a JSON value). The picture must be
    PNG or JPEG of at most MAX_PICTURE characters, and readings are removed for a plain true alone.
    """
    picture = image_url_ok(m["data_url"], "png|jpeg", MAX_PICTURE)
    tab = F.coalesce((m["tab_id"] >= 0) & (m["tab_id"] == F.floor(m["tab_id"])), F.lit(False))
    fits = picture & ~bad_rect(m["x"], m["y"], m["width"], m["height"], m["viewport"]) & tab
    rect = F.struct(*[m[c].alias(c) for c in ("x", "y", "width", "height")])
    remove = F.coalesce(m["remove_ruby"] == "true", F.lit(False))
    return F.when(fits, F.struct(m["data_url"].alias("data_url"), rect.alias("rect"), m["viewport"].alias("viewport"), m["tab_id"].cast("long").alias("tab_id"), remove.alias("remove_ruby")))


def icon_size(value: Column) -> Column:
    """The side of an icon, 16 to 64; 16 of what isn't a number."""
    number = value.try_cast("double")
    return F.when(is_finite(number), F.greatest(F.lit(16.0), F.least(F.lit(64.0), number))).otherwise(F.lit(16.0))


def lexicon(lines: DataFrame, line: str, most: int = 2 << 20) -> DataFrame:
    """word: the distinct words of a list of lines, blanks dropped; none if the list has more than `most` bytes, so that what asks for words passes through."""
    size = lines.agg(F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("__size"))
    words = lines.select(F.trim(line).alias("word")).where("word <> ''").distinct()
    return words.join(F.broadcast(size), F.col("__size") <= most).drop("__size")


def sanitized(values: dict[str, Column]) -> Column:
    """Settings as a struct: numbers held in range, defaults for what isn't a number."""
    speaker = values["speakerId"].try_cast("double")
    whole = is_finite(speaker) & (speaker == F.floor(speaker)) & (speaker >= 0) & (speaker <= 1_000_000)
    fields = [F.when(whole, speaker.cast("int")).otherwise(1).alias("speakerId")]
    for name, (default, low, high) in SETTINGS.items():
        v = values[name].try_cast("double")
        fields.append(F.when(is_finite(v), F.greatest(F.lit(low), F.least(F.lit(high), v))).otherwise(default).alias(name))
    return F.struct(*fields)


def image_url_ok(url: Column, kinds: str = "png|jpeg|webp|gif", most: int = 2 << 20) -> Column:
    return F.coalesce((F.char_length(url) <= most) & url.rlike(f"^(?i)data:image/(?:{kinds});base64,"), F.lit(False))


def upload_ok(kind: Column, size: Column, width: Column, height: Column) -> Column:
    return kind.isin("image/png", "image/jpeg", "image/webp", "image/gif") & (size <= 2 << 20) & (width <= 16_384) & (height <= 16_384) & (width * height <= 40 * 1024 * 1024)


def version_before(a: Column, b: Column) -> Column:
    """Whether a dotted version is lower than another; missing parts and what isn't a number are 0."""
    part = lambda p: F.coalesce(F.regexp_extract(p, r"^\s*(-?\d+)", 1).try_cast("int"), F.lit(0))
    parts = lambda v: F.transform(F.split(F.coalesce(v, F.lit("")), r"\.", -1), part)
    filled = lambda x, y: F.concat(x, F.array_repeat(F.lit(0), F.size(y) - F.size(x)))
    return once(F.struct(parts(a).alias("a"), parts(b).alias("b")), lambda p: filled(p["a"], p["b"]) < filled(p["b"], p["a"]))


def is_wav(content: Column) -> Column:
    """Whether bytes begin like a WAV file."""
    text = lambda at: F.substring(content, at, 4)
    lit = lambda s: F.lit(s).cast("binary")
    return F.coalesce((F.octet_length(content) >= 12) & (text(1) == lit("RIFF")) & (text(9) == lit("WAVE")), F.lit(False))


def within_bytes(content: Column, declared: Column, most: int) -> Column:
    return F.coalesce((F.octet_length(content) <= most) & ~F.coalesce(declared > most, F.lit(False)), F.lit(False))


def selected_text(kind: Column, value: Column, start: Column, end: Column) -> Column:
    """The selected part of an input; nothing of a password."""
    part = F.trim(F.substring(value, start + 1, end - start))
    return F.when(F.lower(kind) == "password", "").otherwise(F.coalesce(part, F.lit("")))


SPEAKERS = "array<struct<name:string,speaker_uuid:string,styles:array<struct<id:double,name:string>>>>"


def speakers(raw: Column) -> Column:
    """Speakers of a JSON list: named ones with valid styles, names cut to 100 characters; null if none."""
    cut = lambda s, n: F.substring(F.trim(F.coalesce(s, F.lit(""))), 1, n)
    valid = lambda s: F.coalesce((s["id"] == F.floor(s["id"])) & (s["id"] >= 0) & (s["id"] <= 1_000_000), F.lit(False))
    styles = lambda sp: F.transform(F.filter(F.slice(F.coalesce(sp["styles"], F.array()), 1, 1000), valid), lambda s: F.struct(s["id"].cast("int").alias("id"), cut(s["name"], 100).alias("name")))
    listed = F.transform(F.slice(F.from_json(raw, SPEAKERS), 1, 1000), lambda sp: F.struct(cut(sp["name"], 100).alias("name"), F.substring(F.coalesce(sp["speaker_uuid"], F.lit("")), 1, 200).alias("speaker_uuid"), styles(sp).alias("styles")))
    kept = F.filter(listed, lambda sp: (sp["name"] != "") & (F.size(sp["styles"]) > 0))
    return F.when(F.size(kept) > 0, kept)


def style_options(rows: DataFrame, keys: list[str], listed: str) -> DataFrame:
    """One option for each speaker and style: its id and the label `name (style)`."""
    flat = rows.select(*keys, F.explode(listed).alias("sp")).select(*keys, F.col("sp.name").alias("speaker"), F.explode("sp.styles").alias("st"))
    return flat.select(*keys, F.col("st.id").alias("style_id"), F.concat("speaker", F.lit(" ("), F.col("st.name"), F.lit(")")).alias("label"))


def speaker_of_style(listed: Column, style_id: Column) -> Column:
    """The first speaker that has a style."""
    return F.get(F.filter(listed, lambda sp: F.exists(sp["styles"], lambda s: s["id"] == style_id)), F.lit(0))["name"]
