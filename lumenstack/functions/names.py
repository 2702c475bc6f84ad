"""File names, identifiers, tags and other text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANT_WORDS = "copy cover denoise denoiseai edit edited enhanced final ig image instagram light low nr small thumb thumbnail web".split()
CAMERA_TOKENS = [r"img-\d{4,}", r"dscn?-\d{4,}", r"dji-\d{8,}", r"[a-z]\d{7,}", r"\d[a-z]\d[a-z]\d{4,}"]
CJK = "[一-鿿]"


def _dashes(c: Column) -> Column:
    return F.trim(c, F.lit("-"))


def normalize_stem(stem: Column) -> Column:
    """Lower case; runs of white space, dot, underscore and dash are one dash; none at the ends."""
    return _dashes(F.regexp_replace(F.lower(F.trim(stem)), r"[\s._-]+", "-"))


def stem_key(stem: Column) -> Column:
    """The name that copies and edits of one picture share.

    A bracketed number at the end goes; then trailing numbers, but for the
    sequence number of a camera's own name; then trailing variant words. What
    would leave nothing is kept.
    """
    value = _dashes(F.regexp_replace(normalize_stem(stem), r"\(\d+\)$", ""))
    camera = F.regexp_extract(value, r"^([a-z]{2,5}-\d{3,})(?:-\d+)*$", 1)
    value = F.when(camera != "", camera).otherwise(_dashes(F.regexp_replace(value, r"(?:-+\d+)+$", "")))
    words = "|".join(VARIANT_WORDS)
    key = _dashes(F.regexp_replace(value, rf"(?:(?:^|-+)(?:{words}|v\d+))+$", ""))
    return F.when(key != "", key).otherwise(value)


def stem_alnum_key(stem: Column) -> Column:
    return F.regexp_replace(stem_key(stem), "[^a-z0-9]+", "")


def camera_token(stem: Column) -> Column:
    """The stem key if it is a camera's own file name, else null."""
    key = stem_key(stem)
    return F.when(key.rlike("^(?:" + "|".join(CAMERA_TOKENS) + ")$"), key)


def origin_stem(stem: Column) -> Column:
    """What precedes the first mark of a derived file; null without a mark or before it."""
    first = F.regexp_extract(stem, r"(?s)^(.*?)(?:_ai-repaint|_edited|_crop)", 1)
    return F.when(first != "", first)


def origin_kind(stem: Column) -> Column:
    return F.when(stem.contains("_ai-repaint"), "ai_repaint").when(stem.contains("_edited") | stem.contains("_crop"), "crop").otherwise("import")


def stem_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def normal_extension(extension: Column) -> Column:
    return F.lower(F.trim(extension, F.lit(".")))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stable_id(prefix: str, fingerprint: Column, path: Column | None = None) -> Column:
    """prefix_ and 24 hex digits: of sha1(fingerprint:path), or of the fingerprint."""
    digest = F.sha1(F.concat(fingerprint, F.lit(":"), path)) if path is not None else fingerprint
    return F.concat(F.lit(prefix + "_"), F.substring(digest, 1, 24))


def hashed_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of sha1 over the parts, colons between them."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 24))


def normalize_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(tag), r"\s+", " ")), " +", " ")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def json_in_reply(text: Column) -> Column:
    """The JSON object of a model's reply, as text: fences off, else the widest braces."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\n", ""), r"\n```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.try_parse_json(bare).isNotNull()
    return F.when(whole, bare).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def json_number(json: Column, path: str, kind: str = "double") -> Column:
    """A typed facet of a JSON column; what is no such number is null."""
    return F.get_json_object(json, path).try_cast(kind)


def json_flag(json: Column, path: str) -> Column:
    """JSON true and false as 1 and 0; numbers as they are."""
    v = F.get_json_object(json, path)
    return F.when(v == "true", 1).when(v == "false", 0).otherwise(v.try_cast("int"))


def like_pattern(search: str) -> str:
    """A substring pattern in which % and _ of the input stay wildcards and a backslash is itself."""
    return "%" + search.replace("\\", "\\\\") + "%"


def capture_time(value: Column) -> Column:
    """EXIF or ISO date and time without a zone, as a UTC timestamp; else null."""
    clean = F.trim(F.replace(value, F.lit("\0"), F.lit("")))
    return F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm:ss")))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def review_label(status: Column) -> Column:
    return F.when(status.isin("auto_bound", "manual_confirmed"), "matched").when(status == "pending_confirmation", "needs_review").when(status == "unmatched", "unmatched").otherwise(status)


def ratio_parts(ratio: Column) -> Column:
    """"a:b" as struct(a, b) of positive numbers; else null."""
    a, b = F.split_part(ratio, F.lit(":"), F.lit(1)).try_cast("double"), F.split_part(ratio, F.lit(":"), F.lit(2)).try_cast("double")
    return F.when((a > 0) & (b > 0) & (F.size(F.split(ratio, ":")) == 2), F.struct(a.alias("a"), b.alias("b")))


def crop_box(width: Column, height: Column, a: Column, b: Column, gravity: str = "center") -> Column:
    """The largest a:b box inside width x height: struct(left, top, right, bottom)."""
    wide = width * b > height * a
    w = F.when(wide, F.round(height * a / b)).otherwise(width).cast("int")
    h = F.when(wide, height).otherwise(F.round(width * b / a)).cast("int")
    left = F.lit(0) if "left" in gravity else width - w if "right" in gravity else F.floor((width - w) / 2)
    top = F.lit(0) if "top" in gravity else height - h if "bottom" in gravity else F.floor((height - h) / 2)
    left, top = left.cast("int"), top.cast("int")
    return F.struct(left.alias("left"), top.alias("top"), (left + w).alias("right"), (top + h).alias("bottom"))
