"""Column functions that bring spellings of paths, names and sources to one form. All of them give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of white space beyond ASCII's, zero-width characters included, as ranges; then the class for Java's regular expressions.
BLANK_CODES = "00a0 1680 180e 2000-200d 2028-2029 202f 205f-2060 3000 feff"
BLANKS = r"\s" + "".join("-".join("\\u" + code for code in codes.split("-")) for codes in BLANK_CODES.split())

#: Endings of video files.
VIDEO_ENDINGS = "mp4 mov mkv m4v avi webm mpg mpeg wmv flv mts m2ts 3gp ogv"

#: Endings of image files.
IMAGE_ENDINGS = "webp jpg jpeg png bmp gif tif tiff avif"

#: Marks that a copy or another encoding adds to a file's name.
COPY_MARKS = r"copy(?:_\d+)?|copie|kopie|copia|dup(?:licate)?|exports?|exported|compressed|reenc|re_enc|reencoded|re_encoded|transcoded?|proxy|[hx]_?26[45]|hevc|avc|av1|vp9|\d{3,4}p|[48]k|\d+fps|\(\d+\)"


def stripped(c: Column) -> Column:
    """Without white space at either end, of whatever kind."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def slug(c: Column) -> Column:
    """Lower case, with one underscore for each run of blanks, hyphens and underscores, and none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), f"[{BLANKS}_\\-\\u2010-\\u2015]+", "_"), "^_+|_+$", "")


def without_steps_up(path: Column) -> Column:
    """A path with each ``..`` resolved, however many there are; those that lead above the start stay."""
    parts = F.split(path, "/")
    can_go = lambda seen: (F.size(seen) > 0) & ~F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("..")).isin("..", "")
    step = lambda seen, part: F.when((part == "..") & can_go(seen), F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(part)))
    return F.when(path.rlike(r"(?:^|/)\.\.(?:/|$)"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")).otherwise(path)


def plain_path(c: Column) -> Column:
    """A path or address in lower case: percent codes decoded, back-slashes turned, scheme, query, fragment, empty parts
    and ``.`` dropped, ``..`` resolved. One chain, in which each step stands once."""
    c = F.regexp_replace(F.regexp_replace(stripped(c), r"\\", "/"), r"\+", "%2B")
    c = F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))
    c = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "/")
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"/(?:\./)+", "/"), "/{2,}", "/")
    return stripped(F.get(F.transform(F.array(c), without_steps_up), F.lit(0)))


def file_name(c: Column) -> Column:
    """The last part of a path or address, percent codes decoded, without query and fragment; case stays."""
    decoded = F.try_url_decode(F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.regexp_extract(F.when(c.contains("%"), decoded).otherwise(c), rf"([^/\\?#]*?)[{BLANKS}]*(?:[?#].*)?$", 1)


def file_stem(c: Column, endings: str) -> Column:
    """A file's name without its ending (or endings), as a slug."""
    return slug(F.regexp_replace(F.lower(c), rf"(?:\.(?:{'|'.join(endings.split())}))+$", ""))


def without_copy_marks(c: Column) -> Column:
    """A slug without the marks of copies and encodings at its end; numbered pieces (``_s02``) stay."""
    return F.regexp_replace(c, rf"(?:_?\(\d+\)|_(?:{COPY_MARKS}))+$", "")


def instance_video(path: Column) -> Column:
    """struct<video_name, instance_id> of ``<name>_<digits>.mp4`` (the name as long as can be, any case), null for other files."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = r"(?i)^(.+)_(\d+)\.mp4$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("video_name"), F.regexp_extract(name, pattern, 2).try_cast("bigint").alias("instance_id")))


def crop_file(name: Column, video: Column) -> Column:
    """struct<instance_id, frame_id> of ``<video>_<instance>_<frame>.webp`` of that video, null for other files."""
    rest = F.substr(name, F.length(video) + 1)
    fits = name.startswith(video) & rest.rlike(r"^_\d+_\d+\.webp$")
    part = lambda i: F.regexp_extract(rest, r"^_(\d+)_(\d+)\.webp$", i).try_cast("bigint")
    return F.when(fits, F.struct(part(1).alias("instance_id"), part(2).alias("frame_id")))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """``text`` with each first text of ``pairs`` replaced by the second, one pair after the other."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def class_label(name: Column, default: str = "") -> Column:
    """A class as it is shown: blanks for underscores, each word with a capital."""
    return F.coalesce(F.nullif(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit("")), F.lit(default))


def distinct_items(items: Column) -> Column:
    """The items without white space around them, blanks and nulls left out, each at its first place."""
    return F.array_distinct(F.filter(F.transform(items, stripped), lambda x: x.isNotNull() & (x != "")))


def bin_bounds(text: Column) -> Column:
    """struct<low, high> of the text of a bin, its first two numbers."""
    found = F.regexp_extract_all(text, F.lit(r"([+-]?\d+(?:\.\d+)?)(?=[^\d.]|$)"), F.lit(1))
    return F.when(F.size(found) >= 2, F.struct(F.get(found, F.lit(0)).try_cast("double").alias("low"), F.abs(F.get(found, F.lit(1)).try_cast("double")).alias("high")))
