"""Scalar functions as column expressions: tolerant times and dates, labels, formats, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a logged time may say instead of a clock time.
NO_ANCHOR = ["all day", "morning and afternoon"]


def clock_seconds(text: Column) -> Column:
    """``H``, ``H:M`` or ``H:M:S`` as seconds, else null. There is no range check."""
    p = F.split(text, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("int")
    valid = text.rlike(r"^\s*\d+\s*(:\s*\d+\s*){0,2}$")
    return F.when(valid, part(0) * 3600 + F.coalesce(part(1), F.lit(0)) * 60 + F.coalesce(part(2), F.lit(0)))


def tolerant_time(text: Column) -> Column:
    """``struct<sec int, note string>`` of a hand-written time: a leading ``~`` and one trailing doubt mark
    are dropped; what can't be read has a null ``sec`` and says why."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, "^~+", "")), r"(\(\?\)|[?!])$", ""))
    sec = F.when(~bare.rlike("[?!+]"), clock_seconds(bare))
    quoted = lambda label: F.concat(F.lit(f"{label}:'"), t, F.lit("'"))
    note = F.when(t == "", "empty_time").when(F.lower(t).isin(NO_ANCHOR), quoted("skipped_no_anchor")).when(sec.isNull(), quoted("unparseable"))
    return F.struct(F.when(note.isNull(), sec).alias("sec"), note.alias("note"))


def strict_time(text: Column) -> Column:
    """Seconds of ``HH:MM`` or ``HH:MM:SS``, else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d+:\d+(:\d+)?$"), clock_seconds(t))


def iso_date(text: Column) -> Column:
    """``2026-3-7`` as ``2026-03-07``; null unless there are three whole numbers."""
    p = F.split(F.trim(text), "-")
    n = [F.get(p, F.lit(i)).try_cast("int") for i in range(3)]
    return F.when((F.size(p) == 3) & n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull(), F.format_string("%04d-%02d-%02d", *n))


def recording_seconds(name: Column) -> Column:
    """Seconds since midnight of a name that begins with ``HHMMSS``."""
    h = F.split(name, "--")[0]
    return F.when(h.rlike(r"^\d{6}"), F.substring(h, 1, 2).cast("int") * 3600 + F.substring(h, 3, 2).cast("int") * 60 + F.substring(h, 5, 2).cast("int"))


def safe_label(text: Column, length: int = 30) -> Column:
    """A file name's part: everything but word characters becomes ``_``."""
    return F.substring(F.regexp_replace(text, r"(?U)[^\w]", "_"), 1, length)


def camera_key(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("")))


def url_part(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("%20"))


def minutes_seconds(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: float = 1e-8) -> Column:
    """Null where the lengths' product and the guard are 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(guard))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column, guard: float = 1e-8) -> Column:
    """``a`` over its length, the length being ``guard`` at least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(a, a)), F.lit(guard)))


def two_way_softmax(positive: Column, negative: Column, scale: float = 100.0) -> Column:
    return 1 / (1 + F.exp((negative - positive) * scale))


def corners(box: Column, width: int, height: int) -> Column:
    """Pixel corners of a relative centre-and-size box, cut towards zero."""
    at = lambda v, n: (v * n).cast("int")
    return F.struct(
        at(box["cx"] - box["w"] / 2, width).alias("x1"), at(box["cy"] - box["h"] / 2, height).alias("y1"),
        at(box["cx"] + box["w"] / 2, width).alias("x2"), at(box["cy"] + box["h"] / 2, height).alias("y2"),
    )


def mean_difference(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Mean absolute difference of two arrays; null if they are empty."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total, F.size(a) * F.lit(scale))


def crop_box(cx: Column, cy: Column, size: int, width: int, height: int) -> Column:
    """A box of ``size`` around a relative centre, moved inward at the edges."""
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - size), (c * n).cast("int") - size // 2))
    return F.struct(at(cx, width).alias("x"), at(cy, height).alias("y"))


def file_stem(name: Column) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")


def number_pair(text: Column) -> Column:
    """``struct<start, end>`` of two comma-separated numbers of which the second is larger, else null."""
    p = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    pair = F.struct(F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end"))
    return F.when((F.size(p) == 2) & (pair["start"] < pair["end"]), pair)


def fused(a: Column, b: Column, guard: float = 1e-8) -> Column:
    """Two vectors one after another, as one of length 1."""
    return normalised(F.concat(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))), guard)


def listing_entry(entry: Column, template: str) -> Column:
    """``struct<id, url, title, duration>`` of a listing's JSON entry: the URL falls back to the template's, the title
    to the empty string and the duration to 0; null where there is no entry or no id."""
    e = F.from_json(entry, "id string, url string, title string, duration double")
    return F.when(e["id"].isNotNull(), F.struct(e["id"].alias("id"), F.coalesce(e["url"], F.format_string(template, e["id"])).alias("url"), F.coalesce(e["title"], F.lit("")).alias("title"), F.coalesce(e["duration"], F.lit(0.0)).alias("duration")))


def inside(x: Column, y: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Whether a box's centre lies in a region, its borders included; both in one unit, shares of the frame or pixels."""
    return x.between(left, right) & y.between(top, bottom)


def pixel_centre(first: Column, last: Column) -> Column:
    """The middle pixel of two whole ones, the lower of two."""
    return F.floor((first + last) / 2)


def frame_name(rank: Column, video: Column, seconds: Column, score: Column) -> Column:
    """The file of a top frame: its place, recording, time and score."""
    return F.format_string("rank%02d_%s_t%04ds_score%.3f.jpg", rank, video, seconds, score)
