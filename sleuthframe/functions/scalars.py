"""Scalar functions of artifact queries, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import python_round

#: Seconds from 1601-01-01 and from 2001-01-01 to 1970-01-01, as WebKit and Cocoa count.
WEBKIT_EPOCH, COCOA_EPOCH = -11_644_473_600, 978_307_200

# Which extensions are which media.
MEDIA_TYPES = {
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff"),
    "video": (".mp4", ".avi", ".mov", ".wmv", ".flv"),
    "audio": (".mp3", ".wav", ".aac", ".m4a", ".ogg"),
    "document": (".pdf", ".doc", ".docx", ".txt", ".rtf"),
}
AUDIO_EXTENSIONS = (".mp3", ".wav", ".aac", ".m4a", ".ogg", ".amr", ".opus", ".flac", ".3gp")


def extension(path: Column) -> Column:
    """The last suffix of a path in lower case with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    found = None
    for kind, suffixes in MEDIA_TYPES.items():
        is_kind = extension(path).isin(*suffixes)
        found = F.when(is_kind, kind) if found is None else found.when(is_kind, kind)
    return found.otherwise("unknown")


def is_audio(media_type: Column, path: Column) -> Column:
    return F.coalesce(F.lower(media_type).contains("audio"), F.lit(False)) | F.coalesce(extension(path).isin(*AUDIO_EXTENSIONS), F.lit(False))


def report_category(path: Column) -> Column:
    """The kind of a file in a report folder; the first rule that holds decides."""
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    return (
        F.when(low.startswith("_html") | name.endswith(".html"), "html_reports")
        .when(low.startswith("_tsv exports") | name.endswith(".tsv"), "tsv_exports")
        .when(name.endswith(".db"), "databases")
        .when(low.startswith("_timeline"), "timeline")
        .when(low.startswith("data"), "data_extraction")
        .when(low.startswith("script logs"), "scripts")
        .otherwise("other")
    )


def human_size(size: Column) -> Column:
    units = ("B", "KB", "MB", "GB", "TB")
    found = F.when(size == 0, "0 B")
    for i, unit in enumerate(units):
        # rounded first, half to even: Java's format rounds half up
        text = F.format_string(f"%.1f {unit}", python_round(size.cast("double") / float(1024**i), 1))
        found = found.otherwise(text) if i == len(units) - 1 else found.when(size < 1024 ** (i + 1), text)
    return found


def slug(path: Column) -> Column:
    """A folder name from the stem of a path."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(stem, r"(?U)[^\w\-_.]", "_")), "_+", "_"), F.lit("_"))


def sql_name(name: Column) -> Column:
    """A table or column name: word characters only, in lower case, starting with a letter or an underscore."""
    clean = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s]", ""), r"(?U)\s+", "_")
    return F.lower(F.when(clean.rlike(r"(?U)^[^\p{L}]"), F.concat(F.lit("_"), clean)).otherwise(clean))


#: Fixed value: characters that a file's name can't have everywhere; a path may have the first two.
ILLEGAL = r"\\/*?:\"<>|'\r\n"


def file_name(name: Column, instead: str = "_") -> Column:
    """A name for a file: characters that are illegal somewhere replaced."""
    return F.regexp_replace(name, f"[{ILLEGAL}]", instead)


def file_path(path: Column, instead: str = "_") -> Column:
    """As :func:`file_name`, slashes of either kind left as they are."""
    return F.regexp_replace(path, "[" + ILLEGAL.removeprefix(r"\\/") + "]", instead)


def short_path(path: Column, longest: int = 240) -> Column:
    """A path of at most ``longest`` characters; a longer one keeps its beginning and its suffix around an MD5 of the whole."""
    suffix = F.substring(extension(path), 1, 16)
    tail = F.concat(F.lit("_"), F.substring(F.md5(path), 1, 8), suffix)
    return F.when(F.length(path) <= longest, path).otherwise(F.concat(F.substring(path, F.lit(1), F.lit(longest) - F.length(tail)), tail))


# Time.


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970 of a count in seconds or any finer decimal unit: ten digits are kept."""
    n = value.cast("bigint")
    extra = F.greatest(F.length(F.abs(n).cast("string")) - 10, F.lit(0))
    return F.floor(n / F.pow(F.lit(10.0), extra)).cast("bigint")


def utc_text(seconds: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of whole seconds since 1970, in UTC."""
    return F.date_format(F.timestamp_seconds(seconds.cast("bigint")), "yyyy-MM-dd HH:mm:ss")


def webkit_text(microseconds: Column) -> Column:
    return utc_text(F.floor(microseconds / 1_000_000) + WEBKIT_EPOCH)


def cocoa_text(seconds: Column) -> Column:
    return utc_text(F.floor(seconds) + COCOA_EPOCH)


def human_time(text: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")) -> Column:
    """The first format that fits, without a fraction of a second; null if none does."""
    bare = F.regexp_replace(text, r"\..*$", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in formats))


def strict_human_time(text: Column) -> Column:
    """As :func:`human_time` with seconds, minutes or days as the finest; a text that none fits ends the job."""
    found = human_time(text, ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"))
    return F.when(found.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit("not a time: "), text))).otherwise(found)


def local_to_utc(text: Column) -> Column:
    """The UTC time of a local one that ends in its offset, as in 2023-10-27 18:18:29-0400; null if it is none."""
    parts = [F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)([+-]\d\d):?(\d\d)$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", utc_moment(F.concat(parts[0], parts[1], F.lit(":"), parts[2]), "yyyy-MM-dd HH:mm:ssXXX"))


def iso_utc(text: Column) -> Column:
    """The UTC time, without a zone, of an ISO text: with Z or an offset, or without either, which is UTC; a date alone is its midnight.

    Null for what is no such text.
    """
    whole = r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d)(?::(\d\d))?(?:\.(\d{1,6})\d*)?)?(Z|[+-]\d\d:\d\d)?$"
    day, minute, second, fraction, zone = (F.regexp_extract(text, whole, i) for i in range(1, 6))

    def known(c: Column, other: str) -> Column:
        return F.when(c == "", other).otherwise(c)

    moment = F.concat(day, F.lit(" "), known(minute, "00:00"), F.lit(":"), known(second, "00"), F.lit("."), F.rpad(fraction, 6, "0"), known(zone, "Z"))
    return F.when(day != "", utc_moment(moment, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"))


def utc_moment(text: Column, pattern: str) -> Column:
    """A text with an offset as the time in UTC, without a zone, whatever the session's."""
    moment = F.try_to_timestamp(text, F.lit(pattern))
    return F.timestamp_add("MICROSECOND", F.unix_micros(moment), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def in_timezone(utc: Column, timezone: str) -> Column:
    return F.from_utc_timestamp(utc, timezone)


# What SQLite does otherwise than Spark.


def integer_division(a: Column, b: int) -> Column:
    """Truncates toward zero."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def lax_number(text: Column) -> Column:
    """The number at the start of a text, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def substr(text: Column, start: int, length: int) -> Column:
    """SQLite's substr: a start of 0 is one place before the text."""
    return F.substring(text, 1, max(0, length - 1)) if start == 0 else F.substring(text, start, length)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def flags(value: Column, names: Sequence[tuple[int, str]]) -> Column:
    """Names of the bits that are set, joined by commas."""
    return F.concat_ws(", ", *(F.when(value.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in names))


# Decoders without an SQL form. Types are objects, since their text is only parsed once a session runs.

POINTS = T.ArrayType(T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]))


def repaired_text(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text as it is."""
    bare = F.when(text.rlike(r"^[\x{00}-\x{FF}]*\z"), F.encode(text, "ISO-8859-1")).cast("string")
    return F.when(F.is_valid_utf8(bare), bare).otherwise(text)


@F.pandas_udf(POINTS)
def polyline(encoded: pd.Series) -> pd.Series:
    """Points of an encoded polyline (differences of 1e-5 degrees in groups of five bits)."""

    def points(text: str | None) -> list[dict[str, float]] | None:
        if text is None:
            return None
        numbers, value, shift = [], 0, 0
        for byte in text.encode("latin-1", "replace"):
            value |= (byte - 63 & 0x1F) << shift
            shift += 5
            if byte - 63 < 0x20:
                numbers.append(~(value >> 1) if value & 1 else value >> 1)
                value = shift = 0
        lat = lon = 0
        out = []
        for a, b in zip(numbers[::2], numbers[1::2]):
            lat, lon = lat + a, lon + b
            out.append({"latitude": lat / 1e5, "longitude": lon / 1e5})
        return out

    return encoded.map(points)
