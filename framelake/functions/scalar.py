"""Scalar functions over photo metadata, as Column builders: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def display_name(key: Column, path: Column) -> Column:
    """File name of a photo: of its path, else of its key without the `file:` prefix."""
    return F.coalesce(base_name(path), F.regexp_replace(key, "^file:", ""))


def parse_iso(text: Column) -> Column:
    """First run of digits; null without one."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")


def parse_f_number(text: Column) -> Column:
    """`a/b` becomes its quotient, else a number, to one decimal without `.0`; what is no number stays; blank is null."""
    t = F.trim(text)
    number = r"^[+-]?(?:[0-9]+|[0-9]*\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    parts = F.split(t, "/")
    top, bottom = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    ratio = F.when((F.size(parts) == 2) & top.rlike(number) & bottom.rlike(number), F.try_divide(top.try_cast("double"), bottom.try_cast("double")))
    value = F.coalesce(ratio, F.when(t.rlike(number), t.try_cast("double")))
    shown = F.regexp_replace(F.format_string("%.1f", F.round(value, 1)), r"\.0$", "")
    return F.when(t == "", None).otherwise(F.coalesce(F.when(value.isNotNull(), shown), t))


def parse_exif_time(text: Column) -> Column:
    """Seconds-exact local time at the start of the text, parts of the date split by `:` or `-`, then a space or T; else null."""
    found = r"^\s*([0-9]{4})[:-]([0-9]{2})[:-]([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})"
    part = lambda i: F.regexp_extract(text, found, i)
    joined = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    return F.when(text.rlike(found), joined.try_cast("timestamp_ntz"))


def exif_caption(captured_at: Column, f_number: Column, shutter: Column, iso: Column) -> Column:
    """Non-empty parts, two spaces apart: HH:mm:ss, F.., shutter, ISO.."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws("  ", F.date_format(captured_at, "HH:mm:ss"), F.concat(F.lit("F"), some(f_number)), some(shutter), F.concat(F.lit("ISO"), some(iso)))


def window_seconds(minutes: Column, seconds: Column) -> Column:
    """Burst window from minutes and seconds, held to 1 .. 3600."""
    return F.greatest(F.lit(1), F.least(F.lit(3600), minutes * 60 + seconds))


def format_window(total: Column) -> Column:
    """Hours, minutes and seconds without the parts that are zero."""
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    whole = lambda x, n: F.floor(x / n)
    return F.concat_ws(" ", part(whole(total, 3600), "h"), part(whole(total % 3600, 60), "m"), part(total % 60, "s"))


def folder_name_ok(name: Column) -> Column:
    """Whether a folder may have the name: trimmed, 1 to 30 characters, none that file systems refuse."""
    t = F.trim(name)
    return (F.length(t) > 0) & (F.length(t) <= 30) & ~t.rlike(r'[<>:"/\\|?*]')


def eye_text(both_eyes: Column, eyes_closed: Column) -> Column:
    return F.when(both_eyes, "both eyes").when(eyes_closed, "closed").otherwise("")


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, halves away from zero."""
    return F.format_string(f"%.{digits}f", F.round(value, digits))
