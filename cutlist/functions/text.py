"""Scalar functions on names, paths, times and words: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words in their order.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves upward, also below zero."""
    return F.floor(x + 0.5)


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def trim_space(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_space(c), F.lit("")) == ""


def normalize_token(c: Column) -> Column:
    """Lower case, letters a to z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normalize_chunk_text(c: Column) -> Column:
    """Lower case, without space, punctuation and symbols at both ends."""
    return F.regexp_replace(F.lower(trim_space(c)), r"(?U)^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", "")


def first_within_one(token: Column, table: dict[str, str] | dict[str, int]) -> Column:
    """Value of the first key of ``table`` that is ``token`` within one edit; the token itself goes first."""
    exact, near = F.lit(None), F.lit(None)
    for k, v in reversed(table.items()):  # the first key that fits decides
        exact = F.when(token == k, v).otherwise(exact)
        near = F.when(F.length(token).between(len(k) - 1, len(k) + 1) & (F.levenshtein(token, F.lit(k), 1) >= 0), v).otherwise(near)
    longest = max(map(len, table)) + 1
    return F.when(F.length(token) <= longest, F.coalesce(exact, near))


def leading_number(c: Column) -> Column:
    """1 to 99 for leading digits; null otherwise."""
    return F.regexp_extract(c, r"^0*([1-9]\d?)(?!\d)", 1).try_cast("int")


def parse_spoken_number(c: Column) -> Column:
    """1 to 10 for a number word, 1 to 99 for leading digits, else the first word within one edit; null otherwise."""
    return F.when(F.length(c) > 0, F.coalesce(leading_number(c), first_within_one(c, NUMBER_WORDS))).cast("int")


def ass_timestamp(ms: Column) -> Column:
    """Milliseconds as H:MM:SS.cc, floored; 0 for negative or not finite."""
    safe = F.when(finite(ms) & (ms > 0), ms).otherwise(0.0).cast("double")

    def two(x: Column) -> Column:
        return F.lpad(F.floor(x).cast("string"), 2, "0")

    return F.concat(
        F.floor(safe / 3600000).cast("string"), F.lit(":"), two((safe % 3600000) / 60000), F.lit(":"), two((safe % 60000) / 1000), F.lit("."), two((safe % 1000) / 10)
    )


def ass_color(c: Column) -> Column:
    """#RRGGBB as &H00BBGGRR; of an 8-digit value the first six digits count."""
    hex_ = F.replace(c, F.lit("#"), F.lit(""))
    return F.concat(F.lit("&H00"), F.substring(hex_, 5, 2), F.substring(hex_, 3, 2), F.substring(hex_, 1, 2))


def ass_back_color(c: Column) -> Column:
    """#AARRGGBB as &HAABBGGRR, #RRGGBB as &H00BBGGRR."""
    hex_ = F.replace(c, F.lit("#"), F.lit(""))
    full = F.concat(F.lit("&H"), F.substring(hex_, 1, 2), F.substring(hex_, 7, 2), F.substring(hex_, 5, 2), F.substring(hex_, 3, 2))
    return F.when(F.length(hex_) == 8, full).otherwise(ass_color(c))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def output_name(hook_text: Column, hook: Column, meat: Column, cta: Column, index: Column) -> Column:
    """Name of a combo's video: hook text cleared of path characters, or the hook's name, then meat, cta and number."""
    label = F.regexp_replace(F.regexp_replace(trim_space(hook_text), r'[<>:"/\\|?*]+', ""), r"(?U)\s+", " ")
    label = F.when(is_blank(hook_text), without_extension(hook)).otherwise(label)
    return F.concat(label, F.lit("_"), without_extension(meat), F.lit("_"), without_extension(cta), F.lit("_"), (index + 1).cast("string"), F.lit(".mp4"))


def file_name(path: Column) -> Column:
    """Last part of a path with either separator; ``Unknown`` if that is empty."""
    last = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.when(F.coalesce(last, F.lit("")) == "", "Unknown").otherwise(last)


def safe_segment(c: Column, fallback: str) -> Column:
    """One ``_`` for each character outside a-z, A-Z, 0-9, ``._-``; no leading dots."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9._-]", "_"), r"^\.+", "")
    return F.when(safe == "", fallback).otherwise(safe)


def join_output_path(directory: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(directory, r"[/\\]+$", ""), F.lit("/"), name)


def format_clock(seconds: Column) -> Column:
    """Seconds as MM:SS.s."""
    return F.concat(F.lpad(F.floor(seconds / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.format_string("%.1f", seconds % 60), 4, "0"))


def parse_clock(c: Column) -> Column:
    """m:ss(.s), or plain seconds; null otherwise."""
    form = r"^(\d+):(\d{1,2}(?:\.\d+)?)$"
    clock = F.regexp_extract(c, form, 1).try_cast("double") * 60 + F.regexp_extract(c, form, 2).try_cast("double")
    return F.when(c.rlike(form), clock).otherwise(F.when(c.rlike(r"^\d+(\.\d+)?$"), c.try_cast("double")))
