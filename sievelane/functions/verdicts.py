"""Parsers of judge replies. A reply without a verdict gives null unless ``default`` says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


def _or(c: Column, default: int | None) -> Column:
    return c if default is None else F.coalesce(c, F.lit(default))


def last_verdict(reply: Column, default: int | None = None) -> Column:
    """The last 0 or 1 that isn't followed, read backwards, by a word character."""
    return _or(F.nullif(F.regexp_extract(F.reverse(text(reply)), r"([01])\b", 1), F.lit("")).cast("int"), default)


def first_verdict(reply: Column, default: int | None = None) -> Column:
    return _or(F.nullif(F.regexp_extract(text(reply), "[01]", 0), F.lit("")).cast("int"), default)


def last_number_verdict(reply: Column, default: int | None = None) -> Column:
    """The last whole number if it is 0 or 1, else the last character 0 or 1."""
    numbers = F.regexp_extract_all(text(reply), F.lit(r"\d+"), F.lit(0))
    chars = F.regexp_extract_all(text(reply), F.lit("[01]"), F.lit(0))
    last = F.try_element_at(numbers, F.lit(-1))
    return _or(F.when(last.isin("0", "1"), last).otherwise(F.try_element_at(chars, F.lit(-1))).cast("int"), default)


def numbered_verdict(reply: Column, n: Column | int, default: int | None = None) -> Column:
    """The verdict of line ``n. 0`` or ``n. 1`` (also with ``)``, ``:`` or ``-``)."""
    number = F.lit(n).cast("string") if isinstance(n, int) else n.cast("string")
    hits = F.filter(F.split(text(reply), "\n"), lambda x: F.regexp_extract(x, r"^\s*(\d+)\s*[.):\-]\s*[01]", 1) == number)
    return _or(F.nullif(F.regexp_extract(F.coalesce(F.get(hits, F.lit(0)), F.lit("")), r"^\s*\d+\s*[.):\-]\s*([01])", 1), F.lit("")).cast("int"), default)


def batch_verdicts(reply: Column, size: Column | int, default: int | None = None) -> Column:
    """``size`` verdicts of one reply: lines of a bare 0 or 1 if there are just so many, else numbered lines."""
    n = F.lit(size) if isinstance(size, int) else size
    bare = F.filter(F.transform(F.split(text(reply), "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[01]$"))
    numbered = F.transform(F.sequence(F.lit(1), n), lambda i: numbered_verdict(reply, i, default))
    return F.when(F.size(bare) == n, F.transform(bare, lambda x: x.cast("int"))).otherwise(numbered)


def numbered_text(line: Column, original: Column) -> Column:
    """The text after ``n.``; the original if there is none."""
    return F.coalesce(F.nullif(F.trim(F.get(F.split(text(line), r"\.", 2), F.lit(1))), F.lit("")), original)
