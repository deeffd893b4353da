"""Typed values from free-text cells: missing marks, statuses, lists, ranges, aliases, values with confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How cells say that something was not found.
MISSING = ("—", "-", "", "n/a", "not disclosed", "undisclosed", "amount undisclosed", "amount not disclosed", "amount not confirmed")
#: Those that may go on ("Not disclosed (2025)"): what follows is a remark, not a value.
_MISSING_PREFIX = r"(?i)^(?:amount )?(?:not disclosed|undisclosed|not confirmed)(?![a-z])"
#: Words of a fact that there was no such thing, and of a raise that is open.
_NONE = r"(?i)bootstrapped|self-funded|never raised|no external|zero external|\bnone yet\b"
_RAISING = (
    r"(?i)\bseeking\b|\braising\b|mid-raise|\bactive (?:raise|round)|(?:round|raise|seed|series [a-z])\s+(?:(?:is|now|still)\s+)?(?:open|underway|in progress)\b"
    r"|\bopen (?:round|raise)|\bopen(?:ed|ing)?\s+to\s+(?:outside\s+|external\s+|new\s+)?invest|\bconsidering\s+(?:a|an)\s+(?:raise|round)"
)
#: Currency marks and their codes; a bare $ has none.
CURRENCIES = {"A$": "AUD", "NZ$": "NZD", "US$": "USD", "C$": "CAD", "£": "GBP", "€": "EUR", "$": None}


def known(cell: Column) -> Column:
    """The trimmed cell, null where it says that nothing was found, with a remark or without."""
    trimmed = F.trim(cell)
    return F.when(~F.lower(trimmed).isin(*MISSING) & ~trimmed.rlike(_MISSING_PREFIX), trimmed)


def remark(cell: Column) -> Column:
    """What a missing cell says beyond its mark, or null."""
    return F.when(known(cell).isNull(), F.nullif(F.trim(F.regexp_extract(F.trim(cell), _MISSING_PREFIX + r"[\s,;:.—–-]*(.*)$", 1)), F.lit("")))


def status(cell: Column) -> Column:
    """missing, none (a fact that there was none, which isn't missing), raising (an open raise, or the stated intent of one) or stated."""
    value = known(cell)
    return F.when(value.isNull(), "missing").when(value.rlike(_RAISING), "raising").when(value.rlike(_NONE), "none").otherwise("stated")


def many(cell: Column, separator: str = ";") -> Column:
    """The trimmed, non-empty parts of a cell of several values; null for a missing cell."""
    return F.filter(F.transform(F.split(known(cell), separator, -1), lambda x: F.trim(x)), lambda x: x != "")


def number_range(cell: Column) -> Column:
    """struct(lo, hi, is_estimate, note) of "10–20", "~15 (est.)", "1,200" or "8 FTE + casual"; note is what else it says; null without a number.

    Of several counts in a cell the first is taken; parts.head_counts reads all of them.
    """
    text = F.regexp_replace(known(cell), r"(?<=[0-9]),(?=[0-9]{3})", "")
    number = r"([0-9]+)(?:\s*[-–]\s*([0-9]+))?"
    lo, hi = (F.regexp_extract(text, number, i).try_cast("int") for i in (1, 2))
    estimate = r"(?i)~|\best(?:\.|imated?)?(?![a-z])"
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, rf"^(.*?){number}", "$1"), estimate, ""), r"\(\s*\)", "")
    note = F.nullif(F.trim(F.regexp_replace(rest, r"\s+", " ")), F.lit(""))
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), F.coalesce(hi, lo).alias("hi"), text.rlike(estimate).alias("is_estimate"), note.alias("note")))


def aliases(name: Column) -> Column:
    """Other names in "Name (formerly A, B)", as an array; parts.other_names tells all kinds of them apart."""
    inner = F.regexp_extract(name, r"\((?:formerly|also|brands?:?)\s+([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inner, r",|\+|&", -1), lambda x: F.trim(x)), lambda x: x != "")


def valued(cell: Column) -> Column:
    """struct(value, confidence) of "**Value** (High)"."""
    return F.struct(F.trim(F.regexp_replace(F.regexp_replace(known(cell), r"\((High|Med|Low)\)", ""), r"\*\*", "")).alias("value"), F.nullif(F.regexp_extract(cell, r"\((High|Med|Low)\)", 1), F.lit("")).alias("confidence"))
