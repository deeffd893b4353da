"""Parts of cells that list several things: people with roles, other names, sources with dates, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import periods
from .cells import known

#: Words that say what somebody is, in brackets or in a name's place; people without a name; titles before names.
ROLE_WORDS = r"co-?founders?|founders?|owners?|ceo|cto|coo|cfo|cmo|chair(?:man|woman)?|president|directors?|partners?|team|family|investors?"
_MARKS = r"\*\*"


def outside(text: Column, separators: str) -> Column:
    """The trimmed, non-empty parts of a text between separators (a pattern) that aren't within brackets; null for a null text.

    A bracket that is never closed holds nothing back; brackets within brackets count as closed at the first end.
    """
    parts = F.split(text, rf"(?:{separators})(?![^()]*\))", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _plain(cell: Column) -> Column:
    return F.regexp_replace(known(cell), _MARKS, "")


def people(cell: Column) -> Column:
    """array<struct(name, role, note)>: who a cell names, in its order; null for a missing cell.

    Entries stand between semicolons, commas, "&", "and" or " + ", outside brackets.  A bracket of words for a
    role ("(CEO)", "(founder)") is the role, one in the plural that of all names of its entry up to the semicolon
    ("A & B (founders)"); any other bracket is a note.  What is only such words ("co-founders", "partner") is somebody without
    a name, and so is "Founder of X", whose note is X.
    """
    plural = r"(?i)\(((?:co-?founders|founders|owners|directors|partners))\)\s*$"

    def person(part: Column, shared: Column) -> Column:
        bracket = F.regexp_extract(part, r"\(([^()]*)\)", 1)
        is_role = bracket.rlike(rf"(?i)^\s*(?:{ROLE_WORDS})(?:\s*(?:,|&|and|/)\s*(?:{ROLE_WORDS}))*\s*$")
        bare = F.trim(F.regexp_replace(part, r"\([^()]*\)", ""))
        unnamed = bare.rlike(rf"(?i)^(?:the\s+)?(?:{ROLE_WORDS})$")
        of = F.regexp_extract(bare, rf"(?i)^({ROLE_WORDS})\s+of\s+(.+)$", 2)
        role = F.when(is_role, F.trim(bracket)).when(unnamed, bare).when(of != "", F.regexp_extract(bare, rf"(?i)^({ROLE_WORDS})\s+of\s", 1)).otherwise(shared)
        note = F.when(of != "", of).when((bracket != "") & ~is_role, F.trim(bracket))
        return F.struct(F.when(~unnamed & (of == ""), bare).alias("name"), F.lower(role).alias("role"), note.alias("note"))

    def entry(text: Column) -> Column:
        shared = F.nullif(F.regexp_replace(F.regexp_extract(text, plural, 1), r"(?i)s$", ""), F.lit(""))
        names = F.when(shared.isNotNull(), F.regexp_replace(text, plural, "")).otherwise(text)
        return F.transform(outside(names, r",|\s&\s|\sand\s|\s\+\s"), lambda p: person(p, shared))

    return F.flatten(F.transform(outside(_plain(cell), ";"), entry))


def main_name(cell: Column) -> Column:
    """A name cell without its brackets; of "A / B" the first."""
    return F.nullif(F.trim(F.substring_index(F.regexp_replace(_plain(cell), r"\([^()]*\)", ""), " / ", 1)), F.lit(""))


def other_names(cell: Column) -> Column:
    """array<struct(kind, name)> of what a name cell has beside its main name, in its order; null for a missing cell.

    "(formerly A, B)" gives former names, "(by X)" a maker, any other bracket ("(A, B)", "(brands: A)", "(also A)") brands,
    and "A / B" another name, B.
    """
    text = _plain(cell)
    formerly, by = r"(?i)^(?:formerly|previously|ex|née)\b[\s:]*", r"(?i)^by\s+"

    def bracket(inner: Column) -> Column:
        kind = F.when(inner.rlike(formerly), "former").when(inner.rlike(by), "maker").otherwise("brand")
        names = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, formerly, ""), by, ""), r"(?i)^(?:also(?: known as)?|aka|brands?:?)\s+", "")
        parts = F.when(kind == "maker", F.array(F.trim(names))).otherwise(outside(names, r",|\s\+\s|\s&\s|;"))
        return F.transform(parts, lambda x: F.struct(kind.alias("kind"), x.alias("name")))

    slashes = F.transform(F.slice(F.split(F.regexp_replace(text, r"\([^()]*\)", ""), r"\s/\s", -1), F.lit(2), F.lit(100)), lambda x: F.struct(F.lit("other").alias("kind"), F.trim(x).alias("name")))
    brackets = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), bracket))
    return F.filter(F.concat(slashes, brackets), lambda x: x["name"] != "")


def sources(cell: Column) -> Column:
    """array<struct(publisher, date, begins, ends)>: the sources of a cell, between semicolons; null for a missing cell.

    date is the period that the source ends with, as written, null where it names none; publisher is the rest.  begins
    and ends are its days.
    """

    def source(text: Column) -> Column:
        date = F.nullif(F.trim(F.regexp_extract(text, rf"(?:{periods.PERIOD})\s*$", 0)), F.lit(""))
        span = periods.period(date)
        publisher = F.when(date.isNull(), text).otherwise(F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(date))))
        return F.struct(F.nullif(F.rtrim(publisher, F.lit(" ,(")), F.lit("")).alias("publisher"), date.alias("date"), span["from"].alias("begins"), span["to"].alias("ends"))

    return F.transform(outside(_plain(cell), ";"), source)


def head_counts(cell: Column) -> Column:
    """array<struct(lo, hi, is_estimate, kind)>: every count of a cell, each with its own mark and words; null for a missing cell.

    "16 FTE + ~60 casual" is 16 exact of kind FTE and an estimated 60 of kind casual; "~10–20 (est.)" is one range; "200+" has no hi.
    A part without a number gives none.
    """
    text = F.regexp_replace(_plain(cell), r"(?<=[0-9]),(?=[0-9]{3})", "")
    number = r"([0-9]+)(?:\s*[-–]\s*([0-9]+))?(\+)?"

    def count(part: Column) -> Column:
        lo, hi = (F.regexp_extract(part, number, i).try_cast("int") for i in (1, 2))
        estimate = part.rlike(r"(?i)~|≈|\b(?:about|around|roughly|some)\s|\best(?:\.|imated?)?(?![a-z])")
        words = F.regexp_replace(F.regexp_replace(part, rf"^(.*?){number}", "$1"), r"(?i)~|≈|\b(?:about|around|roughly|some)\s|\(?\best(?:\.|imated?)?(?![a-z])\)?", "")
        open_ = F.regexp_extract(part, number, 3) == "+"
        return F.struct(lo.alias("lo"), F.when(~open_, F.coalesce(hi, lo)).alias("hi"), estimate.alias("is_estimate"), F.nullif(F.trim(F.regexp_replace(words, r"\s+", " ")), F.lit("")).alias("kind"))

    parts = outside(text, r"\s\+\s|\s&\s|;|,\s|\band\b|\bplus\b")
    return F.filter(F.transform(parts, count), lambda x: x["lo"].isNotNull())
