"""Month-exact intervals from the dates and periods that cells name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How months are written.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = rf"(?:{'|'.join(MONTHS)})[a-z]*\.?"
_DASH = r"\s?[-–—]\s?"
#: One period: a day, months of a year, months of a fiscal year, a quarter, a fiscal year, a range of years, a year; groups are taken by number.
PERIOD = (
    rf"(?i)(?:\b([0-9]{{1,2}})\s)?\b(?:({_MONTH}){_DASH})?({_MONTH})\s((?:19|20)[0-9]{{2}})\b"
    r"|\b(?:([0-9]{1,2})\s?mo(?:nths?)?\s(?:of\s)?)?FY\s?((?:19|20)?[0-9]{2})\b"
    r"|\b(?:Q([1-4])|H([12]))\s((?:19|20)[0-9]{2})\b"
    rf"|(since\s)?\b(?<![0-9][,.])((?:19|20)[0-9]{{2}})(?:{_DASH}((?:19|20)?[0-9]{{2}})\b)?(?![0-9,.]?[0-9])"
)
#: The first month of a fiscal year, which is named by the year that it ends in.
FISCAL = 7


def words(text: Column) -> Column:
    """The first period in a text, as written, or null.  Most texts have no two digits together, and so none."""
    return F.when(text.rlike("[0-9]{2}"), F.nullif(F.trim(F.regexp_extract(text, PERIOD, 0)), F.lit("")))


def period(text: Column, fiscal: int = FISCAL) -> Column:
    """struct(from, to) of dates: the first period that a text names, both days included; null without one.

    "14 Jul 2026" is a day, "Jul 2026" and "Jun–Jul 2026" are whole months ("Nov–Feb 2026" begins in 2025), "2026" and
    "2025–26" whole years, "FY26" the fiscal year that ends in 2026, "10mo FY26" its first ten months, "Q3 2025" and
    "H1 2025" parts of a year.  "since 2021" has no end.  What is no date of the calendar, or more than twelve months of a fiscal year, gives null.
    """
    return F.transform(F.array(groups(text)), lambda g: from_groups(g, fiscal))[0]  # as an element of an array the groups are read once


def groups(text: Column) -> Column:
    """What the groups of PERIOD hold in the first period of a text, as an array; null without one."""
    found = F.regexp_extract(text, PERIOD, 0)
    return F.when(found != "", F.split(F.regexp_replace(found, PERIOD, "|".join(f"${i}" for i in range(1, 13))), r"\|", -1))


def from_groups(found: Column, fiscal: int = FISCAL) -> Column:
    """struct(from, to) of the groups of a period."""
    part = lambda i: F.nullif(F.get(found, i - 1), F.lit(""))
    number = lambda i: part(i).cast("int")
    month = lambda i: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(i), 1, 3))).cast("int")
    first = lambda y, m: F.make_date(y, m, F.lit(1))
    full = lambda i, near: F.when(F.length(part(i)) == 2, near * 100 + number(i)).otherwise(number(i))

    day, until, of = number(1), month(3), number(4)
    since = F.coalesce(month(2), until)
    start = first(of - F.when(since > until, 1).otherwise(0), since)
    exact = F.when(F.coalesce(day, F.lit(1)).between(1, F.day(F.last_day(first(of, until)))), day)
    months = F.when(day.isNull(), F.struct(start.alias("from"), F.last_day(first(of, until)).alias("to"))).when(exact.isNotNull(), F.struct(F.make_date(of, until, exact).alias("from"), F.make_date(of, until, exact).alias("to")))

    ends, many = full(6, F.lit(20)), F.coalesce(number(5), F.lit(12))
    begins = first(ends - (1 if fiscal > 1 else 0), F.lit(fiscal))
    fiscals = F.when(many.between(1, 12), F.struct(begins.alias("from"), F.date_sub(F.add_months(begins, many), 1).alias("to")))

    of = number(9)
    from_, length = F.coalesce(number(7) * 3 - 2, number(8) * 6 - 5), F.when(number(7).isNotNull(), 3).otherwise(6)
    parts = F.struct(first(of, from_).alias("from"), F.date_sub(F.add_months(first(of, from_), length), 1).alias("to"))

    year = number(11)
    last = F.coalesce(full(12, F.floor(year / 100).cast("int")), year)
    to = F.when(part(10).isNull(), F.make_date(last, F.lit(12), F.lit(31)))
    years = F.when(last >= year, F.struct(first(year, F.lit(1)).alias("from"), to.alias("to")))
    return F.when(number(4).isNotNull(), months).when(number(6).isNotNull(), fiscals).when(of.isNotNull(), parts).when(year.isNotNull(), years)
