"""Numbers that prose states, read as expectations and held against counted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in words.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
_WORDS = rf"(?:(?:{'|'.join(TENS)})(?:-(?:{'|'.join(ONES[1:10])}))?|{'|'.join(reversed(ONES))})"
_ABOUT = r"(?:~|≈|roughly|about|around|some|nearly|almost|approximately)"
#: A number, a range or a number in words, before one of the things that are counted.
_DIGITS = r"[0-9][0-9,]*(?![0-9.%])"


def _number(text: Column) -> Column:
    word = F.lower(text)
    tens = F.array_position(F.array(*map(F.lit, TENS)), F.substring_index(word, "-", 1))
    ones = F.array_position(F.array(*map(F.lit, ONES)), F.substring_index(word, "-", -1))
    spoken = F.when(tens > 0, (tens + 1) * 10 + F.when(word.contains("-"), ones - 1).otherwise(0)).when(ones > 0, ones - 1)
    return F.coalesce(F.regexp_replace(text, ",", "").try_cast("long"), spoken.cast("long"))


def claims(df: DataFrame, text: str, things: tuple[str, ...]) -> DataFrame:
    """A row for each stated number of things in a text, in their order: the columns of df and claim, a struct.

    claim has place (from 1), thing (as given in things, in the singular or the plural of the text), lo and hi (equal, but for "10–15" and
    "at least 8", which has no hi, or "up to 5", which has no lo), approximate ("roughly 30") and phrase, as written.  Numbers are digits
    or words up to ninety-nine; up to three words may stand between a number and its thing ("8 Australian companies").  A
    null text, or one without a claim, gives no row; a column of df named claim is replaced.
    """
    thing = "|".join(things)
    number = rf"(?:{_DIGITS}|\b{_WORDS}\b)"
    # another number between a number and the thing means that the first one counts something else
    pattern = rf"(?i)((?:{_ABOUT}\s*|\bat least\s|\bmore than\s|\bup to\s|\bat most\s)?)(?<![0-9.,$£€#-])({number})(?:\s?(?:[–-]|to)\s?({number}))?((?:\s(?!{number})[\p{{L}}-]+){{0,3}}?)\s({thing})\b"
    rows = df.select(F.struct("*").alias("_row"), F.posexplode(F.regexp_extract_all(F.regexp_replace(text, r"\*\*", ""), F.lit(pattern), F.lit(0))).alias("_at", "_phrase"))
    part = lambda i: F.regexp_extract("_phrase", pattern, i)
    lead = F.lower(F.trim(part(1)))
    lo, hi = _number(part(2)), F.when(part(3) != "", _number(part(3)))
    over, under = lead.isin("at least", "more than"), lead.isin("up to", "at most")
    lo = F.when(lead == "more than", lo + 1).otherwise(lo)
    claim = F.struct((F.col("_at") + 1).alias("place"), F.lower(part(5)).alias("thing"), F.when(~under, lo).alias("lo"), F.when(~over, F.coalesce(hi, _number(part(2)))).alias("hi"), ((lead != "") & ~over & ~under).alias("approximate"), F.trim(F.col("_phrase")).alias("phrase"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != "claim"], claim.alias("claim"))


def reconcile(stated: DataFrame, counted: DataFrame, on: list[str], tolerance: float = 0.1) -> DataFrame:
    """(on..., claim's fields, counted, verdict): each claim beside the count of its subject, and counts that nothing states.

    stated has the columns on and claim; counted has on and counted.  verdict is agrees (the count is within [lo, hi], or
    within tolerance of it for an approximate claim), differs, uncounted (no count) or unstated (no claim).  Of
    several claims of one subject each is judged.  Null subjects are never joined.
    """
    both = stated.select(*on, "claim").join(counted.select(*on, "counted"), on, "full")
    c, n = F.col("claim"), F.col("counted")
    give = F.when(c["approximate"], tolerance).otherwise(0.0)
    fits = F.coalesce(n >= c["lo"] * (1 - give), F.lit(True)) & F.coalesce(n <= c["hi"] * (1 + give), F.lit(True))
    verdict = F.when(c.isNull(), "unstated").when(n.isNull(), "uncounted").when(fits, "agrees").otherwise("differs")
    return both.select(*on, c["lo"].alias("lo"), c["hi"].alias("hi"), c["approximate"].alias("approximate"), n.cast("long").alias("counted"), verdict.alias("verdict"))
