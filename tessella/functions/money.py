"""Amounts of money in free-text cells: a cell is cut into clauses and amounts, and each amount is read with what its clause says.

The text between two amounts is divided at its strongest separator (a semicolon, a bracket that only one of the
amounts is in, " + " or " / ", a comma): what stands before it belongs to the first amount, the rest to the second.
Without a separator both may take from it, and the nearer word counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import periods
from .cells import CURRENCIES, known

#: Phrases that say which role an amount has, longer ones first.  Those of AHEAD stand before their amount only.
OPEN = r"(?:round|raise|seed|series [a-z])\s+(?:(?:is|now|still)\s+)?(?:open|underway|in progress)|open (?:round|raise)"
ROLES = (("raised to date|total raised|raised in total", "raised_to_date"), (OPEN + "|sought|target", "sought"), ("pre-money|post-money|valuation|valued", "valuation"), ("grants?", "grant"), ("revenue|turnover|sales", "revenue"), ("raised|raise|round|pre-seed|seed|series|equity|funding|financing", "raised"))
AHEAD = (("seeking|raising|targeting|considering", "sought"),)
#: Those that count only in a cell that isn't of revenue by default.
LOOSE = (("to date|in total|total", "raised_to_date"),)
#: Words that say what time a revenue figure stands for.
BASES = (
    ("forecast|project|expected|on track|tracking|budget", "forecast"), ("annualised|annualized|run[- ]rate", "annualised"), (r"arr\b", "arr"), (r"year to date|ytd\b|[0-9]+\s?mo(?:nths?)?\s(?:of\s)?fy", "ytd"),
    (r"cumulative|lifetime|since|to date|in total|(?:within|over|in)\s+[0-9]+\s+(?:months|years|yrs)|[0-9]+\s?(?:yrs|years)\b", "cumulative"), (r"annual|per year|p\.a\.|fy|prior|previous|last year", "annual"),
)
#: Bases of figures that stand for one year, so that a band of yearly revenue can be held against them.
YEARLY = ("annual", "annualised", "arr")
#: Marks of a lower bound, an upper bound, and of a figure that isn't exact.
_OVER, _UNDER, _ABOUT = r"(?i)(?:>|\bover|\bmore than|\bat least|\babove)\s*~?\s*$", r"(?i)(?:<|\bup to|\bunder|\bless than|\bat most|\bbelow)\s*~?\s*$", r"(?i)(?:~|≈|\bc\.|\babout|\bapprox\.?|\baround|\bsome|\broughly)\s*$"
#: What stands between an amount and the same one in another currency.
_AGAIN = r"(?i)^\s*(?:/|\(|=|≈|or|i\.e\.)\s*(?:~|≈|about|approx\.?)?\s*$"
#: Figures in words, and the digits that they have.
FIGURES = {"five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}

_MARK, _NUMBER, _UNIT = r"NZ\$|US\$|A\$|C\$|\$|£|€", r"[0-9][0-9,]*(?:\.[0-9]+)?", r"[kK]|[mM](?:illion|n)?|[bB](?:illion|n)?"
_AMOUNT = (
    rf"(?:({_MARK})\s?({_NUMBER})(?:\s?({_UNIT})(?![A-Za-z]))?(?:\s?(?:[-–]|to)\s?(?:(?:{_MARK})\s?({_NUMBER})(?:\s?({_UNIT})(?![A-Za-z]))?|({_NUMBER})\s?({_UNIT})(?![A-Za-z])))?"
    rf"|(?i:\b(near[- ])?({'|'.join(FIGURES)})[- ]figures?\b))"
)


def _any(names: tuple[tuple[str, str], ...]) -> str:
    """A pattern for any of the phrases; they begin where a word does, so it is tried there only."""
    return rf"(?i)\b(?:{'|'.join(p for p, _ in names)})"


def _named(word: Column, names: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(names):
        out = F.when(word.rlike(_any(((pattern, name),))), F.lit(name)).otherwise(out)
    return out


def _looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() if pair[1] is not None for x in pair]), key)


def _groups(amount: Column) -> Column:
    """What the groups of an amount hold, as an array: the expressions that use it then evaluate one pattern only."""
    return F.split(F.regexp_replace(amount, _AMOUNT, "|".join(f"${i}" for i in range(1, 10))), r"\|", -1)


def _value(groups: Column) -> tuple[Column, Column, Column]:
    """Currency, and the ends of what an amount says by itself."""
    group = lambda n: F.get(groups, n - 1)
    high, unit_high = F.concat(group(4), group(6)), F.concat(group(5), group(7))
    unit_low = F.when(group(3) != "", group(3)).otherwise(unit_high)
    number = lambda x, unit: (F.regexp_replace(x, ",", "").try_cast("double") * F.coalesce(_looked_up({"k": 1e3, "m": 1e6, "b": 1e9}, F.lower(F.substring(unit, 1, 1))), F.lit(1.0))).cast("decimal(18,2)")
    digits, near = _looked_up(FIGURES, F.lower(group(9))), F.when(group(8) != "", 1).otherwise(0)
    words = lambda of: F.pow(F.lit(10.0), digits - of - near).cast("decimal(18,2)")
    lo = F.when(group(9) != "", words(1)).otherwise(number(group(2), unit_low))
    hi = F.when(group(9) != "", words(0) - F.when(near == 0, 1).otherwise(0)).when(high != "", number(high, unit_high)).otherwise(lo)
    return _looked_up(CURRENCIES, group(1)), lo, hi


#: The strongest separator's last place: a semicolon, a bracket, " + " or " / ", a comma.
_CUT = r"(?s)^(.*);(.*)$|^(.*)(?:[()]|\s[+/]\s)(.*)$|^(.*),\s(.*)$"


def _cut(gap: Column) -> Column:
    """What of the text between two amounts belongs to the first, a mark, and what belongs to the second; all of it to both without a separator."""
    masked = F.regexp_replace(gap, r"\(([^()]*)\)", "\u0003$1\u0004")  # brackets that open and close in it divide nothing
    return F.regexp_replace(masked, _CUT, "$1$3$5\u0006$2$4$6")


def _once(value: Column, of) -> Column:
    """of(value), which evaluates value once however often it uses it; a projection with it is compiled in small parts, which large ones aren't."""
    return F.transform(F.array(value), of)[0]


def money_facts(df: DataFrame, cell: str, role: str = "raised", rates: dict[str, float] | None = None, tolerance: float = 0.1, fiscal: int = periods.FISCAL) -> DataFrame:
    """A row for each amount in the cells of a column, in their order: the columns of df and one more, fact, a struct.

    fact has place (from 1); role: by the nearest phrase of its clause, else role, the column's own (so a revenue
    column's bare amounts are revenue); basis: what time a revenue stands for (annual, annualised, arr, ytd, cumulative,
    forecast, unknown); currency, null for a bare "$"; lo and hi, the ends of what is said (">A$1M" and "A$1M+" have no hi, "up to
    A$1M" no lo, a plain amount has two equal ends, "seven figures" those of seven digits); approximate, of what is no exact figure, bounds among them; period, as written, and
    begins and ends, its days (of an amount without its own, that of the amounts beside it in its clause, but revenue takes
    none); restates: whether it says the amount before it again in another currency ("US$22M / £17M"), by rates and
    tolerance, null where a rate is missing.

    A null, empty or missing cell ("Not disclosed") gives no row, nor does one without an amount; repeated rows give
    repeated facts; a column of df named fact is replaced.  Each row is read by itself: nothing is shuffled.
    """
    every, behind = (*AHEAD, *ROLES), ROLES
    if role != "revenue":
        every, behind = (*every, *LOOSE), (*behind, *LOOSE)
    text = F.regexp_replace(F.coalesce(known(F.col(cell)), F.lit("")), r"\*\*", "")
    rows = df.select(F.struct("*").alias("_row"), F.split(F.regexp_replace(text, _AMOUNT, "\u0001$0\u0002"), "\u0001").alias("_pieces"))
    rows = rows.where(F.size("_pieces") > 1).select("_row", "_pieces", F.posexplode("_pieces").alias("_place", "_piece")).where("_place > 0")
    own, rest = F.substring_index("_piece", "\u0002", 1), F.substring_index("_piece", "\u0002", -1)
    following = F.substring_index(F.get("_pieces", F.col("_place") + 1), "\u0002", -1)

    def previous(text: Column) -> Column:
        gap = F.substring_index(text, "\u0002", -1)
        return F.struct(gap.alias("gap"), F.when((F.col("_place") > 1) & gap.rlike(_AGAIN), _groups(F.substring_index(text, "\u0002", 1))).alias("last"))

    rows = rows.select("_row", "_place", _groups(own).alias("_own"), rest.alias("_rest"), _once(F.get("_pieces", F.col("_place") - 1), previous).alias("_p"), following.alias("_next"))
    rows = rows.select("_row", "_place", "_own", "_rest", "_next", F.col("_p.gap").alias("_gap"), F.col("_p.last").alias("_last"))
    masked = F.regexp_replace("_rest", r"\(([^()]*)\)", "\u0003$1\u0004")
    after = F.when(F.col("_next").isNull(), F.regexp_extract(masked, r"(?s)^([^;]*)", 1)).otherwise(F.substring_index(_cut(F.col("_rest")), "\u0006", 1))
    first = F.regexp_extract("_gap", r"(?s)([^;(]*)$", 1)
    rows = rows.withColumns({"_after": after, "_before": F.when(F.col("_place") > 1, F.substring_index(_cut(F.col("_gap")), "\u0006", -1)).otherwise(first)})

    # the phrases nearest to the amount: the last one before it, and the first one after it
    b, a = F.col("_before"), F.col("_after")
    first = F.regexp_extract(a, _any(behind), 0)
    rows = rows.withColumns({"_marked": F.regexp_replace(b, f"({_any(every)})", "\u0006$1\u0007"), "_right": F.when(first != "", F.struct(first.alias("phrase"), (F.instr(a, first) - 1).alias("far")))})
    last = lambda t: F.when(t.contains("\u0006"), F.struct(F.substring_index(F.substring_index(t, "\u0006", -1), "\u0007", 1).alias("phrase"), F.length(F.substring_index(t, "\u0007", -1)).alias("far")))
    nearer = lambda x: F.when(F.col("_right").isNull() | (x["far"] < F.col("_right.far")), x["phrase"]).otherwise(F.col("_right.phrase"))
    phrase = _once(last(F.col("_marked")), nearer)
    yearly = F.when(a.rlike(_any(BASES)), a).otherwise(b)
    own_period = F.coalesce(periods.words(a), periods.words(b))
    beside = F.coalesce(F.when(~F.col("_rest").contains(";"), periods.words(F.substring_index("_next", ";", 1))), F.when((F.col("_place") > 1) & ~F.col("_gap").contains(";"), periods.words(F.col("_gap"))))
    over, under = b.rlike(_OVER) | a.startswith("+"), b.rlike(_UNDER)
    about = b.rlike(_ABOUT) | a.rlike(r"(?i)^[^;,]{0,3}\(?est\b") | over | under
    rows = rows.select("_row", "_place", "_own", "_last", "_gap", phrase.alias("_phrase"), yearly.alias("_yearly"), own_period.alias("_named"), beside.alias("_beside"), over.alias("_over"), under.alias("_under"), about.alias("_about"))
    rows = rows.withColumn("_role", F.coalesce(_named(F.col("_phrase"), every), F.lit(role)))
    rows = rows.withColumn("_period", F.coalesce("_named", F.when(F.col("_role") != "revenue", F.col("_beside"))))
    rows = rows.withColumn("_groups", periods.groups(F.col("_period")))

    value = _once(F.col("_own"), lambda g: F.struct(*(c.alias(n) for c, n in zip(_value(g), ("code", "lo", "hi"), strict=True))))
    basis = F.when(F.col("_role") == "revenue", F.coalesce(_named(F.col("_yearly"), BASES), F.when(F.col("_period").isNotNull(), "annual").otherwise("unknown")))
    rows = rows.withColumns({"_value": value, "_basis": basis, "_span": _once(F.col("_groups"), lambda g: periods.from_groups(g, fiscal))})
    rows = rows.withColumns({"_code": F.col("_value.code"), "_lo": F.col("_value.lo"), "_hi": F.col("_value.hi")})
    fact = F.struct(
        F.col("_place").alias("place"), F.col("_role").alias("role"), F.col("_basis").alias("basis"), F.col("_code").alias("currency"), F.when(~F.col("_under"), F.col("_lo")).alias("lo"), F.when(~F.col("_over"), F.col("_hi")).alias("hi"),
        F.col("_about").alias("approximate"), F.col("_period").alias("period"), F.col("_span")["from"].alias("begins"), F.col("_span")["to"].alias("ends"), _once(F.col("_last"), lambda g: _restates(g, rates or {}, tolerance)).alias("restates"),
    )
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c != "fact"]
    return rows.select(*kept, fact.alias("fact"))


def _restates(last: Column, rates: dict[str, float], tolerance: float) -> Column:
    """Whether the amount says the one before it (last, where nothing but a sign of that is between them) again: another currency, and values that agree at the rates."""
    code, lo, _ = _value(last)
    between = F.coalesce(last.isNotNull() & (code != F.col("_code")), F.lit(False))
    if not rates:
        return F.when(~between, False)
    one, other = lo.cast("double") * _looked_up(rates, code), F.col("_lo").cast("double") * _looked_up(rates, F.col("_code"))
    return F.when(~between, False).otherwise(F.abs(one - other) <= tolerance * F.greatest(one, other))
