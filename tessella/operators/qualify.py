"""The qualification rule decided from free-text cells: yearly revenue within a band, or a closed round under a cap within a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import cells, intervals, money


def _rate(currency: Column, rates: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), currency)


def qualify(df: DataFrame, key: str, revenue: str, funding: str, rates: dict[str, float], band: tuple[float, float], cap: float, since: str, until: str, prefer: float) -> DataFrame:
    """(key, revenue_in_band, round_in_window, qualifies, preferred) of each key: true, false, or null where the cells don't say.

    revenue_in_band holds if some figure for one year (annual, annualised, arr) is inside band, as a whole interval at the
    rates; it is false if all such figures are outside, null if there is none or none decides.  round_in_window holds if some
    amount raised (not sought, a valuation, a grant, a sum to date, or an amount said again in another currency) is less
    than cap and its days lie within [since, until]; it is false if no round can, or the cell says that there was none.
    qualifies is either; preferred, a yearly figure under prefer, is no condition.  A missing rate makes an amount unknown.

    Each different cell is read once, and what it says joined to its rows; rows of one key count together (repeated rows change nothing).  A null key is a
    key like others; null, empty and missing cells are unknown; an empty table gives no rows; other columns are left out.
    """
    rows = df.select(F.col(key).alias("key"), F.col(revenue).alias("revenue"), F.col(funding).alias("funding"))

    def scaled(fact: Column, end: str) -> Column:
        return fact[end].cast("double") * _rate(fact["currency"], rates)

    def verdicts(cell: str, role: str) -> DataFrame:
        # facts that don't count stay as rows that say nothing: a filter on them would be evaluated beside each of its parts
        # each different cell is read once, however many rows have it
        f = F.col("fact")
        different = rows.select(cell).where(F.col(cell).isNotNull()).distinct()
        facts = money.money_facts(different, cell, role, rates)
        lo, hi = scaled(f, "lo"), scaled(f, "hi")
        if role == "revenue":
            counts = F.coalesce((f["role"] == role) & f["basis"].isin(*money.YEARLY), F.lit(False))
            said = facts.select(cell, F.when(counts, intervals.inside(lo, hi, F.lit(band[0]), F.lit(band[1]))).alias("in_band"), F.when(counts, intervals.below(lo, hi, F.lit(prefer))).alias("small"), counts.alias("has_revenue"))
            return rows.select("key", cell).join(said, cell).drop(cell)
        counts = (f["role"] == role) & ~F.coalesce(f["restates"], F.lit(False))
        closed = intervals.inside(f["begins"], f["ends"], F.lit(since).cast("date"), F.lit(until).cast("date"))
        said = facts.select(cell, F.when(counts, intervals.below(lo, hi, F.lit(cap)) & closed).alias("in_window"), counts.alias("has_round"))
        never = different.where(cells.status(F.col(cell)) == "none").select(cell, F.lit(False).alias("never"))
        return rows.select("key", cell).join(said.unionByName(never, allowMissingColumns=True), cell).drop(cell)

    # an entry's own row says that it is there; the rows of what its cells say tell the rest
    own = rows.select("key", F.lit(True).alias("own"))
    every = own.unionByName(verdicts("revenue", "revenue"), allowMissingColumns=True).unionByName(verdicts("funding", "raised"), allowMissingColumns=True)

    def among(column: str, has: str) -> Column:
        return F.when(F.coalesce(F.bool_or(column), F.lit(False)), True).when(F.count_if(F.col(has)) == F.count_if(F.col(has) & F.col(column).isNotNull()), F.bool_or(column))

    found = every.groupBy("key").agg(among("in_band", "has_revenue").alias("revenue_in_band"), F.coalesce(among("in_window", "has_round"), F.when(F.count_if("has_round") == 0, F.bool_or("never"))).alias("round_in_window"), among("small", "has_revenue").alias("preferred"))
    return found.select(F.col("key").alias(key), "revenue_in_band", "round_in_window", (F.col("revenue_in_band") | F.col("round_in_window")).alias("qualifies"), "preferred")
