"""Operations on lists of companies or other entries: conform, classify, qualify, convert, compare, refresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Confidence levels from the surest on.
LEVELS = ("High", "Med", "Low")


def conform(sections: list[tuple[DataFrame, dict[str, str], dict[str, Column]]]) -> DataFrame:
    """One list of several sections: each has its columns renamed and constants added; columns that it lacks are null."""
    parts = [df.withColumnsRenamed(names).withColumns(constants) if constants else df.withColumnsRenamed(names) for df, names, constants in sections]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def confidence_rank(level: Column) -> Column:
    """3, 2, 1 of High, Med, Low; null of anything else."""
    return reduce(lambda c, i: c.when(level == LEVELS[i], len(LEVELS) - i), range(1, len(LEVELS)), F.when(level == LEVELS[0], len(LEVELS)))


def qualifies(revenue: Column, low: float, high: float, round_amount: Column, most: float, closed: Column, since: Column, until: Column) -> Column:
    """Three-valued: revenue within [low, high], or a round under most that closed in [since, until]; null where neither is known to hold and one isn't known."""
    return revenue.between(low, high) | ((round_amount < most) & closed.between(since, until))


def convert(df: DataFrame, amount: str, currency: str, rates: DataFrame, out: str) -> DataFrame:
    """Adds out: amount at rates (currency, rate); null where there is no rate, no currency or no amount.  Spark broadcasts rates if they are small.

    Of repeated rates of a currency the largest counts; a column of df named out is replaced.
    """
    one = rates.where("currency is not null").groupBy("currency").agg(F.max("rate").alias("_convert_rate")).withColumnRenamed("currency", "_convert_currency")
    joined = df.join(one, F.col(currency) == F.col("_convert_currency"), "left").withColumn(out, F.col(amount) * F.col("_convert_rate"))
    return joined.drop("_convert_rate", "_convert_currency")


def strict(df: DataFrame, caveats: DataFrame, key: str) -> DataFrame:
    """Rows without a caveat."""
    return df.join(caveats.select(key), key, "left_anti")


def with_caveats(df: DataFrame, caveats: DataFrame, key: str) -> DataFrame:
    """df with caveats, the sorted different classes of each row's key in caveats (key, class); an empty array where there are none."""
    classes = caveats.groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("caveats"))
    return df.join(classes, key, "left").withColumn("caveats", F.coalesce("caveats", F.array().cast("array<string>")))


def flagged(df: DataFrame, flag: Column, out: str = "weak") -> DataFrame:
    """df with out: whether flag holds; a flag that isn't known doesn't."""
    return df.withColumn(out, F.coalesce(flag, F.lit(False)))


def levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(level, in_any, in_all, ...) for each level: rows that have it in any of columns, in all of them, and in each."""
    sums = []
    for level in LEVELS:
        has = [F.coalesce(F.col(c) == level, F.lit(False)) for c in columns]
        each = [F.count_if(h).alias(c) for h, c in zip(has, columns, strict=True)]
        sums.append(F.struct(F.lit(level).alias("level"), F.count_if(reduce(lambda a, b: a | b, has)).alias("in_any"), F.count_if(reduce(lambda a, b: a & b, has)).alias("in_all"), *each))
    return df.agg(F.array(*sums).alias("s")).select(F.inline("s"))


def after(year: Column, as_of: int) -> Column:
    """Whether a period such as "2026" or "FY26" ends after the year as_of; null where none is named."""
    number = F.regexp_extract(year, r"([0-9]{2,4})", 1).try_cast("int")
    return F.when(number < 100, number + 2000).otherwise(number) > as_of


def against_ranges(df: DataFrame, group: str, targets: DataFrame) -> DataFrame:
    """(group, lo, hi, delivered, gap) of each group of df or targets (group, lo, hi); gap is 0 within the range, else how far below or above it.

    A target without bounds is for the remainder: what all rows leave beside the others' ranges.  Groups without a
    target have no bounds and no gap; rows without a group are a group that meets no target.  targets is small, a row a
    group, and its figures go to one task.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("delivered"))
    everything = W.partitionBy()
    rows = targets.withColumn("_range_given", F.lit(True)).join(counts, group, "full").withColumn("delivered", F.coalesce("delivered", F.lit(0).cast("long")))
    total = F.sum("delivered").over(everything)
    rest = F.col("_range_given") & F.col("lo").isNull() & F.col("hi").isNull()
    lo = F.when(rest, F.greatest(F.lit(0), total - F.sum("hi").over(everything))).otherwise(F.col("lo"))
    hi = F.when(rest, F.greatest(F.lit(0), total - F.sum("lo").over(everything))).otherwise(F.col("hi"))
    rows = rows.select(group, lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), "delivered")
    gap = F.when(F.col("delivered") < F.col("lo"), F.col("delivered") - F.col("lo")).when(F.col("delivered") > F.col("hi"), F.col("delivered") - F.col("hi"))
    return rows.withColumn("gap", F.coalesce(gap, F.when(F.col("lo").isNotNull() | F.col("hi").isNotNull(), 0)).cast("long"))


def against_target(df: DataFrame, group: str, target: DataFrame) -> DataFrame:
    """(group, target, delivered, gap) of each group of df or target (group, target).

    Groups without rows deliver 0; those without a target have no gap; rows without a group count as a group of their own, which never
    meets a target.  A target that is given twice gives two rows.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("delivered"))
    joined = target.join(counts, group, "full")
    delivered = F.coalesce("delivered", F.lit(0))
    return joined.select(group, "target", delivered.alias("delivered"), (delivered - F.col("target")).alias("gap"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, present, distinct_values) of each column; the table is read once, and its rows are spread once a column to count values.

    Nulls are neither present nor distinct values; repeated rows each count; an empty table has zeros.
    """
    sums = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("present"), F.countDistinct(c).alias("distinct_values")) for c in columns]
    return df.agg(F.array(*sums).alias("s")).select(F.inline("s"))


def refresh(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes, which replace those of the same key: one shuffle, by key.

    Of several changes of a key, or rows of base, that with the largest values counts, column by column; history.merge
    orders them by a version.  A null key is one key; changes must have the columns of base, others are left out.
    """
    values = F.struct(*[c for c in base.columns if c != key])
    both = base.select(key, F.struct(F.lit(0).alias("n"), values.alias("v")).alias("_refresh_row")).unionByName(changes.select(key, F.struct(F.lit(1).alias("n"), values.alias("v")).alias("_refresh_row")))
    return both.groupBy(key).agg(F.max("_refresh_row").alias("_refresh_row")).select(key, "_refresh_row.v.*").select(*base.columns)
