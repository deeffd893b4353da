"""Enrichment that fills only what is missing, and says where each value comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lists import LEVELS, confidence_rank


def enrich(df: DataFrame, key: str, columns: dict[str, str], found: DataFrame, own: str = "list", least: str = LEVELS[-1]) -> DataFrame:
    """df with, for each of columns, its value filled where it is missing, and <column>_source and <column>_confidence.

    columns maps each column to the one that holds its confidence.  found has the rows (key, column, value, source,
    confidence) of other sources.  A value that df has stays, with own as its source; a missing one takes the value of
    the surest source that has one (High before Med before Low), ties going to the first source, then the first value,
    in order; what is less sure than least, or of no known level, fills nothing.  Columns that stay missing have no source and no confidence.

    Rows of found with a null key, column or value don't count; a null key of df finds nothing; repeated rows of df are
    filled alike.  found is brought to one row for each key before it is joined; other columns of df are kept, those
    named like the new ones are replaced.
    """
    rank = confidence_rank(F.col("confidence"))
    sure = found.where(F.col(key).isNotNull() & F.col("value").isNotNull() & (rank >= (len(LEVELS) - LEVELS.index(least))) & F.col("column").isin(*columns))

    def best(c: str) -> Column:
        mine = F.col("column") == c
        return F.min(F.when(mine, F.struct((-rank).alias("r"), "source", "value", "confidence"))).alias(f"_best_{c}")

    one = sure.groupBy(F.col(key).alias("_enrich_key")).agg(*[best(c) for c in columns])
    out = df.join(one, F.col(key) == F.col("_enrich_key"), "left")
    new = {}
    for c, confidence in columns.items():
        has, other = F.col(c).isNotNull(), F.col(f"_best_{c}")
        new[f"_new_{c}"] = F.when(has, F.struct(F.col(c).cast("string").alias("value"), F.lit(own).alias("source"), F.col(confidence).alias("confidence"))).when(other.isNotNull(), F.struct(other["value"].cast("string").alias("value"), other["source"].alias("source"), other["confidence"].alias("confidence")))
    out = out.select("*", *[v.alias(n) for n, v in new.items()])
    made = {x for c in columns for x in (c, f"{c}_source", f"{c}_confidence")}
    kept = [F.col(c) for c in df.columns if c not in made]
    filled = [x for c in columns for x in (F.col(f"_new_{c}.value").cast(df.schema[c].dataType).alias(c), F.col(f"_new_{c}.source").alias(f"{c}_source"), F.col(f"_new_{c}.confidence").alias(f"{c}_confidence"))]
    return out.select(*kept, *filled)
