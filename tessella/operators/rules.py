"""Rules held against the rows of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import parts


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, rule, verdict): a row for each rule that a row breaks or that can't be decided for it.

    A rule is a pair (when, holds): it applies where when is true, and is broken there if holds is false; where holds
    is null, verdict is undecided.  A row to which no rule applies, or all that do hold, gives none.  Repeated rows are
    each judged; a null key is kept.  One pass, no shuffle.
    """
    each = [F.when(F.coalesce(when, F.lit(False)) & ~F.coalesce(holds, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.when(holds.isNull(), "undecided").otherwise("violated").alias("verdict"))) for rule, (when, holds) in rules.items()]
    return df.select(F.col(key).alias(key), F.inline(F.array_compact(F.array(*each))))


def dated(sources: Column, since: Column | None = None) -> Column:
    """Whether a cell of sources has one with a date (ending on or after since, if given); null for a missing cell."""
    found = parts.sources(sources)
    return F.exists(found, lambda s: s["ends"].isNotNull() if since is None else F.coalesce(s["ends"] >= since, F.lit(False)))


def named(value: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a value is one of those allowed; null is allowed."""
    return value.isNull() | value.isin(*allowed)
