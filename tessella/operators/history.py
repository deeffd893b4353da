"""A list that is drawn up again and again: validity intervals of its entries, and what changed each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _single(lists: DataFrame, key: str, as_of: str, order: Column | None, values: list[str]) -> DataFrame:
    """One row for each key of each list: of repeated ones the last by order, then by values; whether they differed."""
    last = F.struct(*([order.alias("_o")] if order is not None else []), *[F.col(c) for c in values])
    rows = lists.where(F.col(as_of).isNotNull() & F.col(key).isNotNull())
    found = rows.groupBy(F.col(as_of).alias("_t"), F.col(key).alias("_k")).agg(F.max(last).alias("_v"), (F.min(F.struct(*values)) != F.max(F.struct(*values))).alias("_torn"))
    return found.select("_t", "_k", F.struct(*[F.col("_v")[c].alias(c) for c in values]).alias("_v"), "_torn")


def _calendar(lists: DataFrame, as_of: str) -> DataFrame:
    """(t, after, before): each list's date with that of the next list and the one before; a row a list."""
    days = W.partitionBy(F.lit(0)).orderBy("_t")  # a row a list: as many as there were refreshes
    return lists.where(F.col(as_of).isNotNull()).select(F.col(as_of).alias("_t")).distinct().select("_t", F.lead("_t").over(days).alias("_after"), F.lag("_t").over(days).alias("_before"))


def validity(lists: DataFrame, key: str, as_of: str, values: list[str], order: Column | None = None) -> DataFrame:
    """(key, values..., valid_from, valid_to, ended, conflicting): one row for each stretch of lists in which a key has the same values.

    lists holds whole lists, a row for each entry of the list of a date, as_of.  A stretch is valid from its first list's date up
    to (not including) that of the next list after its last one; valid_to is null while it is in the newest list.  ended
    says why it stopped: changed, or vanished, where the next list lacks the key; null while it is valid.  A key that comes back begins a
    new stretch, with the same values or not.

    Of a key that a list has more than once, the row that is last by order counts, ties and no order by the largest values;
    conflicting says whether such rows differed in a list of the stretch.  Nulls are values like others; rows with a null key or date
    don't count; an empty table gives none; columns that aren't named are left out.  Work is spread by key; the dates alone
    are broadcast.
    """
    rows = _single(lists, key, as_of, order, values).join(F.broadcast(_calendar(lists, as_of)), "_t")  # a row a list
    own = W.partitionBy("_k").orderBy("_t")
    begins = ~(F.lag("_v").over(own).eqNullSafe(F.col("_v")) & F.lag("_t").over(own).eqNullSafe(F.col("_before")))
    rows = rows.withColumn("_begins", F.coalesce(begins, F.lit(True)) | F.lag("_t").over(own).isNull()).withColumn("_n", F.sum(F.col("_begins").cast("int")).over(own))
    found = rows.groupBy("_k", "_n").agg(F.first("_v").alias("_v"), F.min("_t").alias("valid_from"), F.max("_after").alias("_to"), F.max("_t").alias("_last"), F.bool_or("_torn").alias("conflicting"), F.max(F.struct("_t", "_after"))["_after"].alias("valid_to"))
    follow = F.lead("valid_from").over(W.partitionBy("_k").orderBy("valid_from"))
    found = found.withColumn("_follow", follow)
    ended = F.when(F.col("valid_to").isNotNull(), F.when(F.col("_follow") == F.col("valid_to"), "changed").otherwise("vanished"))
    return found.select(F.col("_k").alias(key), *[F.col("_v")[c].alias(c) for c in values], "valid_from", "valid_to", ended.alias("ended"), "conflicting")


def changes(lists: DataFrame, key: str, as_of: str, values: list[str], order: Column | None = None) -> DataFrame:
    """(as_of, key, change, columns): what each list but the first does to the one before it.

    change is added, removed or changed; columns names, sorted, those of values that changed (null for the others).
    Keys that stay as they are give no row.  Repeated and null keys are as in validity.
    """
    rows = _single(lists, key, as_of, order, values)
    days = _calendar(lists, as_of)
    now = rows.join(F.broadcast(days), "_t").where("_before is not null").select(F.col("_t").alias("_at"), "_k", F.col("_v").alias("_new"))
    then = rows.join(F.broadcast(days), "_t").where("_after is not null").select(F.col("_after").alias("_at"), "_k", F.col("_v").alias("_old"))
    both = now.join(then, ["_at", "_k"], "full").where(~F.col("_new").eqNullSafe(F.col("_old")))
    differ = F.array_compact(F.array(*[F.when(~F.col("_new")[c].eqNullSafe(F.col("_old")[c]), c) for c in sorted(values)]))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.select(F.col("_at").alias(as_of), F.col("_k").alias(key), change.alias("change"), F.when(change == "changed", differ).alias("columns"))


def merge(base: DataFrame, changed: DataFrame, key: str, version: str) -> DataFrame:
    """base with the rows of changed, the newest of each key: the largest version counts, of equal ones that of changed, then the largest values.

    Null versions are older than others; null keys are one key; columns are those of base, which changed must have; one
    shuffle, by key.
    """
    values = [c for c in base.columns if c != key]
    both = base.select("*", F.lit(0).alias("_merge_side")).unionByName(changed.select(*base.columns, F.lit(1).alias("_merge_side")))
    newest = both.groupBy(key).agg(F.max(F.struct(F.col(version).alias("_merge_version"), "_merge_side", F.struct(*values).alias("_merge_row"))).alias("_merge"))
    return newest.select(key, "_merge._merge_row.*").select(*base.columns)
