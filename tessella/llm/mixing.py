"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A document's hash has 60 bits; each level of the histogram takes BITS of them, LEVELS levels in all.
HASH_BITS, BITS, LEVELS = 60, 12, 3


def _hash(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources has _source and source_size; adds target.

    Sources in order of _source take the weights in turn.  share * (sum of sizes) is dealt out by weight; a
    source above most times its size stops there, and the excess is dealt again.  In closed form: by rising
    size / weight, a source stops if the level left by those before it exceeds its own bound.
    This works on one row a source, some 60 bytes each, in one task.
    """
    rank = F.row_number().over(W.orderBy("_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("_cap") / F.col("_weight"), "_source").rowsBetween(W.unboundedPreceding, -1)
    sources = sources.withColumn("_weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    sources = sources.withColumn(
        "_level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(order), F.lit(0.0)))
        / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(order), F.lit(0))),
    )
    level = F.max(F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.col("_level"))).over(everything)
    return sources.select("_source", "source_size", F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), level * F.col("_weight")).otherwise(F.col("_cap")).alias("target"))


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's key, size (words), source_size, target (its source's), copies and taken = copies * size.

    Every document is taken floor(target / source_size) times, those with a hash below their source's
    threshold once more.  The threshold comes from sums of sizes by source and hash bucket; each further level
    splits the boundary bucket alone.  The last boundary bucket goes in if that is nearer the target.
    The hash is of the key, so reruns and other layouts agree.

    A null or empty text has size 0 and moves nothing; a null source is a source of its own, last in order;
    a null key is hashed as empty; repeated rows have one hash and stand or fall together; an empty table gives
    none.  keep names further columns to carry, whatever their names but those of the result (they are written once,
    with the slim rows).
    """
    taken = {key, "size", "source_size", "target", "copies", "taken"}
    if taken & set(keep):
        raise ValueError(f"the result has columns of these names: {sorted(taken & set(keep))}")
    scratch = Scratch(df.sparkSession)
    slim = df.select(
        F.col(key).alias("_key"), F.struct(F.lit(0).alias("_"), *keep).alias("_kept"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t")).alias("_source"), _hash(key).alias("_hash"),
    )
    slim = materialize(slim, "mix")
    sizes = slim.groupBy("_source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets(sizes, weights, share, most).withColumn("_whole", whole)
    plan = plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = scratch.materialize(plan.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")).withColumn("_in", F.lit(0).cast("long")), "mix-plan")
    for level in range(1, LEVELS + 1):
        unit = 1 << (HASH_BITS - BITS * level)
        bucket = F.floor(F.col("_hash") / F.lit(unit)) if unit > (1 << 53) else F.shiftright("_hash", HASH_BITS - BITS * level)
        sums = (
            slim.withColumn("_bucket", bucket)
            .join(plan.select("_source", "_prefix", "_before", "_rest"), "_source")
            .where(F.shiftright("_bucket", BITS) == F.col("_prefix"))
            .groupBy("_source", "_bucket")
            .agg(F.sum("size").alias("_n"), F.first("_before").alias("_base"), F.first("_rest").alias("_goal"))
        )
        upto = F.col("_base") + F.sum("_n").over(W.partitionBy("_source").orderBy("_bucket"))
        edge = (
            sums.withColumn("_upto", upto)
            .where(F.col("_upto") > F.col("_goal"))
            .groupBy("_source")
            .agg(F.min_by(F.struct("_bucket", "_upto", "_n"), "_bucket").alias("_e"))
        )
        last = F.lit((1 << (BITS * level)) - 1).cast("long")  # no bucket goes beyond the target: take them all
        plan = plan.join(edge, "_source", "left").select(
            "_source", "source_size", "target", "_whole", "_rest",
            F.coalesce(F.col("_e._bucket"), last).alias("_prefix"),
            F.coalesce(F.col("_e._upto") - F.col("_e._n"), F.col("source_size")).cast("long").alias("_before"),
            F.coalesce(F.col("_e._n"), F.lit(0)).cast("long").alias("_in"),
        )
        plan = (materialize if level == LEVELS else scratch.materialize)(plan, f"mix-level{level}")
    scratch.drop()
    nearer = (F.col("_in") == 0) & (F.col("_rest") > 0) | (F.col("_before") + F.col("_in") - F.col("_rest") < F.col("_rest") - F.col("_before"))
    plan = plan.withColumn("_limit", F.col("_prefix") + F.when(nearer, 1).otherwise(0))
    more = F.when(F.shiftright("_hash", HASH_BITS - BITS * LEVELS) < F.col("_limit"), 1).otherwise(0)
    return (
        slim.join(plan.select("_source", "source_size", "target", "_whole", "_limit"), "_source")
        .withColumn("copies", (F.col("_whole") + more).cast("long"))
        .select(F.col("_key").alias(key), *(F.col("_kept")[c].alias(c) for c in keep), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
