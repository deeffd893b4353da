"""Sharding by jump consistent hashing, with gapless slots, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Multiplier of the generator, 2**64, 2**33 and 2**31 (jump consistent hash, Lamping and Veach 2014).
MULTIPLIER, MODULUS, SHIFT, SCALE = 2862933555777941757, 2**64, 2**33, 2**31


def jump(key: str, n: int) -> Column:
    """struct(own, b): the buckets of the bigint expression key among n and among n + 1 buckets.

    The generator's state is kept as a decimal below 2**64, since a bigint product would overflow.
    A null key counts as 0.
    """
    if n < 1:
        raise ValueError("the number of shards must be positive")
    step = f"cast(pmod(s.k * {MULTIPLIER}BD + 1BD, {MODULUS}BD) as decimal(38,0))"
    return F.expr(
        f"aggregate(sequence(1, {n + 1}),"
        f" named_struct('k', cast(pmod(cast(coalesce({key}, 0L) as decimal(38,0)), {MODULUS}BD) as decimal(38,0)), 'b', -1L, 'j', 0L, 'own', -1L),"
        f" (s, i) -> if(s.j > {n}, s, named_struct('k', {step}, 'b', s.j,"
        f" 'j', cast(floor((s.j + 1) * ({SCALE}D / (({step}) div {SHIFT}BD + 1))) as bigint),"
        f" 'own', if(s.j < {n}, s.j, s.own))))"
    )


def assign_shards(df: DataFrame, n: int, key: str = "doc_id", text: str = "text", parts: int = 256) -> DataFrame:
    """Each row's key, size, text_crc32, law, shard, slot and grown_shard (its shard if there were n + 1).

    The key and n alone decide the shard; appending a shard moves rows into the new one only.  Keys other than
    integers are hashed first.  A null text has size 8 and the checksum of the empty text; a null key counts
    as 0; repeated rows each get a slot; an empty table gives none; other columns are left out.

    Slots are numbered in parts groups of a shard (key plus checksum, modulo parts), by key, checksum and size in
    each, so that a large shard, or one key with many texts, doesn't meet in one task; row_number() streams, so
    memory is bounded in any case.  Only the groups' counts, at most n * parts rows, are broadcast.
    """
    kind = dict(df.dtypes)[key]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    slim = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.lit(0)).alias("_k"),
    ).withColumn("_jump", jump("_k", n))
    slim = slim.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), F.col("_jump.own").cast("int").alias("shard"), F.col("_jump.b").cast("int").alias("grown_shard"),
        F.pmod(F.col("text_crc32") + F.pmod("_k", F.lit(parts)), F.lit(parts)).cast("int").alias("_part"),
    )
    slim = materialize(slim, "shards")
    counts = slim.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_part", (F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    in_part = F.row_number().over(W.partitionBy("shard", "_part").orderBy(key, "text_crc32", "size")) - 1
    return (
        slim.withColumn("_in", in_part)
        .join(F.broadcast(before), ["shard", "_part"])
        .select(key, "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_in")).cast("long").alias("slot"), "grown_shard")
    )
