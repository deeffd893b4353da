"""Connected components by alternating star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds after which a graph that still changes is an error; each round at least halves the longest paths.
MOST_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of each node that has an edge, root being the smallest node it reaches.

    edges has two columns of one orderable type, a and b.  Each round links every neighbour of a node to the
    smallest of them (first the larger ones, then the smaller ones) and is written to the shared folder; only two
    figures come to the driver.  A node with very many edges is pre-aggregated by its minimum, and the join that
    hands it out is one that Spark splits.  Loops, repeated edges and nulls don't count; no edges give no rows.
    The last table goes with scratch, or stays where none is given; those of the rounds before are removed.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    older = Scratch(edges.sparkSession)
    edges = older.materialize(edges, "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        round_ = Scratch(edges.sparkSession)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = round_.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = round_.materialize(small.where("u > v").distinct(), "edges")
        older.drop()
        older = round_
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == before:
            scratch.paths += older.paths
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("the components did not settle")
