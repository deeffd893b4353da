"""Names that prose mentions, resolved to the entries of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import parts

#: Letters with marks and the plain ones, and words of a firm's form that a name may lack.
_MARKED, _LETTERS = "àáâãäåāçćčèéêëēėęìíîïīñńòóôõöøōśšùúûüūýÿžźż", "aaaaaaaccceeeeeeeiiiiinnooooooossuuuuuyyzzz"
FORMS = r"pty|ltd|limited|inc|co|company|llc|gmbh|plc|corp|corporation|sa|ag"


def normal(name: Column) -> Column:
    """A name as words of plain lower-case letters and digits, single spaces between, without brackets and a firm's form at its end; null without a letter or digit."""
    text = F.lower(F.regexp_replace(name, r"\([^()]*\)", " "))
    text = F.translate(F.regexp_replace(text, "&", " and "), _MARKED, _LETTERS)
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"['’.]", ""), r"[^\p{L}\p{N}]+", " "))
    return F.nullif(F.trim(F.regexp_replace(text, rf"(?<=.)(?:\s(?:{FORMS}))+$", "")), F.lit(""))


def listed(df: DataFrame, text: str, out: str = "mention") -> DataFrame:
    """A row for each name in the lists of a text: the columns of df and out.

    A list is what stands in a bracket, or, without one, the whole text.  Its names stand between commas and "and";
    words such as "arguably" before a name, and what an "at" or "with" adds behind it, are left out.  A null text has
    none.
    """
    cell = F.regexp_replace(F.col(text), r"\*\*", "")
    brackets = F.regexp_extract_all(cell, F.lit(r"\(([^()]*)\)"), F.lit(1))
    lists = F.when(F.size(brackets) > 0, brackets).otherwise(F.array(cell))
    items = F.flatten(F.transform(lists, lambda x: F.split(x, r",\s*(?:and\s+)?|\s+and\s+|;", -1)))
    items = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^(?:and\s+)?(?:(?:arguably|possibly|also|the)\s+)+", ""), r"(?i)\s+(?:at|with|from)\s.*$", "")))
    kept = [c for c in df.columns if c != out]
    return df.select(*kept, F.explode(F.filter(items, lambda x: x != "")).alias(out))


def resolve(mentions: DataFrame, mention: str, entries: DataFrame, key: str, name: str) -> DataFrame:
    """mentions with key, verdict and matches: the entry that each mention means.

    A mention and a name agree, best first, if they are equal (both in normal form), if it equals another name of the entry
    (from its brackets, or after " / "), if an entry's name stands within the mention as whole words (the longest
    name wins), or if the name begins with the mention.  The best agreement decides: verdict is resolved if one
    entry has it, ambiguous if more have (matches says how many; key is null), unmatched if none has.

    Pairs are found by equal names and, for the other two, by the rarest word of the name or of the mention: only entries with that
    word are looked at.  Null and empty mentions are unmatched; entries with a null key or name don't count; repeated mentions
    are answered alike; columns of mentions named like the three new ones are replaced.
    """
    plain = F.col("_m")
    asked = mentions.select(normal(F.col(mention)).alias("_m")).where(plain.isNotNull()).distinct()
    every = entries.where(F.col(key).isNotNull()).select(F.col(key).alias("_e"), F.explode(F.concat(
        F.array(F.struct(normal(parts.main_name(F.col(name))).alias("n"), F.lit(4).alias("rank"))),
        F.transform(F.coalesce(F.filter(parts.other_names(F.col(name)), lambda x: x["kind"] != "maker"), F.array()), lambda x: F.struct(normal(x["name"]).alias("n"), F.lit(3).alias("rank")))
    )).alias("x")).select("_e", "x.*").where("n is not null").groupBy("_e", "n").agg(F.max("rank").alias("rank"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    spread = every.select("_e", "n", F.explode(words(F.col("n"))).alias("w"))
    often = spread.groupBy("w").agg(F.count("*").alias("often"))
    rarest = spread.join(often, "w").groupBy("_e", "n").agg(F.min_by("w", F.struct("often", "w")).alias("w"))
    told = asked.select("_m", F.explode(words(plain)).alias("w"))
    least = told.join(often, "w").groupBy("_m").agg(F.min_by("w", F.struct("often", "w")).alias("w"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))

    equal = asked.join(every, plain == F.col("n")).select("_m", "_e", "rank", F.length("n").alias("size"))
    within = told.join(rarest, "w").where(spaced(plain).contains(spaced(F.col("n")))).select("_m", "_e", F.lit(2).alias("rank"), F.length("n").alias("size"))
    begins = least.join(spread, "w").where(spaced(F.col("n")).startswith(spaced(plain))).select("_m", "_e", F.lit(1).alias("rank"), F.lit(0).alias("size"))
    found = equal.union(within).union(begins).groupBy("_m", "_e").agg(F.max(F.struct("rank", "size")).alias("how"))
    best = found.groupBy("_m").agg(F.max("how").alias("how"))
    best = found.join(best, ["_m", "how"]).groupBy("_m").agg(F.count("*").alias("matches"), F.min("_e").alias("_e"))
    kept = [F.col(c) for c in mentions.columns if c not in (key, "verdict", "matches")]
    out = mentions.withColumn("_m", normal(F.col(mention))).join(best, "_m", "left")
    verdict = F.when(F.col("matches") == 1, "resolved").when(F.col("matches") > 1, "ambiguous").otherwise("unmatched")
    return out.select(*kept, F.when(F.col("matches") == 1, F.col("_e")).alias(key), verdict.alias("verdict"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


def repeated_names(entries: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, entries): keys whose main name, in normal form, other keys have too, and how many have it."""
    rows = entries.select(F.col(key), normal(parts.main_name(F.col(name))).alias("name")).where("name is not null").distinct()
    return rows.withColumn("entries", F.count("*").over(W.partitionBy("name"))).where("entries > 1")
