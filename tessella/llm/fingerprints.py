"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs (lines, cut at PARAGRAPH code points so that short texts have several) are digested; each distinct digest goes into one cell of
each of three parts of a table, where counts are summed and digests and their checks xored.  Two tables subtract
cell by cell; peeling the cells that hold one digest recovers the digests that differ.  A pair that differs in few is peeled
in the difference of its fingerprints; for others tables are made as large as an estimate of the difference asks for.
Where peeling gets stuck, the pair is tried again with a larger table.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, materialize

#: Cells of a fingerprint.
CELLS = 48
#: A pair is peeled in a table of ROOM cells for each digest that, by the LEAST_DIGESTS least ones of both, differs, but CELLS at least:
#: that table is the difference of the fingerprints.  Where it fails, in one GROWTH times as large, TRIES times in all.
ROOM, GROWTH, TRIES, LEAST_DIGESTS = 3, 4, 6, 16
PARAGRAPH, ROUNDS = 120, 6
#: Digests in a task, about.
TASK_DIGESTS = 200_000
#: Documents in a range of keys, about, and the most ranges (their bounds, 8 bytes each, come to the driver).
RANGE_ROWS, MOST_RANGES = 4000, 1 << 16


#: Factors of the hashes by which digests go to cells of the three parts, and of the check: below 2 ** 31; and their modulus.
FACTORS, CHECK, MODULUS = ((1540483477, 668265263), (1181783497, 2024237689), (1266489917, 374761393)), (2146121005, 1367130551), (1 << 61) - 1


def paragraphs(text: str) -> Column:
    """Distinct digests of the paragraphs of a text that isn't null, rising: the first 60 bits of their MD5."""
    digest = lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH}}}"), F.lit(0)), digest)))


def _hashed(x: Column, factors: tuple[int, int]) -> Column:
    """A hash of 60 bits or fewer to 61, by two linear steps modulo a prime; no product or sum is beyond 63 bits."""
    a, b = factors
    y = (F.shiftright(x, 30) * a + x.bitwiseAND(F.lit((1 << 30) - 1)) * b) % MODULUS
    return (F.shiftright(y, 31) * b + y.bitwiseAND(F.lit((1 << 31) - 1)) * a) % MODULUS


def _constant(values: list, kind: str) -> str:
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def _ranges(df: DataFrame, key: str, order: str) -> Column:
    """A number for the range that a row's (key, order) is in, rising with them, by approximate quantiles of the key.

    The range is found by binary search.  A key that several quantiles fall on is split further, by order.
    """
    n = max(1, min(MOST_RANGES, -(-df.count() // RANGE_ROWS)))
    at = F.expr(_constant([i / n for i in range(1, n)], "double"))
    bounds = Counter(df.select(F.percentile_approx(key, at, F.lit(100 * n))).first()[0] or []) if n > 1 else {}
    if not bounds:
        return F.lit(0).cast("long")
    limits = sorted(bounds)
    steps = ", ".join(str(1 << i) for i in reversed(range(len(limits).bit_length())))
    index = f"aggregate(array({steps}), 0, (s, d) -> if(coalesce(try_element_at({_constant(limits, 'bigint')}, s + d) < `{key}`, false), s + d, s))"
    hot = {b: c for b, c in bounds.items() if c > 1}
    part = F.lit(0).cast("long")
    if hot:
        where = F.expr(f"array_position({_constant(sorted(hot), 'bigint')}, `{key}`)")
        parts = F.expr(_constant([hot[b] for b in sorted(hot)], "bigint"))
        share = F.least(F.lit(1.0 - 2**-40), F.col(order) / F.lit(2.0**64) + 0.5)
        part = F.coalesce(F.when(where > 0, F.floor(share * F.try_element_at(parts, where.cast("int"))) + 1), F.lit(0)).cast("long")
    return F.expr(index).cast("long") * (1 << 24) + part


def with_next(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Adds next_<column> for each of columns: its value in the row after, by key and order (a hash); after the last row, in the first.

    key must be an integer.  Rows are dealt into ranges; a copy of each range's first row closes the range before,
    so one shuffle does.  Nulls come first; an empty table gives none.  Rows of one key are split by order, but rows
    that agree in both, which are repeats, meet in one task, where they are sorted on disk if need be.
    """
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"the key {key} must be an integer")
    df = df.withColumn("_range", _ranges(df, key, order))
    firsts = df.groupBy("_range").agg(F.min(F.struct(key, order)).alias("_first"))
    circle = W.orderBy("_range")  # one row a range
    before = F.coalesce(F.lag("_range").over(circle), F.max("_range").over(W.partitionBy()))
    firsts = firsts.select("_range", "_first", before.alias("_before"))  # a row a range, some 60 bytes each
    ends = df.join(F.broadcast(firsts), "_range").where((F.col(key).eqNullSafe(F.col(f"_first.{key}"))) & (F.col(order) == F.col(f"_first.{order}")))
    ends = ends.withColumn("_range", F.col("_before")).drop("_first", "_before").dropDuplicates([key, order]).withColumn("_end", F.lit(1))
    in_range = W.partitionBy("_range").orderBy("_end", key, order)
    rows = df.withColumn("_end", F.lit(0)).unionByName(ends)
    return rows.select("*", *(F.lead(c).over(in_range).alias(f"next_{c}") for c in columns)).where("_end = 0").drop("_range", "_end")


def _cell(digest: str, part: int, cells: Column) -> Column:
    third = F.floor(cells / 3).cast("long")
    return (_hashed(F.col(digest), FACTORS[part]) % third + part * third).cast("int")


def _check(digest: str) -> Column:
    return _hashed(F.col(digest), CHECK)


def table_cells(units: DataFrame, by: list[str], cells: Column) -> DataFrame:
    """units has by, digest and sign; the cells (by, cell, n, key, check) that aren't empty, of a table of cells for each by."""
    spread = units.select(*by, "sign", "digest", F.explode(F.array(*(_cell("digest", p, cells) for p in range(3)))).alias("cell"))
    sums = spread.groupBy(*by, "cell").agg(F.sum("sign").alias("n"), F.bit_xor("digest").alias("key"), F.bit_xor(_check("digest")).alias("check"))
    return sums.where("n <> 0 or key <> 0 or `check` <> 0")


def peel(table: DataFrame, by: list[str], cells: Column, digests: bool = False) -> DataFrame:
    """(by, found, stuck) of each subtracted table: how many digests are recovered, and whether cells are left over.

    A round finds the cells of one of the three parts that hold one digest (a digest is in one cell of a part, so it
    is found once), and takes it from its cells.  The rounds group by the same keys, so they run in place; recovered
    digests stay as rows of cell -1.  Rounds go on in one plan, ROUNDS times.
    With digests, the recovered ones are returned as the arrays only_a (sign 1) and only_b (sign -1).
    """
    third = F.floor(cells / 3).cast("long")
    for i in range(ROUNDS):
        part = i % 3
        here = (F.col("cell") >= part * third) & (F.col("cell") < (part + 1) * third)
        pure = here & (F.abs("n") == 1) & (F.col("check") == _check("key"))
        own = F.struct("cell", "n", "key", "check")
        outs = [F.struct(_cell("key", p, cells).alias("cell"), (-F.col("n")).alias("n"), "key", "check") for p in range(3) if p != part]
        kept = F.struct(F.lit(-1).alias("cell"), "n", "key", "check")
        entries = table.select(*by, F.explode(F.when(pure, F.array(*outs, kept)).otherwise(F.array(own))).alias("e")).select(*by, "e.*")
        found = F.when(F.col("cell") < 0, F.col("key")).otherwise(0).alias("_found")
        table = entries.groupBy(*by, "cell", found).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")).where("n <> 0 or key <> 0 or `check` <> 0").drop("_found")
    out = [F.count_if(F.col("cell") < 0).alias("found"), F.max(F.col("cell") >= 0).alias("stuck")]
    if digests:
        out += [F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") == n), F.col("key"))).alias(c) for c, n in (("only_a", 1), ("only_b", -1))]
    return table.groupBy(*by).agg(*out)


def _signed(digests: str, sign: int) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("digest"), F.lit(sign).cast("long").alias("sign")))


def differences(pairs: DataFrame, digests: bool = False, rows: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """pairs has _row, _kind and two digest arrays a, b (without repeats); (_row, _kind, differ): how many digests are in one only.

    Each try subtracts the tables of a and b, as large as the estimate of their difference asks for, and peels; pairs that get stuck go on to
    a larger table.  A table of CELLS is the difference of the two fingerprints.  What is stuck after the last try is taken from the arrays.  Pairs without a difference may be left
    out.  With digests, the digests themselves are returned too, as only_a and only_b.
    """
    spark, done, by = pairs.sparkSession, [], ["_row", "_kind", "cells"]
    scratch = scratch or Scratch(spark)
    names = ["_row", "_kind", "differ", *(["only_a", "only_b"] if digests else [])]
    first = [F.slice(F.array_sort(c), 1, LEAST_DIGESTS) for c in "ab"]
    both = F.slice(F.array_sort(F.array_union(*first)), 1, LEAST_DIGESTS)
    alike = F.size(F.array_intersect(F.array_intersect(both, first[0]), first[1])) / F.greatest(F.size(both), F.lit(1))
    differing = (F.size("a") + F.size("b")) * (1 - alike) / (1 + alike)
    least = F.ceil(F.log2(F.greatest(F.lit(1.0), differing * ROOM / CELLS)))
    pairs = pairs.where("a <> b").withColumn("cells", (F.lit(CELLS) * F.pow(F.lit(2.0), least)).cast("long"))
    for i in range(TRIES):
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // TASK_DIGESTS))
        spread = pairs.repartition(parts, "_row")  # the arrays are shuffled, not their digests
        both = F.concat(_signed("a", 1), _signed("b", -1))
        units = spread.select(*by, F.explode(both).alias("u")).select(*by, "u.*")
        result = scratch.materialize(peel(table_cells(units, by, F.col("cells")), by, F.col("cells"), digests), f"peel{i}")
        done.append(result.where("not stuck").withColumnRenamed("found", "differ").select(*names))
        stuck = result.where("stuck").select("_row", "_kind")
        if not stuck.limit(1).count():
            pairs = None
            break
        pairs = scratch.materialize(pairs.join(stuck, ["_row", "_kind"], "left_semi").withColumn("cells", F.col("cells") * GROWTH), f"stuck{i}")
        rows = None
    if pairs is not None:
        rest = pairs.select("_row", "_kind", F.array_except("a", "b").alias("only_a"), F.array_except("b", "a").alias("only_b"))
        done.append(rest.withColumn("differ", (F.size("only_a") + F.size("only_b")).cast("long")).select(*names))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _printed(digests: DataFrame) -> DataFrame:
    """(_row, _kind, text) of each table: its cells in order, in hexadecimal."""
    cells = table_cells(digests, ["_row", "_kind"], F.lit(CELLS))
    printed = F.transform(F.sort_array(F.collect_list(F.struct("cell", "n", "key", "check"))), lambda c: F.concat_ws(":", c["cell"].cast("string"), c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"])))
    return cells.groupBy("_row", "_kind").agg(F.concat_ws(",", printed).alias("cells"))


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, differ_edited, differ_next) of each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next row's,
    by rising key (after the last: the first).  near is, of the digests in either fingerprint, the share in both,
    from the sizes that the fingerprints state and the digests that peeling their difference recovers (or, where that holds too many,
    the difference of larger tables of the same kind); it is 1 where both have none.

    key must be an integer.  A null text is empty (a fingerprint without cells); a null key comes first; rows of one key are ordered by a
    hash of their text; repeated rows follow each other; an empty table gives none; other columns are left out.
    The text is shuffled once; all else is done on the digests, which are written to the shared folder.
    """
    docs = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.withColumn("_own", paragraphs("_text")).withColumn("_order", F.xxhash64("_text"))
    docs = with_next(docs, key, ["_text", "_own"], "_order")
    n = F.length("_text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = docs.withColumn("n_chars", n.cast("long"))
    docs = docs.withColumn("_edited_text", F.concat(F.substring("_text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next__text", F.lit(1), half)))
    slim = docs.select(F.monotonically_increasing_id().alias("_row"), key, "n_chars", F.sha2(F.col("_edited_text").cast("binary"), 256).alias("edited_sha256"), "_own", paragraphs("_edited_text").alias("_edited"), F.col("next__own").alias("_next"))
    scratch = Scratch(df.sparkSession)
    slim = scratch.materialize(slim, "digests")
    own, edited, after = slim.agg(*(F.sum(F.size(c)) for c in ("_own", "_edited", "_next"))).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-((own or 0) + (edited or 0)) // TASK_DIGESTS))
    versions = slim.select("_row", "_own", "_edited").repartition(parts, "_row").select("_row", F.explode(F.array(F.struct(F.lit(0).alias("_kind"), F.col("_own").alias("d")), F.struct(F.lit(1).alias("_kind"), F.col("_edited").alias("d")))).alias("v"))
    digests = versions.select("_row", "v._kind", F.explode("v.d").alias("digest"), F.lit(1).cast("long").alias("sign"))
    prints = _printed(digests).groupBy("_row").agg(F.max(F.when(F.col("_kind") == 0, F.col("cells"))).alias("_p0"), F.max(F.when(F.col("_kind") == 1, F.col("cells"))).alias("_p1"))
    pairs = slim.select("_row", F.col("_own").alias("a"), F.explode(F.array(F.struct(F.lit(0).alias("_kind"), F.col("_edited").alias("b")), F.struct(F.lit(1).alias("_kind"), F.col("_next").alias("b")))).alias("v")).select("_row", "v._kind", "a", "v.b")
    differ = differences(pairs, rows=2 * (own or 0) + (edited or 0) + (after or 0), scratch=scratch).groupBy("_row").agg(*(F.max(F.when(F.col("_kind") == k, F.col("differ"))).alias(f"_d{k}") for k in (0, 1)))
    sizes = slim.select("_row", key, "n_chars", "edited_sha256", *(F.size(c).cast("long").alias(c) for c in ("_own", "_edited", "_next")))

    def near(other: str, d: Column) -> Column:
        both = F.col("_own") + F.col(other)
        return F.when(both == 0, 1.0).otherwise((both - d) / (both + d)).cast("double")

    def printed(size: str, cells: str) -> Column:
        return F.concat_ws("/", F.lit(str(CELLS)), F.col(size).cast("string"), F.coalesce(F.col(cells), F.lit("")))

    d0, d1 = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("_d0", "_d1"))
    out = sizes.join(prints, "_row", "left").join(differ, "_row", "left").select(
        key, "n_chars", "edited_sha256", printed("_own", "_p0").alias("fingerprint"), printed("_edited", "_p1").alias("edited_fingerprint"),
        near("_edited", d0).alias("near_edited"), near("_next", d1).alias("near_next"), d0.alias("differ_edited"), d1.alias("differ_next"),
    )
    out = materialize(out, "fingerprints")
    scratch.drop()
    return out
