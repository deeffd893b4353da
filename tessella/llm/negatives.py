"""Hard negatives by a two-dimensional block matrix multiply (SUMMA-style), exact in integers.

Anchors are dealt into I blocks of rows, all vectors into J blocks, and components into C chunks.  A cell (i, j, c) of
the grid multiplies its panel of anchors with its panel of vectors: a partial tile of int64 scores.  Partial tiles of
one (i, j) are shuffled together in strips and added; the tile is then reduced to each anchor's first few vectors at
once, so that no score leaves it that can't be in the result.  A first pass, within a label, finds the positives; a
second pass, over all vectors, finds the negatives within each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, binary_column, materialize, sorted_groups, trimmed

#: Anchors and vectors of a tile, about; components of a chunk; scores of a strip (a row of the shuffle has 8 bytes each).
ANCHORS, VECTORS, CHUNK, STRIP = 1024, 4096, 32, 512
#: Components are below LARGEST in absolute value once they are integers, and vectors have at most LONGEST: all sums are then exact.
LARGEST, LONGEST = 1 << 24, 1 << 14
_LAST = np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """Whether a vector is known, and so is every component, as a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vector: Column, scale: int, largest: int) -> Column:
    """floor(scale * x) of each component; one of largest or more in absolute value is an error."""
    scaled = lambda x: F.floor(x.cast("double") * scale)
    error = F.raise_error(F.lit(f"a vector's component times {scale} reaches {largest}")).cast("long")
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < largest, scaled(x)).otherwise(error))


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors with their block i for each j, and all rows with their block j for each i, of rows that have g, I and J."""
    rows = rows.withColumn("h", F.xxhash64("idx"))
    left = rows.where("anchor").withColumn("i", F.pmod("h", "I").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("J") - 1)))
    right = rows.withColumn("j", F.pmod("h", "J").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("I") - 1)))
    return left, right


def _panel(column) -> np.ndarray:
    """Rows of a panel, as exact float64; short ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), CHUNK))
    out[np.arange(CHUNK)[None] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tiles, a strip of STRIP scores a row, of rows (g, i, j, c, side, idx, v) sorted by all but the last."""
    for table in sorted_groups(batches, 4):
        side = table["side"].to_numpy()
        n = int((side == 0).sum())
        left, right = _panel(table["v"].slice(0, n)), _panel(table["v"].slice(n))
        strips = -(-len(right) // STRIP)
        key = [table[k][0].as_py() for k in ("g", "i", "j", "c")]
        step = max(1, (1 << 19) // max(1, strips * STRIP))
        for s in range(0, n if strips else 0, step):
            tile = np.zeros((len(left[s : s + step]), strips * STRIP), np.int64)
            tile[:, : len(right)] = np.rint(left[s : s + step] @ right.T)
            rows = tile.shape[0] * strips
            data = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * (8 * STRIP)).astype(np.int32)), pa.py_buffer(tile)])
            place = s * strips + np.arange(rows)
            arrays = [pa.array(np.full(rows, k)) for k in (key[0], *key[1:])]
            yield pa.RecordBatch.from_arrays([arrays[0], *(a.cast(pa.int32()) for a in arrays[1:]), pa.array(place), data], ["g", "i", "j", "c", "idx", "data"])


def _tiles(batches: Iterator[pa.RecordBatch]):
    """(anchors, vectors, scores) of each tile: rows of kind 0 and 1 sorted by idx, and the sum of its partial tiles.

    Rows come sorted by (g, i, j, kind, idx); only one tile is held, its strips are added as they come.
    """
    last, held, total = None, {}, None

    def out():
        if total is None:
            return
        sides = [pa.Table.from_batches(held[k]) for k in (0, 1)]
        scores = total.reshape(sides[0].num_rows, -1)[:, : sides[1].num_rows]
        yield *sides, scores

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key, kind, part = tuple(keys[:3, a].tolist()), int(keys[3, a]), batch.slice(a, b - a)
            if key != last:
                yield from out()
                last, held, total = key, {0: [], 1: []}, None
            if kind < 2:
                held[kind].append(part)
                continue
            if not held[0] or not held[1]:
                continue
            if total is None:
                n, m = (sum(x.num_rows for x in held[k]) for k in (0, 1))
                total = np.zeros((n * -(-m // STRIP), STRIP), np.int64)
            data, offsets = binary_column(part.column("data"))
            strips = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64).reshape(-1, STRIP)
            place, chunk = part.column("idx").to_numpy(), part.column("c").to_numpy()
            for c in np.unique(chunk).tolist():
                at = chunk == c
                total[place[at]] += strips[at]
    yield from out()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().fill_null(_LAST).to_numpy()


def _reduced(rows: DataFrame, chunks: int, extra: str, reduce: Callable, schema: str) -> DataFrame:
    """reduce(anchors, vectors, scores) of each tile of the grid over rows (g, I, J, idx, vec_id, label, tie, anchor, q, extra)."""
    left, right = _dealt(rows)
    parts = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.struct(c.alias("c"), F.slice("q", c * CHUNK + 1, F.lit(CHUNK)).alias("v")))
    panels = [df.select("g", "i", "j", F.lit(k).alias("side"), "idx", F.inline(parts)) for k, df in enumerate((left, right))]
    panels = panels[0].unionByName(panels[1]).select("g", "i", "j", "c", "side", "idx", "v")
    grid = panels.repartition("g", "i", "j", "c").sortWithinPartitions("g", "i", "j", "c", "side", "idx")
    tiles = grid.mapInArrow(trimmed(_multiply), "g long, i int, j int, c int, idx long, data binary").withColumn("kind", F.lit(2))
    names = [df.select("g", "i", "j", F.lit(k).alias("kind"), "idx", "vec_id", "label", "tie", *([extra] if k == 0 and extra else [])) for k, df in enumerate((left, right))]
    both = names[0].unionByName(names[1], allowMissingColumns=True).unionByName(tiles, allowMissingColumns=True)
    both = both.select("g", "i", "j", "kind", "idx", "vec_id", "label", "tie", "c", "data", *([extra] if extra else []))
    both = both.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "kind", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, vectors, scores in _tiles(batches):
            order = np.lexsort((_numbers(vectors, "tie"), _numbers(vectors, "label"), _numbers(vectors, "vec_id")))
            yield from reduce(anchors, vectors.take(pa.array(order)), scores[:, order])

    return both.mapInArrow(trimmed(run), schema)


def _blocks(anchors: Column, rows: Column) -> list[Column]:
    """I and J: into how many blocks so many anchors and rows go."""
    return [F.greatest(F.lit(1), F.ceil(n / each)).cast("int").alias(name) for n, each, name in ((anchors, ANCHORS, "I"), (rows, VECTORS, "J"))]


def _by_label(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with their label as g and its I and J; labels without an anchor are left out."""
    counts = rows.groupBy(F.col("label").alias("g")).agg(F.count_if("anchor").alias("a"), F.count("*").alias("n")).where("a > 0")
    grid = scratch.materialize(counts.select("g", *_blocks(F.col("a"), F.col("n"))), "grid")
    return rows.withColumn("g", F.col("label")).join(grid, "g")


def _positives(most: int) -> Callable:
    def reduce(anchors: pa.Table, vectors: pa.Table, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = anchors["idx"].to_numpy()[:, None] == vectors["idx"].to_numpy()[None]
        order = np.argsort(-scores, axis=1, kind="stable")[:, : most + 1]
        rows = np.repeat(np.arange(len(order)), order.shape[1])
        order = order.ravel()
        keep = ~own[rows, order]
        rows, order = rows[keep], order[keep]
        at = pa.array(order)
        taken = [vectors[c].combine_chunks().take(at) for c in ("idx", "vec_id", "label", "tie")]
        yield pa.RecordBatch.from_arrays([anchors["idx"].combine_chunks().take(pa.array(rows)), *taken, pa.array(scores[rows, order])], ["anchor", "idx", "vec_id", "label", "tie", "score"])

    return reduce


def _negatives(most: int, low: int, high: int) -> Callable:
    def reduce(anchors: pa.Table, vectors: pa.Table, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        labels, own = vectors["label"].to_numpy(), anchors["label"].to_numpy()
        found: list[tuple] = []
        for r, positives in enumerate(anchors["positives"].to_pylist()):
            other = np.flatnonzero(labels != own[r])
            falling = -scores[r, other]
            order = np.argsort(falling, kind="stable")
            falling = falling[order]
            for p in positives:
                least, largest = -(-low * p["score"] // 100), high * p["score"] // 100  # low * p <= 100 * s <= high * p
                a = np.searchsorted(falling, -largest, "left")
                b = np.searchsorted(falling, -least, "right")
                found += [(r, p["rank"], p["vec_id"], p["score"], int(x)) for x in other[order[a : min(b, a + most)]]]
        if found:
            r, rank, positive, score, at = zip(*found, strict=True)
            ids = [anchors[c].combine_chunks().take(pa.array(r)) for c in ("idx", "vec_id")]
            taken = [vectors[c].combine_chunks().take(pa.array(at)) for c in ("vec_id", "label", "tie")]
            arrays = [*ids, pa.array(rank, pa.int32()), pa.array(positive, pa.int64()), pa.array(score, pa.int64()), *taken, pa.array(scores[list(r), list(at)])]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "label", "tie", "negative_score"])

    return reduce


def _first(df: DataFrame, by: list[str], score: str, key: str, most: int, out: str) -> DataFrame:
    """The first most rows of each group: higher scores first, then smaller keys (null last), then label and tie; out is the place."""
    window = W.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(key), "label", "tie")
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= most)


def hard_negatives(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", anchor: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    positives other vectors of its label, the first negatives vectors of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score.

    Scores are inner products of floor(scale * x); higher ones come first, ties by the smaller key.  A vector without
    a label, a null vector, and one with a null or non-finite component take no part; missing components of a shorter
    vector count as 0, and an empty vector scores 0 with all.  Anchors are the rows for which anchor holds (keys
    divisible by 100, if none is given); one without another vector of its label, or without a negative in the window,
    gives no row.  A null key is no anchor by that rule; as a partner it stands last among ties.  Rows equal in key, label
    and components count once; different vectors under one key are different rows, ties among them going by label and a hash of the
    components.  An empty table gives none; other columns, whatever their names, are left out.  A component of 65,536
    (at a scale of 256) or more, or more than 16,384 of them, is an error, since scores wouldn't be exact.

    Work is anchors times vectors, by definition; each tile is bounded, a label of any size is dealt over many of
    them, and at most positives or negatives rows a tile and anchor leave it.
    """
    scratch = Scratch(df.sparkSession)
    name = F.col(label) if isinstance(label, str) else label
    anchor = F.col(key) % 100 == 0 if anchor is None else anchor
    known = df.select(F.col(key).cast("long").alias("vec_id"), name.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("v")).where(F.col("label").isNotNull() & finite(F.col("v")))
    long_ = F.raise_error(F.lit(f"a vector has more than {LONGEST} components")).cast("array<long>")
    rows = known.select("vec_id", "label", "anchor", F.when(F.size("v") <= LONGEST, whole_numbers(F.col("v"), scale, LARGEST)).otherwise(long_).alias("q")).distinct()
    rows = scratch.materialize(rows.select(F.monotonically_increasing_id().alias("idx"), "*", F.xxhash64("q").alias("tie")), "vectors")
    longest = rows.agg(F.max(F.size("q"))).first()[0] or 0
    chunks = max(1, -(-longest // CHUNK))

    found = _reduced(_by_label(rows, scratch), chunks, "", _positives(positives), "anchor long, idx long, vec_id long, label long, tie long, score long")
    found = _first(found, ["anchor"], "score", "vec_id", positives, "rank").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    found = scratch.materialize(found.withColumnRenamed("anchor", "idx"), "positives")

    counts = [F.lit(found.count()), F.lit(rows.count())]
    every = rows.drop("anchor").join(found, "idx", "left").withColumn("anchor", F.col("positives").isNotNull()).select("*", F.lit(0).cast("long").alias("g"), *_blocks(*counts))
    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, label long, tie long, negative_score long"
    out = _reduced(every, chunks, "positives", _negatives(negatives, low, high), schema)
    out = _first(out, ["anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    scratch.drop()
    return out
