"""Centroid clustering with ball trees, exact in integers.

Every task builds metric trees over the vectors of its partition: a ball has its count, its integer sum and its radius
around the mean.  A round walks down the trees with the candidates among the centroids: by the triangle inequality
a centroid that is farther from a ball's middle than the nearest one by more than the ball's diameter can't be the
nearest of any of its vectors.  With one candidate left, the whole ball goes to it, by its count and sum; else its
children are looked at, and in the end the leaves' vectors, whose distances are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_column, materialize, trimmed
from .negatives import finite, whole_numbers

#: Vectors of a tree, and of a leaf at most (a ball of equal vectors is a leaf of any size).
TREE, LEAF = 2048, 32
#: Components are below LARGEST in absolute value once they are integers, so that squared distances fit 64 bits (64 components).
LARGEST = 1 << 26
#: Balls are judged with this relative margin, far above the rounding of float64; what it leaves open is decided by exact distances.
MARGIN = 1e-7


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, and for each ball its first point, its end in that order and its first child (0: a leaf;
    the second follows the first), and its radius around the mean."""
    order = np.arange(len(points))
    spans, child, radius = [(0, len(points))], [0], [0.0]
    real, i = points.astype(np.float64), 0
    while i < len(spans):
        a, b = spans[i]
        own = real[order[a:b]]
        far = ((own - own.mean(0)) ** 2).sum(1)
        radius[i] = float(np.sqrt(far.max()))
        if b - a > LEAF and radius[i] > 0:
            first = own[int(far.argmax())]
            second = own[int(((own - first) ** 2).sum(1).argmax())]
            order[a:b] = order[a:b][np.argsort(own @ (second - first), kind="stable")]
            middle = (a + b) // 2
            child[i] = len(spans)
            spans += [(a, middle), (middle, b)]
            child += [0, 0]
            radius += [0.0, 0.0]
        i += 1
    return order, np.array(spans, np.int32), np.array(child, np.int32), np.array(radius)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, int64, of each point to each centroid."""
    most = int(max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * points.shape[1] < 1 << 53:  # every sum is a whole number that float64 holds
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return np.rint((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


def descend(points: np.ndarray, spans: np.ndarray, child: np.ndarray, radius: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(ball, centroid) of the balls that go as a whole; points of the other leaves, and their nearest centroids (ties: the first)."""
    whole, rest = [], []
    balls, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(balls):
        counts = (spans[balls, 1] - spans[balls, 0])[:, None]
        gap = sums[balls] / counts
        away = np.sqrt(((gap[:, None] - centroids[None]) ** 2).sum(2))
        reach = 2 * radius[balls]
        nearest = np.where(open_, away, np.inf).min(1)
        open_ &= away <= (nearest + reach + MARGIN * (1 + nearest + reach))[:, None]
        single = open_.sum(1) == 1
        whole += zip(balls[single].tolist(), open_[single].argmax(1).tolist(), strict=True)
        leaf = ~single & (child[balls] == 0)
        rest += [(int(spans[b, 0]), int(spans[b, 1]), o) for b, o in zip(balls[leaf], open_[leaf], strict=True)]
        go = ~single & ~leaf
        balls, open_ = np.concatenate([child[balls[go]], child[balls[go]] + 1]).astype(np.int64), np.concatenate([open_[go], open_[go]])
    if not rest:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([np.arange(a, b) for a, b, _ in rest])
    open_ = np.repeat(np.stack([o for *_, o in rest]), [b - a for a, b, _ in rest], axis=0)
    far = np.where(open_, squared(points[at], centroids), np.iinfo(np.int64).max)
    return whole, at, far.argmin(1)


_TREE = "n int, keys array<long>, known array<boolean>, spans binary, child binary, radius binary, sums binary, points binary"


def _trees(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, TREE):
                part = batch.slice(s, TREE)
                points = part.column(1).flatten().to_numpy().reshape(-1, dims)
                order, spans, child, radius = build(points)
                points = np.ascontiguousarray(points[order])
                total = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(points, 0)])
                keys = part.column(0).take(pa.array(order))
                arrays = [a.tobytes() for a in (spans, child, radius, total[spans[:, 1]] - total[spans[:, 0]], points.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([len(points)], pa.int32()), pa.array([keys.fill_null(0).to_numpy()]), pa.array([keys.is_valid().to_pylist()]), *(pa.array([a], pa.binary()) for a in arrays)], ["n", "keys", "known", "spans", "child", "radius", "sums", "points"])

    return run


def _read(batches: Iterator[pa.RecordBatch], dims: int):
    """(points, spans, child, radius, sums, row of the batch, number of the row) of each tree."""
    for batch in batches:
        parts = []
        for name, kind in (("spans", np.int32), ("child", np.int32), ("radius", np.float64), ("sums", np.int64), ("points", np.int32)):
            data, offsets = binary_column(batch.column(name))
            parts.append((data, offsets, kind))
        for r in range(batch.num_rows):
            spans, child, radius, sums, points = (np.frombuffer(data[offsets[r] : offsets[r + 1]].tobytes(), kind) for data, offsets, kind in parts)
            yield points.reshape(-1, dims).astype(np.int64), spans.reshape(-1, 2), child, radius, sums.reshape(-1, dims), batch, r


def _totals(centroids: np.ndarray, dims: int):
    """A row for each centroid that a task's vectors go to: their count and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for points, spans, child, radius, sums, _, _ in _read(batches, dims):
            whole, at, nearest = descend(points, spans, child, radius, sums, centroids)
            for ball, c in whole:
                count[c] += spans[ball, 1] - spans[ball, 0]
                total[c] += sums[ball]
            count += np.bincount(nearest, minlength=len(centroids))
            np.add.at(total, nearest, points[at])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for points, spans, child, radius, sums, batch, r in _read(batches, dims):
            whole, at, nearest = descend(points, spans, child, radius, sums, centroids)
            cluster = np.zeros(len(points), np.int32)
            for ball, c in whole:
                cluster[spans[ball, 0] : spans[ball, 1]] = c
            cluster[at] = nearest
            keys = pa.array(batch.column("keys")[r].values.to_numpy(), mask=~batch.column("known")[r].values.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([keys, pa.array(cluster), pa.array(((points - centroids[cluster]) ** 2).sum(1))], ["key", "cluster", "distance"])

    return run


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Vectors of exactly dims known, finite components are kept, as floor(scale * x).  The k with the smallest SHA-256 of
    "seed:key" are the first centroids; each of rounds rounds assigns every vector to the nearest one (squared
    distance; ties: the smaller number) and moves every centroid that has vectors to the floor of their mean.  Then they
    are assigned once more.  The result is exact, and the same however the rows are partitioned.

    A null or other vector gives no row.  A null key is kept, and is the last to be a first centroid; of repeated keys
    the vectors decide.  Repeated rows each count and are returned; fewer than k vectors give fewer clusters; an empty table gives
    none; other columns, whatever their names, are left out.  A component that reaches 65,536 (at a scale of 1024) is an error.

    Trees are written once; a round reads them and sends k * dims sums at most to the driver.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    kept = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).where((F.size("v") == dims) & finite(F.col("v")))
    kept = kept.select("key", whole_numbers(F.col("v"), scale, LARGEST).alias("q"))
    trees = scratch.materialize(kept.mapInArrow(trimmed(_trees(dims)), _TREE), "balls")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = kept.select(F.struct(name.isNull().alias("none"), name.alias("name"), "key", "q").alias("o"), "q").orderBy("o").limit(k).collect()
    centroids = np.array([r.q for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        parts = trees.mapInArrow(trimmed(_totals(centroids, dims)), "cluster int, n long, sums array<long>")
        parts = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))
        moved = centroids.copy()
        for r in parts.collect():  # k * dims rows at most
            moved[r.cluster, r["at"]] = int(r.x) // int(r.n)
        if (moved == centroids).all():
            break  # all further rounds would do the same
        centroids = moved
    out = materialize(trees.mapInArrow(trimmed(_assigned(centroids, dims)), "key long, cluster int, distance long"), "clusters")
    scratch.drop()
    totals = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    figures = spark.createDataFrame([(c, s, sum(totals.values()), digests[c]) for c, s in sorted(totals.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(figures), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # figures has k rows at most
