"""Hard negatives and centroid clustering against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tessella.llm import balls, negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, idx long, q string, anchor long, g int"
EXTRA = (7, "x", 8, 9)


def rows(rng: random.Random, n: int, dims: int = 64, labels: int = 4) -> list[tuple]:
    middles = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = 0 if i % 3 == 0 else rng.randrange(labels)
        out.append((i * 10, [float(np.float32(m + rng.gauss(0, 0.2))) for m in middles[label]], label, *EXTRA))
    out += [(10 * n, None, 1, *EXTRA), (10 * n + 10, out[0][1], None, *EXTRA), (10 * n + 20, [*out[0][1][:-1], None], 1, *EXTRA), (10 * n + 30, [*out[0][1][:-1], math.nan], 1, *EXTRA), (10 * n + 40, [-math.inf, *out[0][1][1:]], 1, *EXTRA)]
    return out


def brute_negatives(data: list[tuple], positives: int = 5, most: int = 10) -> list[tuple]:
    kept = {(k, l, tuple(math.floor(256 * x) for x in v)) for k, v, l, *_ in data if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in kept if b != a), key=order)
        for p in [s for s in scored if s[2] == a[1]][:positives]:
            window = [s for s in scored if s[2] != a[1] and 30 * p[0] <= 100 * s[0] <= 90 * p[0]]
            out += [(a[0], p[1], i + 1, s[1], p[0], s[0]) for i, s in enumerate(window[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1024, 4096, 512), (4, 8, 4)])
def test_hard_negatives(spark, monkeypatch, sizes):
    """Tiles of the usual size, and so small that every label, block, chunk and strip is cut."""
    for name, n in zip(("ANCHORS", "VECTORS", "STRIP"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, n)
    data = rows(random.Random(1), 90)
    data += [(None, data[4][1], 2, *EXTRA), (5, data[4][1], 2, *EXTRA), (6, data[4][1], 2, *EXTRA), (100_000, data[0][1], 9, *EXTRA), (200_000, [], 1, *EXTRA), (300_000, data[3][1][:40], 1, *EXTRA)]
    data += [data[0], data[0], data[5]]  # repeated rows count once
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = sorted((tuple(r) for r in negatives.hard_negatives(df).collect()), key=str)
    assert len(found) > 200 and found == brute_negatives(data)


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty).collect() == [] and negatives.hard_negatives(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, *EXTRA), (1, [1.0], 2, *EXTRA)], SCHEMA)
    assert negatives.hard_negatives(alone).collect() == []
    with pytest.raises(Exception, match="component"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 1, *EXTRA)], SCHEMA)).collect()


def test_scores_are_exact_at_the_bound(spark):
    """Sums beyond 2 ** 53 are right to the last digit."""
    x = 65535.99609375
    data = [(0, [x] * 64, 1, *EXTRA), (1, [x] * 63 + [x - 1 / 256], 1, *EXTRA), (2, [x * 0.8125] * 64, 2, *EXTRA)]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted((tuple(r) for r in negatives.hard_negatives(df).collect()), key=str) == brute_negatives(data)


def brute_clusters(data: list[tuple], k: int = 8, rounds: int = 10) -> list[tuple]:
    kept = [(key, [math.floor(1024 * x) for x in v]) for key, v, *_ in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda key: hashlib.sha256(f"3:{key}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[0] or 0, r[1]))[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))

    def assigned():
        return [min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c)) for _, v in kept]

    for _ in range(rounds):
        at = assigned()
        for c in set(at):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assigned()
    far = [away(v, centroids[a]) for (_, v), a in zip(kept, at, strict=True)]
    inertia = [sum(f for f, a in zip(far, at, strict=True) if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((key, a, f, inertia[a], sum(far), digest[a]) for (key, _), a, f in zip(kept, at, far, strict=True)), key=str)


@pytest.mark.parametrize(("tree", "leaf"), [(2048, 32), (16, 2)])
def test_ball_clusters(spark, monkeypatch, tree, leaf):
    monkeypatch.setattr(balls, "TREE", tree)
    monkeypatch.setattr(balls, "LEAF", leaf)
    data = rows(random.Random(2), 250, labels=6)
    data += [(None, data[4][1], 2, *EXTRA), data[7], data[7], (5, data[7][1], 2, *EXTRA), (6, [], 1, *EXTRA), (8, data[3][1][:63], 1, *EXTRA)] + [(10_000 + i, data[9][1], 1, *EXTRA) for i in range(100)]
    found = sorted((tuple(r) for r in balls.cluster(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()), key=str)
    assert found == brute_clusters(data)


def test_ball_clusters_of_odd_tables(spark):
    empty = balls.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = rows(random.Random(3), 3)
    assert sorted((tuple(r) for r in balls.cluster(spark.createDataFrame(few, SCHEMA)).collect()), key=str) == brute_clusters(few)
    same = [(i, [0.25] * 64, 1, *EXTRA) for i in range(300)]  # every distance is a tie
    assert {r.cluster for r in balls.cluster(spark.createDataFrame(same, SCHEMA)).collect()} == {0}


def test_balls_go_whole():
    """Far groups of vectors are assigned by their balls alone; none of their leaves is looked at."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-20, 20, (400, 64)) + far for far in (0, 5000, -5000)])
    order, spans, child, radius = balls.build(points)
    points = points[order]
    total = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(points, 0)])
    centroids = np.array([[0] * 64, [5000] * 64, [-5000] * 64])
    whole, at, _ = balls.descend(points, spans, child, radius, total[spans[:, 1]] - total[spans[:, 0]], centroids)
    assert sum(int(spans[b, 1] - spans[b, 0]) for b, _ in whole) + len(at) == 1200 and len(at) < 100
    assert all((balls.squared(points[spans[b, 0] : spans[b, 1]], centroids).argmin(1) == c).all() for b, c in whole)


def test_distances_beyond_float():
    """Where float64 can't hold the sums, integers do."""
    points, centroids = np.array([[1 << 25] * 64, [(1 << 25) + 1] * 64]), np.array([[-(1 << 25)] * 64])
    assert balls.squared(points, centroids).ravel().tolist() == [64 * (1 << 26) ** 2, 64 * ((1 << 26) + 1) ** 2]


def test_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not __import__("os").path.exists(folder):
        pytest.skip("the tables aren't there")
    duckdb.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    for name in ("op11_hard_negatives", "op13_ball_clusters"):
        df = queries.QUERIES[name](spark, folder)
        want = duckdb.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({queries.SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want) and want


def test_labels_before_mining(spark, tmp_path):
    data = rows(random.Random(5), 60)
    spark.createDataFrame(data, SCHEMA).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(k, v, (l + 1) % 10 if l is not None and k % 7 == 0 else l, *rest) for k, v, l, *rest in data]
    assert sorted((tuple(r) for r in queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()), key=str) == brute_negatives(moved)
