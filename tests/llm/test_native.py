"""Sharding, mixing and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import fingerprints, mixing, shards


def jump_hash(key: int, n: int) -> int:
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_shards(docs, none, texts):
    rows = shards.assign_shards(docs, 24).collect()
    assert len(rows) == len(texts)
    text = {r[0]: r[1] for r in texts}
    slots = defaultdict(list)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.shard == jump_hash(r.doc_id or 0, 24) and r.grown_shard == jump_hash(r.doc_id or 0, 25)
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shards.assign_shards(none, 3).count() == 0


def test_shards_of_many_and_string_keys(spark):
    df = spark.range(-500, 3000).selectExpr("id as doc_id", "cast(id as string) as text")
    assert all(r.shard == jump_hash(r.doc_id, 7) for r in shards.assign_shards(df, 7).collect())
    rows = shards.assign_shards(df, 5, key="text").collect()
    assert {r.shard for r in rows} == set(range(5))


def brute_mix(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(rows)}
    by = defaultdict(int)
    for i, r in enumerate(rows):
        by[r[3]] += size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, open_ = share * sum(by.values()), {}, set(order)
    while open_:  # the excess of those above their bound is dealt again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * by[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * by[s]
            left -= target[s]
        open_ -= over
    return size, by, target


def test_mix(docs, none, texts):
    rows = mixing.mix_sources(docs, keep=("source",)).collect()
    assert len(rows) == len(texts)
    size, by, target = brute_mix(texts)
    taken = defaultdict(int)
    longest = defaultdict(int)
    for r in rows:
        assert r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in by)
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in rows}
    assert mixing.mix_sources(none).count() == 0


def test_mix_carries_columns_of_odd_names(spark, docs):
    df = docs.withColumnRenamed("token", "_source").withColumnRenamed("label", "_hash").withColumnRenamed("node", "_limit")
    rows = mixing.mix_sources(df, keep=("_source", "_hash", "_limit")).collect()
    assert len(rows) == df.count() and all((r._source, r._hash, r._limit) == (3, 4, 2) for r in rows)
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, keep=("size",))


def test_mix_comes_near_its_targets(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "concat('s', cast(pow(id % 100, 2) / 2500 as int)) as source")
    rows = mixing.mix_sources(df, keep=("source",)).groupBy("source").sum("taken").collect()
    target = {r.source: r.target for r in mixing.mix_sources(df, keep=("source",)).select("source", "target").distinct().collect()}
    assert all(abs(r["sum(taken)"] - target[r.source]) <= 50 for r in rows)


def units(text: str) -> set[str]:
    return set(re.findall(r"[^\n]{1,120}", text))


def test_fingerprints(docs, none, texts):
    rows = fingerprints.fingerprint_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    plain = {r[0]: r[1] or "" for r in texts if r[0] is not None}
    ids = sorted(plain)
    found = {r.doc_id: r for r in rows}
    assert sorted(found) == ids
    by_text = defaultdict(set)
    for i, d in enumerate(ids):
        text, after, r = plain[d], plain[ids[(i + 1) % len(ids)]], found[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = units(text), units(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
        by_text[text].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.fingerprint_documents(docs).count() == len(texts)
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_short_texts_share_digests_with_their_edited_ones(spark):
    df = spark.createDataFrame([(i, " ".join(f"word{i * 1000 + k}" for k in range(40))) for i in range(20)], "doc_id long, text string")
    assert all(0 < r.near_edited < 1 and r.near_next == 0 for r in fingerprints.fingerprint_documents(df).collect())


@pytest.mark.parametrize("hot", [False, True])
def test_with_next_over_ranges(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rows = [(i * i, str(i), hash((i, 1)) * 2654435761 % 2**63) for i in range(100)]
    if hot:  # a key of many rows, and a null one
        rows += [(2500, f"h{i}", i * 92233720368547758 - 2**62) for i in range(60)] + [(None, "none", 5)]
    df = spark.createDataFrame(rows, "doc_id long, t string, o long").repartition(3)
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = {r[1]: s[1] for r, s in zip(in_order, in_order[1:] + in_order[:1], strict=True)}
    found = fingerprints.with_next(df, "doc_id", ["t"], "o").collect()
    assert len(found) == len(rows) and {r.t: r.next_t for r in found} == want
    if hot:
        ranges = df.select("doc_id", fingerprints._ranges(df, "doc_id", "o").alias("r")).where("doc_id = 2500").distinct().count()
        assert ranges >= 4


def test_keys_that_are_not_integers(spark):
    with pytest.raises(ValueError):
        fingerprints.fingerprint_documents(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_peeling_retries_larger(spark, monkeypatch):
    rows = [(1, 0, list(range(1000)), list(range(990, 2500))), (2, 0, [1, 2, 3], [1, 2, 3]), (3, 0, [5], []), (4, 1, [], [7, 8])]
    pairs = spark.createDataFrame(rows, "_row long, _kind int, a array<long>, b array<long>")
    for room, tries in ((3, 6), (1 / 40, 6), (1 / 40, 1)):  # at once; in tables that are too small at first; from the arrays at last
        monkeypatch.setattr(fingerprints, "ROOM", room)
        monkeypatch.setattr(fingerprints, "TRIES", tries)
        found = {r._row: r for r in fingerprints.differences(pairs, digests=True).collect()}
        for row, _, a, b in rows:
            if set(a) == set(b):
                assert row not in found
                continue
            assert sorted(found[row].only_a) == sorted(set(a) - set(b)) and sorted(found[row].only_b) == sorted(set(b) - set(a))
            assert found[row].differ == len(set(a) ^ set(b))


def test_tables_are_as_large_as_the_difference(spark, monkeypatch):
    """Large sets that differ in few digests are peeled in the difference of their fingerprints; wholly different ones in larger tables; none in the arrays."""
    rng = random.Random(3)
    common = [rng.getrandbits(60) for _ in range(5000)]
    rows = [(i, 0, common + [rng.getrandbits(60) for _ in range(5)], common + [rng.getrandbits(60) for _ in range(5)]) for i in range(20)]
    rows += [(i, 0, [rng.getrandbits(60) for _ in range(300)], [rng.getrandbits(60) for _ in range(300)]) for i in range(20, 40)]
    made, cells = [], fingerprints.table_cells
    monkeypatch.setattr(fingerprints, "table_cells", lambda units, by, size: made.append(units.groupBy("_row").agg(F.max("cells").alias("c")).collect()) or cells(units, by, size))
    found = {r._row: r.differ for r in fingerprints.differences(spark.createDataFrame(rows, "_row long, _kind int, a array<long>, b array<long>")).collect()}
    assert found == {i: 10 if i < 20 else 600 for i in range(40)}
    first = {r._row: r.c for r in made[0]}
    assert all(first[i] == fingerprints.CELLS for i in range(20)) and all(1000 < first[i] < 4000 for i in range(20, 40)) and len(made) < fingerprints.TRIES


def test_nearly_all_tables_peel_at_once(spark):
    """Peeling itself recovers the digests: without retries, and without the arrays."""
    rng = random.Random(2)
    rows = [(i, [rng.getrandbits(60) for _ in range(rng.randint(0, 80))], [rng.getrandbits(60) for _ in range(rng.randint(0, 80))]) for i in range(200)]
    rows = [(i, a + [7, 8, 9], b + [8, 9]) for i, a, b in rows]
    units = spark.createDataFrame([(i, d, n) for i, a, b in rows for n, x in ((1, a), (-1, b)) for d in x], "_row long, digest long, sign long")
    cells = F.lit(768)
    found = {r._row: r for r in fingerprints.peel(fingerprints.table_cells(units, ["_row"], cells), ["_row"], cells, digests=True).collect()}
    assert sum(r.stuck for r in found.values()) <= 1
    for i, a, b in rows:
        if not found[i].stuck:
            assert set(found[i].only_a) == set(a) - {8, 9} and set(found[i].only_b) == set(b) - {8, 9} and found[i].found == len(a) + len(b) - 4
