"""The n-gram join and passages against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import graph, ngram_join, passages
from tessella.llm.common import Scratch, join_labels

from .conftest import words


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    distinct = {frozenset(s) for s in sets if s}
    links = {a: sum(a != b and 100 * len(a & b) >= percent * len(a | b) for b in distinct) for a in distinct}
    return [(r[0], len(s), least.get(find(i)) if s else r[0], links.get(frozenset(s), 0)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def same(found, rows, k, percent):
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.links) for r in found), key=key)
    assert got == sorted(brute_components(rows, k, percent), key=key)


def test_join(docs, none, texts):
    same(ngram_join.jaccard_join(docs, words=4, percent=85).collect(), texts, 4, 85)
    same(ngram_join.jaccard_join(docs).collect(), texts, 5, 80)
    assert ngram_join.jaccard_join(none).count() == 0


def family(rng, centre, n, edits):
    out = []
    for _ in range(n):
        w = list(centre)
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        out.append(" ".join(w))
    return out


def test_large_families_with_long_lists_and_forests(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    rng = random.Random(3)
    line = " ".join(words(rng, 12))
    rows = []
    for _ in range(3):
        rows += family(rng, words(rng, 150), 90, 6)
    rows += [f"{line} {' '.join(words(rng, 60))}" for _ in range(120)]  # a common line alone doesn't link
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(ngram_join.jaccard_join(df, words=4, percent=85).collect(), rows, 4, 85)


def test_keep_one(docs, texts):
    kept = ngram_join.keep_one(docs).collect()
    gone = {d for d, _, c, _ in brute_components(texts, 5, 80) if d is not None and d != c}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({r[0] for r in texts if r[0] is not None and r[0] not in gone})
    assert set(kept[0].asDict()) == set(docs.columns)


def test_keep_one_of_odd_keys(spark, none):
    rng = random.Random(31)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    near = a + " more"
    rows = [(1, a), (2, near), (2, b), (None, c), (None, c), (None, a), (3, d), (3, d), (3, d + " end"), (4, ""), (4, ""), (5, None)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, _row int, first string").repartition(2)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()), key=str)
    ends = [x for x in kept if x[0] == 3]
    assert len(ends) == 1 and [x for x in kept if x[0] != 3] == sorted([(1, a), (2, b), (None, c), (4, ""), (4, ""), (5, None)], key=str)
    assert ngram_join.keep_one(none).count() == 0


def test_divide_skip():
    """The search gives what counting every overlap gives: of short lists, long ones, and lists with hardly a gap."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(n), replace=False), rng.integers(0, 2**63, int(m)).astype(np.uint64)])) for n, m in zip(rng.integers(0, 400, 150), rng.integers(1, 40, 150), strict=True)]
    sets += [np.unique(np.concatenate([np.delete(base, rng.integers(0, 400, 9)), rng.integers(0, 2**63, 9).astype(np.uint64)])) for _ in range(150)]
    sets += [np.unique(rng.choice(base[:60], 30)) for _ in range(60)] + [base[:1], base[:1], base[5:7]]
    data, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    every, links = np.arange(len(sets)), 0
    for percent in (50, 80, 85, 100):
        for right in (every, every[::2], every[:5], every[155:160]):
            lists = ngram_join.Lists(data, offsets, right)
            for i in range(0, len(sets), 3):
                want = []
                for place, j in enumerate(right):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        want.append(place)
                assert lists.search(sets[i], percent).tolist() == want
                links += len(want)
    assert links > 5000


def test_long_lists_are_probed_for_candidates_only(monkeypatch):
    """Sets that share a long list but too few of the short ones are never looked at again."""
    rng = np.random.default_rng(9)
    common = rng.integers(0, 2**63, 70).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 30).astype(np.uint64)])) for _ in range(500)]
    sets.append(np.unique(np.concatenate([sets[0][:95], sets[1][:5]])))
    data, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    lists, seen = ngram_join.Lists(data, offsets, np.arange(len(sets))), []
    inside = ngram_join._is_in
    monkeypatch.setattr(ngram_join, "_is_in", lambda a, b: seen.append((len(a), len(b))) or inside(a, b))
    assert 500 in lists.search(sets[0], 80)
    assert len(seen) <= 4  # the lists of the shingles, and the few candidates


def test_near_misses_are_not_sent_as_pairs(spark):
    """Documents of a family that all but link: no more is sent for each than the lists that it is in (14), however many they are."""
    rng = random.Random(17)
    sent = []
    for n in (100, 400):
        centre = words(rng, 104)
        rows = []
        for i in range(n):  # two words of their own each: 93 of 109 shingles in common at most, 0.853, or 0.846 and less
            w = list(centre)
            w[rng.randrange(4, 50)], w[rng.randrange(54, 100)] = f"own{i}", f"other{i}"
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        same(ngram_join.jaccard_join(df, words=4, percent=87).collect(), rows, 4, 87)
        scratch = Scratch(spark)
        index = ngram_join._indexed(df, "doc_id", "text", 4, 87, ngram_join._frequent(df, "text", 4, 87)).drop("key").withColumn("id", F.xxhash64("node"))
        lists = ngram_join._lists(index, "rare", scratch).unionByName(ngram_join._lists(index, "common", scratch))
        sent.append((ngram_join._short_pairs(lists, 87).count() + ngram_join._block_forests(lists.where(f"length > {ngram_join.SHORT}"), index, 87).count()) / n)
    assert max(sent) <= 14, sent


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(1000, 2000 + i) for i in range(300)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[150] == 100 and found[2299] == 1000 and 3 in found


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    lengths = [400, 0, 300, 46, 10, 45]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    for top in (2**40, 12):
        h = rng.integers(0, top, int(ends[-1]), dtype=np.uint64) << np.uint64(20)
        for width in (5, 20, 46):
            c, left, right = passages.compact_windows(h, starts[np.diff([0, *ends]) > 0], ends[np.diff([0, *ends]) > 0], width)
            want = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                for i in range(s, e):
                    lo, hi = i, i
                    while lo > s and h[lo - 1] > h[i]:
                        lo -= 1
                    while hi + 1 < e and h[hi + 1] >= h[i]:
                        hi += 1
                    if hi - lo + 1 >= width:
                        want.append((i, min(63, i - lo), min(63, hi - i)))
            assert list(zip(c.tolist(), left.tolist(), right.tolist(), strict=True)) == want


def exact_repeats(rows, n):
    grams, text = defaultdict(set), {}
    for d, t in rows:
        text[d] = t
        w = tokens(t)
        for i in range(len(w) - n + 1):
            grams[tuple(w[i : i + n])].add(t)
    out = defaultdict(set)
    for d, t in rows:
        w = tokens(t)
        for i in range(len(w) - n + 1):
            if len(grams[tuple(w[i : i + n])]) > 1:
                out[d].update(range(i, i + n))
    return out


def test_passages(spark, docs, none, texts):
    found = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        found[r.doc_id].update(range(r.first_word, r.end_word))
        assert r.n_words >= 50
    want = exact_repeats([(r[0], r[1] or "") for r in texts], 50)
    assert want and all(want[d] <= found[d] for d in want)
    assert passages.repeated_passages(none).count() == 0
    assert 6 < len(found) < len(texts) - 8


def test_a_hot_passage_and_a_near_one(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    near = list(passage)
    near[30] = "edited"
    rows = [(i, " ".join(words(rng, 80) + (near if i == 77 else passage) + words(rng, 50))) for i in range(100)]
    rows += [(i, " ".join(words(rng, 200))) for i in range(100, 160)]
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(range(100))


def test_a_passage_that_the_first_text_of_its_group_has_otherwise(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(12):
        passage = words(rng, 60)
        other = list(passage)
        other[20], other[40] = "edited", "changed"
        texts += [" ".join(words(rng, 30) + p + words(rng, 30)) for p in [other] + 20 * [passage]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = defaultdict(set)
    for r in passages.repeated_passages(df).collect():
        found[r.doc_id].update(range(r.first_word, r.end_word))
    want = exact_repeats(rows, 50)
    assert len(want) == 240 and all(want[d] <= found[d] for d in want)
    left = passages.cut_repeats(df).select("doc_id", "text").collect()
    assert not any(exact_repeats([tuple(r) for r in left], 50).values())


def test_a_passage_more_often_in_one_text_than_in_the_other():
    rng = np.random.default_rng(4)
    passage, *rest = np.split(rng.integers(0, 2**32, 460, dtype=np.uint32), range(60, 460, 80))
    once = np.concatenate([rest[0], passage, rest[1]])
    twice = np.concatenate([rest[2], passage, rest[3], passage, rest[4]])
    pieces = np.concatenate([*np.split(passage, 6)[::-1], rest[2], passage, rest[3]])  # its tokens are elsewhere before
    for a, b in ((once, twice), (twice, once), (twice, twice), (once, pieces), (pieces, once), (pieces, pieces)):
        sides = set(), set()
        for s, e, lo, hi in passages.shared_passages(a, b, 46):
            sides[0].update(range(s, e))
            sides[1].update(range(lo, hi))
        for text, found in zip((a, b), sides, strict=True):
            runs = [i for i in range(len(text) - 59) if (text[i : i + 60] == passage).all()]
            assert runs and all(set(range(i, i + 60)) <= found for i in runs)


def test_cut_of_a_passage_that_a_later_text_has_twice(spark):
    rng = random.Random(23)
    p, a, b, c = words(rng, 60), words(rng, 30), words(rng, 30), words(rng, 30)
    df = spark.createDataFrame([(1, " ".join(words(rng, 20) + p)), (2, " ".join(a + p + b + p + c))], "doc_id long, text string")
    by = {r.doc_id: r.text for r in passages.cut_repeats(df).collect()}
    assert by[2].split() == a + b + c


def test_cut(docs, texts):
    rows = passages.cut_repeats(docs).collect()
    assert set(rows[0].asDict()) == set(docs.columns)
    left = exact_repeats([(r.doc_id, r.text or "") for r in rows], 50)
    assert not any(left.values())
    by = {r.doc_id: r for r in rows}
    assert by[0].text == texts[0][1] and 25 not in by and 26 not in by
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert any(r.text is None for r in rows) and None in by


def test_cut_keeps_other_words(spark):
    rng = random.Random(9)
    p, a, b = words(rng, 60), words(rng, 30), words(rng, 30)
    df = spark.createDataFrame([(1, " ".join(words(rng, 20) + p)), (2, " ".join(a) + "\n" + " ".join(p) + "\n" + " ".join(b))], "doc_id long, text string")
    by = {r.doc_id: r.text for r in passages.cut_repeats(df).collect()}
    assert by[2].split() == a + b


def edited(rng, passage, kind, n):
    """passage with n words replaced, inserted or dropped, at places apart from each other."""
    out = list(passage)
    for i in sorted(rng.sample(range(1, len(passage) - 1, 6), n), reverse=True):
        out[i : i + (kind != "insert")] = [] if kind == "drop" else ["".join(words(rng, 2))]
    return out


def test_near_passages_are_found(spark):
    """Pairs of texts with passages of a similarity of 0.8 and more: 95 in 100 of each kind at least."""
    rng = random.Random(41)
    rows, kinds = [], [(50, "replace", 1), (52, "insert", 1), (54, "drop", 1), (60, "replace", 1), (100, "replace", 2), (100, "insert", 2), (100, "drop", 2), (100, "replace", 0)]
    for kind in kinds:
        for _ in range(60):
            passage = words(rng, kind[0])
            for p in (passage, edited(rng, passage, *kind[1:])):
                a, b = words(rng, rng.randint(0, 60)), words(rng, rng.randint(0, 60))
                rows.append((len(rows), " ".join(a + p + b), kinds.index(kind), len(a), len(p)))
    alike = [len(shingles(" ".join(x[1].split()[x[3] : x[3] + x[4]]), 5) & shingles(" ".join(y[1].split()[y[3] : y[3] + y[4]]), 5)) for x, y in zip(rows[::2], rows[1::2], strict=True)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    found = defaultdict(set)
    for r in passages.repeated_passages(df).collect():
        found[r.doc_id].update(range(r.first_word, r.end_word))
    for k, kind in enumerate(kinds):
        pairs = [(x, y) for x, y, n in zip(rows[::2], rows[1::2], alike, strict=True) if x[2] == k and n >= 0.8 * (x[4] + y[4] - 8 - n)]
        caught = sum(all(len(found[r[0]] & set(range(r[3], r[3] + r[4]))) >= 0.9 * r[4] for r in p) for p in pairs)
        assert len(pairs) >= 40 and caught >= 0.95 * len(pairs), (kind, caught, len(pairs))
    beyond = sum(len(found[r[0]] - set(range(r[3] - 5, r[3] + r[4] + 5))) for r in rows)
    assert beyond == 0


def test_longer_passages_of_pairs_around_a_common_one(spark):
    """A passage that 30 texts have, and longer ones around it that pairs of them have: what is found is what brute force finds, both ways."""
    rng = random.Random(43)
    common, rows = words(rng, 60), []
    for more in (10, 30, 45):
        for _ in range(10):
            extra = words(rng, more)
            rows += [" ".join(words(rng, 20) + common + extra + words(rng, 20)) for _ in range(2)]
    for _ in range(10):
        extra = words(rng, 12)
        rows += [" ".join(words(rng, 20) + extra + common + words(rng, 20)) for _ in range(2)]
    rows = list(enumerate(rows))
    found = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        found[r.doc_id].update(range(r.first_word, r.end_word))
    assert found == exact_repeats(rows, 50)


def test_variants_of_a_common_passage(spark):
    """40 texts with a passage, 40 with one word of it changed, each another: the variants are near the passage, not each other."""
    rng = random.Random(47)
    passage, rows = words(rng, 60), []
    for i in range(80):
        p = passage if i % 2 else edited(rng, passage, "replace", 1)
        rows.append((i, " ".join(words(rng, 30) + p + words(rng, 30))))
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 76


def variants(rng, pairs):
    """Pairs of texts with a variant of one 54-word passage: words 9 and 45 are the pair's own, and the second's word 27 is its own too (0.82)."""
    passage, rows = words(rng, 54), []
    for _ in range(pairs):
        p = list(passage)
        p[9], p[45] = ("".join(words(rng, 3)) for _ in range(2))
        q = list(p)
        q[27] = "".join(words(rng, 3))
        for v in (p, q):
            rows.append((len(rows), " ".join(words(rng, 30) + v + words(rng, 30))))
    return rows


@pytest.mark.parametrize("pairs", [16, 40, 200])
def test_pairs_of_variants_in_long_groups(spark, pairs):
    """Of texts that are like one other text only, in groups of hundreds that hold the same common words, 95 in 100 are found."""
    rows = variants(random.Random(61), pairs)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.n_words for r in passages.repeated_passages(df).collect() if r.n_words >= 50}
    assert len(found) >= 0.95 * len(rows)


def test_blocks_and_sent_windows(spark, monkeypatch):
    """Groups of many blocks, and windows that are sent to their texts because the filter would be too small, give as much."""
    monkeypatch.setattr(passages, "WINDOWS", 16)
    monkeypatch.setattr(passages, "FILTER_SHARE", 1 << 40)
    rng = random.Random(67)
    rows = variants(rng, 40)
    common = words(rng, 60)
    rows += [(1000 + i, " ".join(words(rng, 20) + common + words(rng, 20))) for i in range(40)] + [(2000, "short"), (2001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id for r in passages.repeated_passages(df).collect()}
    assert len(found) >= 115 and set(range(1000, 1040)) <= found


@pytest.mark.parametrize("columns", [16, 2048])
def test_values_in_common(monkeypatch, columns):
    """Counts of values in common, those of few windows pair by pair or all by products, are those of the sets."""
    monkeypatch.setattr(passages, "COLUMNS", columns)
    rng = np.random.default_rng(73)
    values = rng.integers(0, 500, 60 * 30).astype(np.uint16)
    owner = np.repeat(np.arange(60), 30)
    sets = [set(values[owner == k].tolist()) for k in range(60)]
    wide = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for left, right in ((np.arange(60), np.arange(60)), (np.arange(0, 60, 2), np.arange(1, 60, 2)), (np.array([3]), np.array([7, 9]))):
        want = np.array([[len(sets[i] & sets[j]) for j in right] for i in left])
        apart = left[:, None] != right[None]
        for kind in (values, wide):
            assert (passages._in_common(kind, owner, left, right) == want)[apart].all()


def test_windows_are_searched_as_by_brute_force():
    """Which windows of a block have a passage in common, and none of it is the same run: the forest joins just these."""
    rng = np.random.default_rng(71)
    base, rows = rng.integers(0, 2**16, 97).astype(np.uint16), []
    for k in range(60):
        t = base.copy()
        for at in rng.choice(np.arange(3, 94), 6 if k % 2 else 1, replace=False):
            t[at : at + 5] = rng.integers(0, 2**16, len(t[at : at + 5]))
        if k % 5 == 0:
            t = np.insert(t, 30, rng.integers(0, 2**16, 1).astype(np.uint16))[:97]
        rows.append(t)
    place = (100 << 32) | (48 << 24) | (48 << 16)
    table = pa.table({"b": pa.array([0] * 60, pa.int32()), "i": pa.array([0] * 60, pa.int32()), "j": pa.array([0] * 60, pa.int32()), "place": pa.array([place] * 60), "tokens": pa.array([r.tobytes() for r in rows], pa.binary())})
    left, right = passages.search_windows(table, 46)
    parts = lambda edges: join_labels(np.arange(60), *(np.array(x, np.int64) for x in zip(*edges, strict=True)))
    same = [(x, y) for x in range(60) for y in range(x) if any((rows[x][i : i + 46].tobytes() in rows[y].tobytes()) for i in range(52))]
    alike = lambda x, y: passages.shared_passages(rows[x].astype(np.uint32), rows[y].astype(np.uint32), 46)
    near = [(x, y) for x in range(60) for y in range(x) if alike(x, y) or alike(y, x)]
    found = parts([*same, *zip(left.tolist(), right.tolist(), strict=True)])
    assert (found == parts([*same, *near])).all() and len(set(found.tolist())) > 5 and 5 < len(left) < 60 and all((max(p), min(p)) in near for p in zip(left.tolist(), right.tolist(), strict=True))


def test_searched_windows_lose_no_link():
    """Each place of a window is told to be shared, and with the least text that has it, as by comparing every pair: a chain's ends, and a gap of two words in the middle."""
    rng = np.random.default_rng(73)
    fresh = lambda k: rng.integers(0, 2**16, k).astype(np.uint16)
    base, rows = fresh(97), []
    for k in range(120):
        t = base.copy()
        for at in rng.choice(np.arange(3, 94), int(rng.integers(1, 5)), replace=False):
            t[at : at + 5] = fresh(len(t[at : at + 5]))
        if k % 5 == 0:
            t = np.insert(t, 30, fresh(int(rng.integers(1, 4))))[:97]
        if k % 3 == 0:  # a passage with ends of its own around it
            a, b = int(rng.integers(0, 30)), int(rng.integers(70, 97))
            t = np.concatenate([fresh(a), t[a:b], fresh(97 - b)])
        rows.append(t)
    passage = fresh(60)
    for _ in range(2):  # 54 of 60 tokens in common, 40 of any 46 in a row
        t = np.concatenate([fresh(18), passage, fresh(19)])
        t[45:51] = fresh(6)
        rows.append(t)
    n, place = len(rows), (100 << 32) | (48 << 24) | (48 << 16)
    ids = rng.permutation(n) * 10
    column = lambda x, kind=None: pa.array(x, kind)
    table = pa.table({"b": column([0] * n, pa.int32()), "i": column([0] * n, pa.int32()), "j": column([0] * n, pa.int32()), "id": column(ids), "place": column([place] * n), "tokens": column([r.tobytes() for r in rows], pa.binary())})

    def told(pairs, widened):
        least = np.full((n, 97), 10 * n)
        for x in range(n):  # runs of 46 are found otherwise
            for y in range(n):
                if x != y and ids[y] < least[x].max():
                    for s, e, _ in passages._same_stretches(rows[x].astype(np.uint32), rows[y].astype(np.uint32), 46):
                        least[x, s:e] = np.minimum(least[x, s:e], ids[y])
        for x, y in pairs:
            x, y = (x, y) if ids[x] < ids[y] else (y, x)
            for s, e, lo, hi in passages.shared_passages(rows[x].astype(np.uint32), rows[y].astype(np.uint32), 46):
                for me, other, u, v in ((x, y, s, e), (y, x, lo, hi)):  # without the tokens that widen a short one
                    own = (u, v - 1) if widened else u + np.flatnonzero(np.isin(rows[me][u:v], rows[other]))[[0, -1]]
                    least[me, own[0] : own[1] + 1] = np.minimum(least[me, own[0] : own[1] + 1], ids[other])
        return least

    left, right = passages.search_windows(table, 46)
    found, want = told(zip(left.tolist(), right.tolist(), strict=True), True), told(((x, y) for x in range(n) for y in range(x)), False)
    assert (found <= want).all() and (found[-1] < 10 * n).sum() >= 60 and len(left) < 6 * n


def test_straight_windows_are_not_compared_one_by_one(monkeypatch):
    """Pairs with all like tokens in place are read off these; small groups searched at once give what each gives alone, and what comparing every pair tells."""
    rng = np.random.default_rng(79)
    compared, tables, values = [], [], iter(np.split(rng.permutation(2**16).astype(np.uint16)[:65000], 6500))
    for name in ("shared_passages", "_shared_passages"):
        if real := getattr(passages, name, None):
            monkeypatch.setattr(passages, name, lambda *x, real=real: compared.append(1) or real(*x))
    for sig in range(10):
        base, rows = np.concatenate([next(values) for _ in range(10)])[:97], []
        for _ in range(12):
            t = base.copy()
            for at in rng.choice(np.arange(3, 90), int(rng.integers(1, 4)), replace=False):
                t[at : at + 4] = next(values)[:4]
            rows.append(t.tobytes())
        zeros, place = pa.array([0] * 12, pa.int32()), (100 << 32) | (48 << 24) | (48 << 16)
        tables.append(pa.table({"sig": [sig] * 12, "i": zeros, "j": zeros, "b": zeros, "id": rng.permutation(12), "place": [place] * 12, "tokens": pa.array(rows, pa.binary())}))

    def pairs(table):
        left, right = passages.search_windows(table, 46)
        return {(table["sig"][x].as_py(), *sorted((table["id"][x].as_py(), table["id"][y].as_py()))) for x, y in zip(left.tolist(), right.tolist(), strict=True)}

    alone = set().union(*(pairs(t) for t in tables))
    assert len(alone) > 60 and not compared
    together = list(passages._together(iter(tables)))
    assert len(together) < 4 and set().union(*(pairs(t) for t in together)) == alone and not compared
    for t in tables:
        sig, ids = t["sig"][0].as_py(), t["id"].to_pylist()
        rows = dict(zip(ids, (np.frombuffer(x, np.uint16) for x in t["tokens"].to_pylist()), strict=True))
        alike = {(x, y) for x in ids for y in ids if x < y and passages.shared_passages(rows[x], rows[y], 46)}
        assert {(x, y) for s, x, y in alone if s == sig} <= alike
        same = {(x, y) for x in ids for y in ids if x < y and passages._same_stretches(rows[x], rows[y], 46)}
        assert {x for p in alike for x in p} == {x for p in same | {(x, y) for s, x, y in alone if s == sig} for x in p}


def test_what_first_pairs_tell_leaves_few_to_bound(monkeypatch):
    """Of a family of variants of one passage most pairs are known by the first ones, and get no bounds of their own; what is told is as much as by bounding all."""
    rng, bounded = np.random.default_rng(83), []
    for name in ("_best_stretch", "_within"):
        monkeypatch.setattr(passages, name, lambda hit, *x, real=getattr(passages, name): bounded.append(len(hit)) or real(hit, *x))
    base, rows = rng.permutation(2**16)[:97].astype(np.uint16), []
    for _ in range(90):
        t = base.copy()
        for at in rng.choice(np.arange(3, 90), 2, replace=False):
            t[at : at + 3] = rng.integers(0, 2**16, 3)
        rows.append(t)
    zeros, place = pa.array([0] * 90, pa.int32()), (100 << 32) | (48 << 24) | (48 << 16)
    table = pa.table({"i": zeros, "j": zeros, "b": zeros, "id": rng.permutation(90), "place": [place] * 90, "tokens": pa.array([t.tobytes() for t in rows], pa.binary())})
    told = passages.search_windows(table, 46)
    assert sum(bounded) < 90 * 89 // 4
    monkeypatch.setattr(passages, "FIRST", 1 << 20)
    pairs = lambda found: {tuple(sorted(p)) for p in zip(*(x.tolist() for x in found), strict=True)}
    assert pairs(passages.search_windows(table, 46)) == pairs(told) and len(told[0]) >= 30


def test_windows_of_any_width_without_sorting(monkeypatch):
    """The places of compact windows come in their order, whatever the width, and none twice."""
    rng = np.random.default_rng(89)
    monkeypatch.setattr(np, "unique", lambda *_: pytest.fail("places are sorted anew"))
    for width in (1, 2, 31, 46, 64, 65, 90, 128, 129, 200):
        lens = rng.integers(1, 300, 6)
        ends = np.cumsum(lens)
        starts, h = ends - lens, rng.integers(0, 2**63, ends[-1]).astype(np.uint64)
        c, left, right = passages.compact_windows(h, starts, ends, width)
        low = int((1 << len(h).bit_length()) - 1)
        unlike = [(int(x) & ~low) | k for k, x in enumerate(h)]
        want = sorted({min(range(p, p + width), key=unlike.__getitem__) for s, e in zip(starts, ends, strict=True) for p in range(s, e - width + 1)})
        assert c.tolist() == want
        for k, l_, r in zip(c.tolist(), left.tolist(), right.tolist(), strict=True):
            assert min(unlike[k - l_ : k + r + 1]) == unlike[k]


def test_cut_shuffles_no_texts_for_few_cuts(spark):
    rng = random.Random(59)
    p = " ".join(words(rng, 60))
    rows = [(k, f"{' '.join(words(rng, 20))} {p} {k}") for k in range(6)] + [(5, "one"), (6, p), (6, p)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        cut = passages.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = cut._jdf.queryExecution().executedPlan().toString()
        found = sorted((r.doc_id, len(r.text.split())) for r in cut.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert found == sorted([(0, 81), *((k, 21) for k in range(1, 6)), (5, 1)])


def test_cut_keeps_columns_of_any_name(spark, none):
    rng = random.Random(53)
    p = " ".join(words(rng, 60))
    rows = [(1, p, "a", "x", 1), (2, "begin " + p + " end", "b", "y", 2), (2, "begin " + p + " end", "b", "y", 2), (3, None, "c", "z", 3), (4, "", "d", "w", 4), (None, p, "e", "v", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 string, cuts string, first int")
    found = sorted(passages.cut_repeats(df).collect(), key=lambda r: r.first)
    assert [tuple(r) for r in found] == [(1, p, "a", "x", 1), (2, "begin  end", "b", "y", 2), (3, None, "c", "z", 3), (4, "", "d", "w", 4)] or [r.text.split() for r in found if r.doc_id == 2] == [["begin", "end"]]
    assert [r.doc_id for r in found] == [1, 2, 3, 4]
    assert passages.cut_repeats(none).count() == 0


def test_large_families_are_searched_by_lists(monkeypatch):
    """Of a family of 700 variants few pairs are looked at, and each place is told to be shared, with the least text that has it, as by counting all against all."""
    rng = np.random.default_rng(89)
    base, rows = rng.permutation(2**16)[:97].astype(np.uint16), []
    for k in range(700):
        t = base.copy()
        for at in rng.choice(np.arange(3, 90), int(rng.integers(1, 4)), replace=False):
            t[at : at + 5] = rng.integers(0, 2**16, 5)
        if k % 9 == 0:
            t = np.insert(t, 30, rng.integers(0, 2**16, int(rng.integers(1, 4))).astype(np.uint16))[:97]
        if k % 4 == 0:
            t[int(rng.integers(60, 97)) :] = rng.integers(0, 2**16)
        rows.append(t)
    rows += [np.concatenate([np.repeat(rng.integers(0, 2**16, 4).astype(np.uint16), 24), t[:1]]) for t in rows[:100]]  # with few different tokens
    n, place = len(rows), (100 << 32) | (48 << 24) | (48 << 16)
    zeros, looked, real = pa.array([0] * n, pa.int32()), [], passages._best_stretch
    table = pa.table({"i": zeros, "j": zeros, "b": zeros, "id": rng.permutation(n), "place": [place] * n, "tokens": pa.array([t.tobytes() for t in rows], pa.binary())})
    halves = table.set_column(1, "j", pa.array([1] * n, pa.int32())).set_column(2, "b", pa.array(rng.integers(0, 2, n), pa.int32()))
    monkeypatch.setattr(passages, "_best_stretch", lambda x, *rest: looked.append(len(x)) or real(x, *rest))

    def told(some, pairs, widened):
        search = passages._Search(some, 46)
        search.open()
        for x, y in pairs:
            for s, e, lo, hi in passages.shared_passages(rows[x].astype(np.uint32), rows[y].astype(np.uint32), 46):
                for me, other, u, v in ((x, y, s, e), (y, x, lo, hi)):  # without the tokens that widen a short one
                    own = (u, v - 1) if widened else u + np.flatnonzero(np.isin(rows[me][u:v], rows[other]))[[0, -1]]
                    part = search.known[me, own[0] : own[1] + 1]
                    np.minimum(part, search.ids[other], out=part)
        return search.known

    for some in (table, halves):
        monkeypatch.setattr(passages, "DENSE", 256)
        looked.clear()
        found = list(zip(*(x.tolist() for x in passages.search_windows(some, 46)), strict=True))
        few = sum(looked)
        monkeypatch.setattr(passages, "DENSE", 1 << 20)
        looked.clear()
        every = list(zip(*(x.tolist() for x in passages.search_windows(some, 46)), strict=True))
        assert few < 0.7 * sum(looked) and few < n * n // 6 and len(found) >= 300
        assert (told(some, found, True) <= told(some, every, False)).all()


def test_windows_of_few_different_tokens_are_not_sent(spark):
    """Windows that have too few different tokens for any near passage are told by their runs only; what is found stays."""
    rng = random.Random(97)
    junk, rows = words(rng, 3), []
    for i in range(40):
        other = words(rng, 1)
        rows.append((i, " ".join([junk[0]] * 60 + other * 120 + [junk[1]] * 60)))
    texts = spark.createDataFrame(rows, "id long, text string")
    windows = passages._windows(texts, 46)
    shared = passages._shared(windows, passages.Scratch(spark))
    found = passages._found_again(shared.where("n > 16").select("sig", "id", "place"), lambda ids: texts.join(ids, "id", "left_semi"), 46, passages.Scratch(spark))
    assert found.where("kind = 0").count() and not found.where("kind = 1").count()
    spans = {r.doc_id: r.n_words for r in passages.repeated_passages(texts.withColumnRenamed("id", "doc_id")).collect()}
    assert len(spans) == 40 and min(spans.values()) >= 56
