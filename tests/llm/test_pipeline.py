"""The pipeline's stages against brute force, each on what the one before kept."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from tessella.llm import common, packing

from .conftest import words
from .test_native import brute_mix
from .test_pairs import brute_components, exact_repeats


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        w = words(rng, rng.randint(60, 120))
        if i % 6 == 0:
            w[3], w[40] = "vilewo", "grimbo"
        if i // 6 % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
        rows.append([i, " ".join(w), "en", f"s{i % 3}", 0])
    passage = " ".join(words(rng, 70))
    for i in (1, 2, 3, 7):
        rows[i][1] += " " + passage
    rows += [[400 + k, rows[k][1] + " end", "en", "s0", 0] for k in (8, 9, 10)] + [[410, rows[11][1], "en", "s1", 0], [411, None, None, None, None]]
    rows = [(i, t, a, s, len(t) if t else None) for i, t, a, s, _ in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kept = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept = [tuple(r) for r in docs.collect()]
        ids = Counter(r[0] for r in kept)
        if name != "packing":
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        if name == "toxicity":
            toxic = {r[0] for r in before if r[0] < 400 and r[0] % 6 == 0}
            assert len(toxic & set(ids)) <= 2 and len(before) - len(toxic) - len([r for r in kept if r[0] not in toxic]) <= 4
        elif name == "ngram_jaccard":
            assert set(ids) == {d for d, _, c, _ in brute_components(before, 5, 80) if d == c} and max(ids.values()) == 1
        elif name == "substring_dedup":
            assert not any(exact_repeats([(r[0], r[1] or "") for r in kept], 50).values())
            text = {r[0]: r[1] for r in before}
            first = min(d for d in (1, 2, 3, 7) if d in text)
            assert all(r[1] == text[r[0]] for r in kept if r[0] not in (1, 2, 3, 7) or r[0] == first) and set(ids) == set(text)
        elif name == "mixing":
            size, by, target = brute_mix(before)
            words_of = {r[0]: size[i] for i, r in enumerate(before)}
            for s, most in target.items():
                taken = sum(words_of[r[0]] for r in kept if r[3] == s)
                assert abs(taken - most) <= max(size.values())
        else:
            copies = Counter(r[0] for r in before)
            starts = Counter(r[0] for r in kept if r[1] == 0)
            assert starts == copies
    last = corpus_pipeline.run(spark, sf)
    assert last.count() == len(kept) and set(last.columns) >= {"doc_id", "sequence_id", "offset"}
    assert packing.default_vocabulary()


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, other columns of clashing names; then no rows at all."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rng = random.Random(3)
    rows = [(1, "one", None, "s", 3, 7, "x"), (None, "one two", "en", None, None, None, None), (2, None, "en", "s", 0, 1, "y"), (3, "", None, None, 0, 1, "z"), (4, " ".join(words(rng, 20000)), "en", "s", 9, 1, "w")]
    rows += [(5, " ".join(words(rng, 80)), "en", "t", 9, 2, "v")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, _row string")
    for docs, empty in ((df, False), (df.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, stage(spark, docs, sf)
            assert name == "packing" or docs.columns == before
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert not ids if empty else {4, 5} <= ids <= {1, None, 2, 3, 4, 5}
            if not empty and name in ("toxicity", "ngram_jaccard", "substring_dedup"):
                assert ids == {1, None, 2, 3, 4, 5} and docs.where("doc_id = 5").count() == (3 if name == "toxicity" else 1)


def test_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    """In every stage that sends texts, and in packing by itself, which leaves the session's setting as it was; a session's own limit stays."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 2000) AS text", "'s' AS source")
    few = docs.limit(3)

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)

    def largest():
        return max(r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect())

    seen, write = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, tag: seen.append(largest()) or write(df, tag))
    bound = common.BATCH_BYTES * 1.25
    try:
        spark.conf.unset(common.BATCHES)
        packing.pack(few, packing.default_vocabulary())
        assert seen.pop() <= bound < largest() and spark.conf.get(common.BATCHES, None) is None
        for name, stage in corpus_pipeline.STAGES:
            if name != "mixing":  # sends none
                spark.conf.unset(common.BATCHES)
                stage(spark, few, sf)
                assert largest() <= bound
        spark.conf.set(common.BATCHES, "1m")
        corpus_pipeline.pack(spark, few, sf)
        assert spark.conf.get(common.BATCHES) == "1m"
    finally:
        spark.conf.unset(common.BATCHES)


def test_a_worker_that_packs_frees_the_tables_of_stages_before():
    common._powers(10)
    packing.word_ids.cache_clear()
    words_of = packing.word_ids(packing.default_vocabulary())
    assert not common._POWERS and words_of.text("one two")
    assert len(common._powers(10)[0]) > 10
