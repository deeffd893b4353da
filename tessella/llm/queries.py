"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, extract, fingerprints, media, mixing, negatives, ngram_join, packing, passages, shards, spans, toxicity, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), 24)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, payloads=False)
    digest = F.when(~F.col("digest_ok"), F.raise_error(F.concat(F.lit("a payload isn't what was written: "), "record_id"))).otherwise(F.col("payload_digest"))
    return records.select(F.expr("nullif(record_id, '')").cast("long").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_vocabulary())


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id", "links")


def op8_lookup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, models).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_media(table(spark, sf_dir, "documents"))
    rows = media.media_rows(stored, ("doc_id", "n_bytes"))
    clips = F.transform("clips", lambda c: F.concat_ws("+", c["first_frame"].cast("string"), c["n_frames"].cast("string")))
    shares = F.transform("histogram", lambda x: F.format_string("%.4f", x))
    feature = F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(";clips="), F.concat_ws(",", clips), F.lit(";histogram="), F.concat_ws(",", shares))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def op12_personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.find_spans(table(spark, sf_dir, "documents"))
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in spans.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster(table(spark, sf_dir, "embeddings"))


_ALL = (op1_jump_shards, op2_warc_archives, op3_repeated_passages, op4_mix_sources, op5_pack_windows, op6_main_text, op7_ngram_jaccard, op8_lookup_sketches, op9_toxicity, op10_motion_jpeg, op11_hard_negatives, op12_personal_spans, op13_ball_clusters)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

SQL_SHARDS = r"""
WITH RECURSIVE
table_of AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, n + 8 AS size,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM bytes, table_of),
jumps(doc_id, k, b, j, own) AS (
  SELECT doc_id, (doc_id::HUGEINT % 18446744073709551616 + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT, -1::BIGINT FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, m, j, floor((j + 1) * (2147483648.0::DOUBLE / ((m // 8589934592) + 1)::DOUBLE))::BIGINT, CASE WHEN j < 24 THEN j ELSE own END
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS m FROM jumps WHERE j <= 24)),
homes AS (SELECT doc_id, own AS shard, b AS grown_shard FROM jumps WHERE j > 24)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ((text_crc32 + (doc_id % 256 + 256) % 256) % 256), doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM sums JOIN homes USING (doc_id)
"""

SQL_MIX = r"""
WITH slim AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
sized AS (SELECT src, sum(size)::BIGINT AS source_size FROM slim GROUP BY src),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM sized),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv
  FROM weighed WINDOW o AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT src, source_size, CASE WHEN cap > lv * w THEN (max(CASE WHEN cap > lv * w THEN lv END) OVER ()) * w ELSE cap END AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_times FROM aimed),
fine AS (SELECT src, h >> 24 AS p, sum(size) AS n FROM slim GROUP BY ALL),
summed AS (
  SELECT f.*, sum(n) OVER (PARTITION BY src ORDER BY p) AS upto, target - full_times * source_size AS rest FROM fine f JOIN plan USING (src)),
edge AS (SELECT src, min(p) AS p, arg_min(upto, p) AS upto, arg_min(n, p) AS n, any_value(rest) AS rest FROM summed WHERE upto > rest GROUP BY src),
cut AS (SELECT src, CASE WHEN upto - rest < rest - (upto - n) THEN p + 1 ELSE p END AS lim FROM edge)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (full_times + CASE WHEN h >> 24 < coalesce(lim, 68719476736) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM slim JOIN plan USING (src) LEFT JOIN cut USING (src)
"""

SQL_WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) || '00' AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 3))::INT >> (7 - (5 * i) % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p
"""

SQL_JOIN = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS grams FROM w),
docs AS (SELECT doc_id, grams, len(grams)::BIGINT AS n, CASE WHEN len(grams) > 0 THEN md5(array_to_string(grams, '|')) END AS node FROM g),
nodes AS (SELECT node, any_value(grams) AS grams, any_value(n) AS n, min(doc_id) AS first FROM docs WHERE node IS NOT NULL GROUP BY node),
posts AS (SELECT node, n, unnest(grams) AS gram FROM nodes),
links AS (
  SELECT a.node AS x, b.node AS y FROM posts a JOIN posts b ON a.gram = b.gram AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT node, node FROM nodes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
roots AS (SELECT x AS node, min(first) AS component_id FROM reach JOIN nodes ON node = y GROUP BY x),
degrees AS (SELECT x AS node, count(*) AS links FROM links GROUP BY x)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(links, 0)::BIGINT AS links
FROM docs LEFT JOIN roots USING (node) LEFT JOIN degrees USING (node)
"""

SQL_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS "rank", other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds of op13, one after the other: a<r> has each vector's centroid, m<r> the centroids that it moves to."""
    away = "list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, arg_min(n, (d, n)) AS n, min(d) AS d FROM (SELECT vec_id, q, n, ({away})::BIGINT AS d FROM v, m{r}) GROUP BY vec_id, q)")
        if r < rounds:
            moved = f"SELECT n, list(x ORDER BY i) AS c FROM (SELECT n, i, floor(sum(q[i]) / count(*)) AS x FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY n, i) GROUP BY n"
            steps.append(f"m{r + 1} AS MATERIALIZED (SELECT o.n, coalesce(w.c, o.c) AS c FROM m{r} o LEFT JOIN ({moved}) w USING (n))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS n, q AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k}),
{", ".join(steps)},
digests AS (SELECT n, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM m{rounds})
SELECT vec_id, n::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN digests USING (n)
"""


def _sketches_sql() -> str:
    """op8: cells of three parts of 16, and the likeness of the sets of digests, which peeling recovers."""
    mask30, mask31, p = (1 << 30) - 1, (1 << 31) - 1, fingerprints.MODULUS

    def hashed(a: int, b: int) -> str:
        y = f"(((d >> 30) * {a} + (d & {mask30}) * {b}) % {p})"
        return f"(({y} >> 31) * {b} + ({y} & {mask31}) * {a}) % {p}"

    third = fingerprints.CELLS // 3
    cells = " UNION ALL ".join(f"SELECT doc_id, kind, d, {hashed(*f)} % {third} + {k * third} AS cell FROM u" for k, f in enumerate(fingerprints.FACTORS))
    near = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    differ = lambda a, b: f"(len({a}) + len({b}) - 2 * len(list_intersect({a}, {b})))::BIGINT"
    digests = lambda t: f"list_distinct(list_transform(regexp_extract_all({t}, '[^\\n]{{1,{fingerprints.PARAGRAPH}}}'), lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM t WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(nx, 1, n // 2) AS ed FROM n),
s AS MATERIALIZED (SELECT doc_id, n, sha256(ed) AS edited_sha256, {digests('t')} AS a, {digests('ed')} AS b, {digests('nx')} AS c FROM e),
u AS (SELECT doc_id, 0 AS kind, unnest(a) AS d FROM s UNION ALL SELECT doc_id, 1, unnest(b) FROM s),
c AS ({cells}),
g AS (SELECT doc_id, kind, cell, count(*) AS m, bit_xor(d) AS k, bit_xor({hashed(*fingerprints.CHECK)}) AS x FROM c GROUP BY ALL),
f AS (SELECT doc_id, kind, string_agg(cell || ':' || m || ':' || format('{{:X}}', k) || ':' || format('{{:X}}', x), ',' ORDER BY cell) AS cells FROM g GROUP BY ALL)
SELECT s.doc_id, n::BIGINT AS n_chars, edited_sha256, '{fingerprints.CELLS}/' || len(a) || '/' || coalesce(o.cells, '') AS fingerprint, '{fingerprints.CELLS}/' || len(b) || '/' || coalesce(w.cells, '') AS edited_fingerprint,
  {near('a', 'b')} AS near_edited, {near('a', 'c')} AS near_next, {differ('a', 'b')} AS differ_edited, {differ('a', 'c')} AS differ_next
FROM s LEFT JOIN f o ON o.doc_id = s.doc_id AND o.kind = 0 LEFT JOIN f w ON w.doc_id = s.doc_id AND w.kind = 1
"""


SQL: dict[str, str] = {"op1_jump_shards": SQL_SHARDS, "op2_warc_archives": SQL_WARC, "op4_mix_sources": SQL_MIX, "op7_ngram_jaccard": SQL_JOIN, "op8_lookup_sketches": _sketches_sql(), "op11_hard_negatives": SQL_NEGATIVES, "op13_ball_clusters": _clusters_sql()}
