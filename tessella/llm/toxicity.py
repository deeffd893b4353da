"""Toxicity by non-negative positive-unlabelled learning (nnPU) of hashed word and word-start features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, column_bytes, trimmed, word_start_hashes

#: Features are hashed to 2**BITS weights: each word, and its first 4, 5 and 6 bytes.
BITS, STARTS = 18, (4, 5, 6)
#: Documents that the models are fitted on, about: confirmed toxic ones, and any ones, taken without their labels.
POSITIVES, UNLABELLED = 4000, 8000
#: Models, each fitted in a task of its own with another order of steps; their scores are averaged.
MODELS = 3
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each word and word start; not distinct."""
    hashes, first, starts = word_start_hashes(data, offsets, _SEPARATORS, STARTS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    all_ = [hashes, *starts]
    mask = np.uint64((1 << BITS) - 1)
    return np.concatenate([doc] * len(all_)), np.concatenate([(h >> np.uint64(7 + i)) & mask for i, h in enumerate(all_)]).astype(np.int64)


def distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(doc << BITS | feature)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _lift(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """From the counts of features in n_p positives and n_u unlabelled texts, the log of each one's rate among positives over its rate among negatives, as the unlabelled give it, less three deviations (of their logs)."""
    rate_p, rate_u = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1)
    rate_n = np.maximum((rate_u - prior * rate_p) / (1 - prior), 0.5 / (n_u + 1))
    return np.log(rate_p / rate_n) - 3.0 * np.sqrt(1 / (p + 0.5) + 1 / (u + 0.5))


def steps(f: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores f, of n_p positives and then unlabelled texts, and the slope to go down along for each score.

    The risk is prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]) with the sigmoid loss l(z) = 1 / (1 + exp(z)).
    Where the second part is below 0, the slope is that of its negative alone, which brings it back.
    """
    s = 1 / (1 + np.exp(-f))  # l(-f); l(f) is 1 - s
    slope = s * (1 - s)
    p, u = slope[:n_p] / n_p, slope[n_p:] / (len(f) - n_p)
    rest = s[n_p:].mean() - prior * s[:n_p].mean()
    risk = prior * (1 - s[:n_p].mean()) + max(0.0, rest)
    return float(risk), np.concatenate([-2 * prior * p, u] if rest >= 0 else [prior * p, -u])


def fit(features: np.ndarray, sizes: np.ndarray, positive: np.ndarray, prior: float, seed: int, epochs: int = 60, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model of feature presence, by the non-negative risk estimator.

    features has the distinct features of text after text, sizes their numbers, and positive tells the confirmed
    texts from the unlabelled.  Features have a weight if their rate among positives is surely several times that
    among negatives.  Without positives or unlabelled texts there are no weights, and a bias that rejects nothing.
    """
    rng = np.random.default_rng(seed)
    w, b = np.zeros(1 << BITS, np.float64), min(0.0, float(np.log(prior / (1 - prior)))) - 1.0
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return w, b
    of_p = np.repeat(positive, sizes)
    p, u = (np.bincount(features[at], minlength=1 << BITS) for at in (of_p, ~of_p))
    seen = _lift(p, u, n_p, n_u, prior) > 2.0
    at = seen[features]
    number = np.cumsum(seen) - 1
    flat, text = number[features[at]], np.repeat(np.arange(len(sizes)), sizes)[at]  # few are left
    begins = np.searchsorted(text, np.arange(len(sizes) + 1))
    n = int(seen.sum())
    v, m1, m2, mb1, mb2, step = np.zeros(n), np.zeros(n), np.zeros(n), 0.0, 0.0, 0
    batches = max(1, -(-max(n_p, n_u) // 1024))
    places = [np.flatnonzero(positive), np.flatnonzero(~positive)]
    for _ in range(epochs):
        orders = [rng.permutation(x) for x in places]
        for k in range(batches):
            p, u = (o[k::batches] if len(o) > k else o[:1] for o in orders)
            both = np.concatenate([p, u])
            count = begins[both + 1] - begins[both]
            doc = np.repeat(np.arange(len(both)), count)
            x = flat[np.repeat(begins[both] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            f = np.clip(np.bincount(doc, v[x], minlength=len(both)) + b, -30, 30)
            _, g = steps(f, len(p), prior)
            grad = np.bincount(x, g[doc], minlength=n) + 1e-5 * v
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            mb1, mb2 = 0.9 * mb1 + 0.1 * g.sum(), 0.999 * mb2 + 0.001 * g.sum() ** 2
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            v -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
            b -= rate * (mb1 / c1) / (np.sqrt(mb2 / c2) + 1e-8)
    w[seen] = v
    return w, float(b)


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is held out: crc32 of its key as text (a null key: of the empty text) modulo folds is 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _sampled(ids: DataFrame, key: str, most: int) -> DataFrame:
    """About most of the rows, by hash of the key."""
    share = min(1.0, most / max(1, ids.count()))
    return ids.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, models: int = MODELS) -> list[tuple[np.ndarray, float]]:
    """Models from rows that aren't held out: confirmed toxic texts, any texts without their labels, and the rate of toxic labels as prior.

    The unlabelled texts are a sample of all documents, so the labelled ones may be among them; that holds where all
    documents are labelled too.  The samples are drawn from ids alone; at most about positives + unlabelled ids (some
    100 bytes each) are broadcast to pick the texts, so no text is shuffled before it is picked.

    Nulls in key or label count as no label; of several labels of a key the largest counts.  Without any label there
    are no models, and all documents score 0; with labels but no toxic one, models without weights, which reject
    nothing; where all labels are toxic, the prior is 0.9.  Null texts count as empty; of rows with one key, one is taken.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_toxic")).where(~held_out(key))
    ids = docs.where(F.col(key).isNotNull()).select(key).where(~held_out(key)).distinct()
    rate = known.agg(F.avg(F.col("_toxic").cast("double"))).first()[0]
    if rate is None:
        return []
    p = _sampled(ids.join(known.where("_toxic = 1").select(key), key, "left_semi"), key, positives).select(key, F.lit(1).alias("_p"))
    u = _sampled(ids, key, unlabelled).select(key, F.lit(0).alias("_p"))
    # a confirmed text may be drawn as an unlabelled one too
    drawn = p.unionByName(u).groupBy(key).agg(F.collect_set("_p").alias("_ps"))
    picked = docs.select(key, text).join(F.broadcast(drawn), key).dropDuplicates([key])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for i, j in blocks(offsets):
                doc, feature = distinct(*features(data, offsets[i : j + 1]))
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), lists], ["key", "ps", "features"])

    rows = picked.select(text, F.xxhash64(key), "_ps").mapInArrow(trimmed(vectors), "key long, ps array<int>, features array<int>")
    rows = rows.select("key", F.explode("ps").alias("p"), "features").select(F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model"), "*")
    prior = float(min(0.9, max(0.001, rate)))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("p", "ascending")]).combine_chunks()
        lists = table["features"].chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        w, b = fit(lists.flatten().to_numpy(), sizes, table["p"].to_numpy() == 1, prior, int(table["model"][0].as_py()))
        return pa.table({"model": table["model"][:1], "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([b], pa.float64())})

    found = rows.groupBy("model").applyInArrow(one, "model int, weights binary, bias double").collect()
    return [(np.frombuffer(r.weights, np.float32), r.bias) for r in sorted(found, key=lambda r: r.model)]


def _scores(column: pa.Array, models: list[tuple[np.ndarray, float]], some: np.ndarray) -> np.ndarray:
    data, offsets = column_bytes(column)
    scores = np.zeros(len(column))
    for i, j in blocks(offsets):
        doc, feature = features(data, offsets[i : j + 1])
        at = some[feature]
        doc, feature = distinct(doc[at], feature[at])
        for w, b in models:
            f = np.bincount(doc, w[feature], minlength=j - i) + b
            scores[i:j] += 1 / (1 + np.exp(-np.clip(f, -30, 30))) / len(models)
    return np.clip(scores, 0.0, 1.0)


def _weighed(models: list[tuple[np.ndarray, float]]) -> np.ndarray:
    return np.any([w != 0 for w, _ in models], axis=0) if models else np.zeros(1 << BITS, bool)


def score(docs: DataFrame, models: list[tuple[np.ndarray, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row; without a model the score is 0.

    A null or empty text scores what the bias gives; null keys and repeated rows are each scored; an empty table
    gives none; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    table = docs.sparkSession.sparkContext.broadcast(models)  # MODELS vectors of 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = _weighed(table.value)
        for batch in batches:
            scores = _scores(batch.column(0), table.value, some)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(F.col(text).alias("_text"), key).mapInArrow(trimmed(run), f"`{key}` {kind}, score double, predicted int")


def accepted(docs: DataFrame, models: list[tuple[np.ndarray, float]], text: str = "text") -> DataFrame:
    """The rows of docs, whole, that score below 0.5.

    A null or empty text scores what the bias gives (below 0.5, if no model was fitted); null keys, repeated rows and
    texts of any length are judged by their text alone; an empty table gives none; all columns are kept.
    """
    table = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = _weighed(table.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), table.value, some) < 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)
