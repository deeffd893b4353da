"""N-gram Jaccard join by T-occurrence search over inverted lists, short lists merged and long ones probed (DivideSkip).

Two documents with sets of n and m shingles link if 100 * overlap >= percent * union, so the overlap is at
least T = percent / 100 of the larger set.  Under any one order of all shingles, such documents have a shingle in
common among the first n - T + 1 of each: only those go into the inverted lists.  The order puts the shingles of
long lists last, by a table of bounded size: a common line then doesn't bring its documents together, as long as
they have enough shingles beside it.  Lists with the same members are one.  Members of a list whose parity sketches
don't rule a link out come into one group, through a forest only, never as all pairs.  Within a group, dealt into
blocks of bounded size, whole sets are searched: a set's short lists are merged into counts, its L longest are set
aside, only documents with T - L at least are candidates, and the long lists are probed for these by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, binary_column, blocks, column_bytes, join_labels, materialize, mix, shingles, sorted_groups, trimmed, word_hashes
from .graph import components

_U = np.uint64
#: Lists of at most SHORT documents are joined pair by pair; longer ones are dealt into blocks of about BLOCK documents.
SHORT, BLOCK = 12, 4096
#: Shingles of the whole sets in a block of a group, about (a larger set is a block alone), and of the sets whose sketches are in one of a list.
BLOCK_TOKENS, LIST_TOKENS = 1 << 20, 1 << 24
#: Words of sketches that are compared at once.
PAIRS = 1 << 18
#: DivideSkip's weight: of a set's lists the T / (SKIP * log2(longest) + 1) longest are probed, T being the overlap that is needed.
SKIP = 0.0085
#: A shingle counts as frequent if one task meets it in COMMON documents among FLUSH prefix tokens; at most FREQUENT shingles do (8 bytes each are broadcast).
COMMON, FLUSH, FREQUENT = 4, 4_000_000, 1 << 20
#: Ids up to this number are broadcast (8 bytes each) to pick documents; beyond it, they are joined by a shuffle.
BROADCAST_IDS = 1 << 19
_ORDER = _U(0x9E3779B97F4A7C15)


def document_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one hash of the whole if it has fewer than k words."""
    hashes, _, _, first = word_hashes(data, offsets)
    grams, _ = shingles(hashes, first, k)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            h = np.zeros(1, _U)
            for x in hashes[a:b]:
                h = mix(h * _ORDER + x + _U(b - a))
            yield h
        else:
            yield np.zeros(0, _U)


def set_id(tokens: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for the empty one."""
    return np.array([mix(tokens + _ORDER).sum(dtype=_U), mix(tokens ^ _ORDER).sum(dtype=_U)]).tobytes() if len(tokens) else None


def needed(n, percent: int):
    """Least overlap of a set of n with any set that links to it."""
    return -(-percent * n // 100)


def differing(n, m, percent: int):
    """Most shingles that are in one only of two linking sets of n and m."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by the low bits of a hash: two sets differ in at least as many tokens as their sketches in bits."""
    bits = max(128, 1 << int(len(tokens) - 1).bit_length())
    counts = np.bincount((mix(tokens) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def _frequent(df: DataFrame, text: str, k: int, percent: int) -> np.ndarray:
    """Shingles, at most FREQUENT, that are common among those with small hashes.

    Any table gives right results; this one keeps lists short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            at = counts >= COMMON
            return pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(counts[at])], ["token", "n"])

        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for i, j in blocks(offsets):
                for tokens in document_sets(data, offsets[i : j + 1], k):
                    held.append(tokens[: len(tokens) - needed(len(tokens), percent) + 1])
                    size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = df.select(text).mapInArrow(trimmed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > SHORT)
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token")
    return np.sort(top.toArrow()["token"].to_numpy().view(_U))


def _is_in(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(table, tokens)
    at[at == len(table)] = 0
    return table[at] == tokens


def _prefix(tokens: np.ndarray, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First size tokens in order: those that aren't in table, and those that are."""
    some = tokens[: 2 * size]
    rare = some[~_is_in(some, table)]
    if len(rare) < size and len(some) < len(tokens):
        found = _is_in(tokens, table)
        rare, some = tokens[~found], tokens
    if len(rare) >= size:
        return rare[:size], tokens[:0]
    return rare, some[_is_in(some, table)][: size - len(rare)]


def _indexed(df: DataFrame, key: str, text: str, k: int, percent: int, table: np.ndarray) -> DataFrame:
    """Per row: its set's size, id (node), prefix tokens and sketch; _row tells the rows of a set apart."""
    shared = df.sparkSession.sparkContext.broadcast(table)  # at most FREQUENT tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in blocks(offsets):
                n, node, rare, common, sketch = [], [], [], [], []
                for tokens in document_sets(data, offsets[i : j + 1], k):
                    n.append(len(tokens))
                    node.append(set_id(tokens))
                    a, b = _prefix(tokens, len(tokens) - needed(len(tokens), percent) + 1 if len(tokens) else 0, table)
                    rare.append(a.view(np.int64))
                    common.append(b.view(np.int64))
                    sketch.append(_sketch(tokens) if len(tokens) else None)
                arrays = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(rare, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "_row", "n", "node", "rare", "common", "sketch"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("_row"), F.col(text)).mapInArrow(trimmed(run), f"key {kind}, _row long, n long, node binary, rare array<long>, common array<long>, sketch binary")


def _lists(nodes: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """Postings (token, id, n, length, size) of the lists with two documents at least; of lists with the same members, one.

    Common shingles' lists are counted before they are joined, so that Spark can split long ones.  The rare ones are
    counted where they meet, after one shuffle: such a shingle is in fewer than COMMON of the prefixes that make up FLUSH
    tokens of a task, or among those beyond the FREQUENT ones, so its list is short beside its task's share of the corpus (24 bytes a
    document, sorted on disk if need be).
    """
    postings = nodes.select(F.explode(column).alias("token"), "id", "n")
    if column == "common":
        lengths = postings.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
        shared = postings.join(scratch.materialize(lengths, "lengths"), "token")
    else:
        shared = postings.withColumn("length", F.count("*").over(W.partitionBy("token"))).where("length > 1")
    shared = scratch.materialize(shared, "postings")
    members = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"m{i}") for i in range(2)]
    kept = shared.groupBy("token").agg(F.max("length").alias("length"), F.sum("n").alias("size"), *members)
    kept = kept.groupBy("length", "size", "m0", "m1").agg(F.min("token").alias("token"))
    return shared.join(scratch.materialize(kept.select("token", "size"), "lists"), "token")


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    groups = lists.where(F.col("length") <= SHORT).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("g"))
    pairs = F.expr(f"flatten(transform(g, (p, i) -> transform(filter(slice(g, i + 2, {SHORT}), q -> 100 * p.n >= {percent} * q.n and q.id <> p.id), q -> struct(least(p.id, q.id) as a, greatest(p.id, q.id) as b))))")
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _fold(words: np.ndarray, to: int) -> np.ndarray:
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _sketch_words(column) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Width of each sketch in 64-bit words, the sketches of each width as rows, and each one's row there."""
    data, offsets = binary_column(column)
    width = np.diff(offsets) // 8
    words, row = {}, np.zeros(len(width), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        words[w] = data[offsets[at][:, None] + np.arange(8 * w)].view(_U).reshape(-1, w)
        row[at] = np.arange(len(at))
    return width, words, row


def _near_labels(sizes: np.ndarray, sketches, percent: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of the parts into which pairs of left and right join all rows, of pairs that sizes and sketches don't rule out."""
    width, words, row = _sketch_words(sketches)
    labels = np.arange(len(sizes))
    for wl in words:
        for wr in words:
            if not wl // 2 <= wr <= 2 * wl:
                continue
            a, b = left[width[left] == wl], right[width[right] == wr]
            if not len(a) or not len(b):
                continue
            w = min(wl, wr)
            x, y = _fold(words[wl][row[a]], w), _fold(words[wr][row[b]], w)
            step = max(1, PAIRS // (len(b) * w))
            for s in range(0, len(a), step):
                if not labels.any():
                    return labels
                d = np.bitwise_count(x[s : s + step, None] ^ y[None]).sum(2, dtype=np.int64)
                n, m = sizes[a[s : s + step]][:, None], sizes[b][None]
                i, j = np.nonzero((d <= differing(n, m, percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
                labels = join_labels(labels, a[s + i], b[j])
    return labels


def _dealt(rows: DataFrame, by: str, g, rest: list[str]) -> DataFrame:
    """Rows of each group by, dealt into g blocks, once for each pair (i, j) of blocks that their block b is in; sorted by group and pair."""
    rows = rows.select(by, g.alias("g"), F.pmod(F.xxhash64("node"), g).cast("int").alias("b"), *rest)
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select(by, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "g", "b", *rest)
    return rows.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    mine, first, second = table["b"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    left = np.flatnonzero(mine == first)
    return left, left if first == second else np.flatnonzero(mine == second)


def _block_forests(postings: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join what the sketches of long lists' members don't rule out, a row for a member at most.

    A list is dealt into blocks, and each pair of blocks is a group; so a group is bounded and a document is sent
    once for a block of its list, not once for a pair.
    """
    rows = postings.join(nodes.select("id", "node", "sketch"), "id")
    g = F.greatest(F.ceil(F.col("length") / BLOCK), F.ceil(F.col("size") / LIST_TOKENS)).cast("int")
    dealt = _dealt(rows, "token", g, ["node", "n", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 3):
            labels = _near_labels(table["n"].to_numpy(), table["sketch"], percent, *_sides(table))
            at = np.flatnonzero(labels != np.arange(len(labels)))
            if len(at):
                ids = table["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(labels[at])), ids.take(pa.array(at))], ["a", "b"])

    return dealt.mapInArrow(trimmed(run), "a binary, b binary")


def _pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and sketches don't rule them out, of pairs of their ids."""
    slim = nodes.select("id", "node", "n", "sketch")
    both = pairs.join(slim.toDF("a", "u", "na", "sa"), "a").join(slim.toDF("b", "v", "nb", "sb"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 4))
            (wx, x, rx), (wy, y, ry) = (_sketch_words(batch.column(c)) for c in (3, 5))
            keep = np.zeros(len(n), bool)
            for u in x:
                for v in y:
                    at = np.flatnonzero((wx == u) & (wy == v))
                    w = min(u, v)
                    keep[at] = np.bitwise_count(_fold(x[u][rx[at]], w) ^ _fold(y[v][ry[at]], w)).sum(1) <= differing(n[at], m[at], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.select("u", "v", "na", "sa", "nb", "sb").mapInArrow(trimmed(run), "a binary, b binary")


def _sets(df: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(node, tokens) of the wanted nodes (node, _row), each from one row that has it."""
    rows = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    picked = df.select(F.xxhash64(key, text).alias("_row"), F.col(text)).join(rows, "_row").select("node", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in blocks(offsets):
                sets = list(document_sets(data, offsets[i : j + 1], k))
                ids = batch.column(0).slice(i, j - i)
                same = [set_id(t) == x for t, x in zip(sets, ids.to_pylist(), strict=True)]  # not another row of that hash
                yield pa.RecordBatch.from_arrays([ids, pa.array([t.tobytes() for t in sets], pa.binary())], ["node", "tokens"]).filter(pa.array(same, pa.bool_()))

    return picked.mapInArrow(trimmed(run), "node binary, tokens binary").dropDuplicates(["node"])


class Lists:
    """Inverted lists over the sets of one side of a block: for each shingle, the sets that have it, by their place there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> None:
        self.n, self.sets = len(rows), [data[offsets[i] : offsets[i + 1]] for i in rows.tolist()]
        self.sizes = (offsets[rows + 1] - offsets[rows]).astype(np.int64)
        tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, _U)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        self.tokens, self.end = tokens[self.begin], np.append(self.begin[1:], len(tokens))
        self._gaps: dict[int, np.ndarray] = {}

    def members(self, i: int) -> np.ndarray:
        return self.owner[self.begin[i] : self.end[i]]

    def gaps(self, i: int) -> np.ndarray:
        """The sets that list i lacks; what is probed where it has more than half of them."""
        if i not in self._gaps:
            missing = np.ones(self.n, bool)
            missing[self.members(i)] = False
            self._gaps[i] = np.flatnonzero(missing).astype(np.int32)
        return self._gaps[i]

    def search(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets that link with the set of tokens, by DivideSkip.

        A link takes an overlap of T.  With the L longest lists of the tokens set aside, a linking set is in T - L of
        the others at least: these are merged into counts, and only what reaches T - L is a candidate.  The long
        lists are probed for the candidates, by binary search.
        """
        n = len(tokens)
        least = needed(n, percent)
        at = np.flatnonzero(_is_in(tokens, self.tokens))
        lists = np.searchsorted(self.tokens, tokens[at])
        if len(lists) < least:
            return np.zeros(0, np.int64)
        lengths = self.end[lists] - self.begin[lists]
        order = np.argsort(-lengths, kind="stable")
        apart = int(min(least - 1, least / (SKIP * np.log2(max(2, int(lengths.max()))) + 1)))
        long_, short = order[:apart], order[apart:]
        merged = np.concatenate([self.members(i) for i in lists[short].tolist()])
        if len(merged) * 8 > self.n:
            counts = np.bincount(merged, minlength=self.n)
            found = np.flatnonzero(counts >= least - apart)
            counts = counts[found]
        else:
            found, counts = np.unique(merged, return_counts=True)
            counts, found = counts[counts >= least - apart], found[counts >= least - apart]
        sizes = self.sizes[found]
        fits = 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
        found, counts = found[fits], counts[fits].astype(np.int64)
        if len(found) < len(long_):
            probed = tokens[at[long_]]
            counts = counts + np.array([_is_in(probed, self.sets[c]).sum() for c in found.tolist()], np.int64)
        else:
            found, counts = self._probed(found, counts, lists[long_], lengths[long_], least)
        return found[100 * counts >= percent * (n + self.sizes[found] - counts)]

    def _probed(self, found: np.ndarray, counts: np.ndarray, lists: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that can still reach least, and their counts with the long lists'."""
        full = lengths * 2 > self.n
        if full.any():
            gaps = np.concatenate([self.gaps(i) for i in lists[full].tolist()])
            place = np.searchsorted(found, gaps)
            place[place == len(found)] = 0
            counts = counts + int(full.sum()) - np.bincount(place[found[place] == gaps], minlength=len(found))
        rest = lists[~full]
        for k, i in enumerate(rest.tolist()):
            counts = counts + _is_in(found, self.members(i))
            keep = counts + len(rest) - k - 1 >= least
            if not keep.all():
                found, counts = found[keep], counts[keep]
            if not len(found):
                break
        return found, counts


def _linked(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, links, label, whole): for each block pair of a group (root) that a node is in, the links it has there and a
    node of its part there; whole says that the group is one block."""
    g = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("size") / BLOCK_TOKENS)).cast("int")
    dealt = _dealt(groups.join(sets, "node"), "root", g, ["node", "n", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 3):
            data, offsets = binary_column(table["tokens"])
            sizes, (left, right) = table["n"].to_numpy(), _sides(table)
            data, offsets = data[offsets[0] :], offsets - offsets[0]
            data = np.frombuffer(data[: offsets[-1]].tobytes(), _U)
            offsets = offsets // 8
            links, labels = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
            lists = Lists(data, offsets, right)
            for i in left.tolist():
                found = right[lists.search(data[offsets[i] : offsets[i + 1]], percent)]
                found = found[found != i]
                links[i] += len(found)
                if left is not right:
                    links[found] += 1
                apart = found[labels[found] != labels[i]]
                labels = join_labels(labels, np.full(len(apart), i), apart)
            at = np.flatnonzero((links > 0) | (labels != np.arange(len(labels))))
            if len(at):
                ids = table["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(links[at]), ids.take(pa.array(labels[at])), pa.array(np.full(len(at), table["g"][0].as_py() == 1))], ["node", "links", "label", "whole"])

    return dealt.mapInArrow(trimmed(run), "node binary, links long, label binary, whole boolean")


def _joined(df: DataFrame, key: str, text: str, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(key, _row, n, node, root, links) of each row: its set's part of the graph of links, and the links of its set."""
    table = _frequent(df, text, words, percent)
    indexed = scratch.materialize(_indexed(df, key, text, words, percent, table), "sets-index")
    nodes = indexed.where("node is not null").groupBy("node").agg(F.min("_row").alias("_row"), F.first(F.struct("n", "rare", "common", "sketch")).alias("_s"))
    # id, 64 bits, stands for a node in lists; if two nodes share one, both are candidates
    nodes = scratch.materialize(nodes.select("node", F.xxhash64("node").alias("id"), "_row", "_s.*"), "nodes")
    rare = scratch.materialize(_lists(nodes, "rare", scratch), "lists")
    long_ = rare.where(F.col("length") > SHORT).unionByName(_lists(nodes, "common", scratch))
    near = _pruned(_short_pairs(rare, percent), nodes, percent).unionByName(_block_forests(long_, nodes, percent))
    groups = components(scratch.materialize(near, "near"), scratch)
    groups = scratch.materialize(groups.join(nodes.select("node", "_row", "n"), "node"), "groups")
    sizes = scratch.materialize(groups.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("size")), "group-sizes")
    sets = _sets(df, groups.select("node", "_row"), key, text, words)
    linked = scratch.materialize(_linked(groups.join(sizes, "root"), sets, percent), "links")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"), F.max(F.when(F.col("whole"), F.col("label"))).alias("root"))
    parts = linked.where("not whole and node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    if parts.limit(1).count():
        wide = components(parts, scratch).withColumnRenamed("root", "_wide")
        links = links.join(wide, "node", "left").select("node", "links", F.coalesce("root", "_wide").alias("root"))
    out = indexed.select("key", "_row", "n", "node").join(links, "node", "left")
    return out.select("key", "_row", "n", "node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, node, links, component_id) of each row.

    Words are lower-cased (A-Z) runs without white space; a document with fewer than words of them has its whole
    sequence as one shingle; one without any is empty and links with nothing.  node is the id of the document's
    set (128 bits), the same for equal sets, which are compared once; links is the number of other sets that link
    with it.  component_id is the smallest key reachable by links.

    A null text is empty.  A null key gets the component of its set; its own is null if it has no other.  Repeated
    rows are equal documents; an empty table gives none; other columns are left out.
    """
    scratch = Scratch(df.sparkSession)
    rows = materialize(_joined(df, key, text, words, percent, scratch), "joined")
    scratch.drop()
    least = rows.where("root is not null").groupBy("root").agg(F.min("key").alias("_least"))
    alone = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("_least"))
    return rows.join(least, "root", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "node", "links", alone.alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that have their component's smallest key, and those without words.

    Of rows repeating that key within the component, with the same text or not, one stays (a null key is the
    largest).  Rows without words (null and empty texts) all stay; an empty table gives none; all columns are kept,
    whatever their names.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.materialize(_joined(df, key, text, words, percent, scratch).where("root is not null"), "joined")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "node", "_row")).alias("_first"))
    rows = rows.join(first, "root").groupBy("_row").agg(F.max(F.col("_row") == F.col("_first._row")).alias("first"), F.count("*").alias("n"))
    plan = materialize(rows.where("not first or n > 1"), "repeats")
    scratch.drop()
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_IDS else plan
    marked = df.select(F.struct("*").alias("_r"), F.xxhash64(key, text).alias("_row")).join(plan, "_row", "left")
    alone = marked.where("first is null").select("_r.*")
    return alone.unionByName(marked.where("first").dropDuplicates(["_row"]).select("_r.*"))
