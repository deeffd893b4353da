"""Substring dedup by compact windows: passages that occur, nearly the same, in different texts.

A text is a row of tokens, its 5-word shingles.  Under one hash function, all subsequences of it whose least
token hash is at position c and that reach neither a smaller one on the left nor on the right share a min-hash:
they form the compact window (l, c, r), a node of the Cartesian tree over the hashes.  Windows at least as wide as
the shortest passage are few, about 2 / width of the positions.  Windows of different texts with one signature are
joined; where the shared part of two windows is wide enough, and enough hash functions agree on the two texts,
their tokens there are compared for passages with a Jaccard similarity of SIMILARITY or more.  Long groups of
windows are not joined pair by pair.  There, runs of tokens that are the same are joined by their own hashes, and the
different windows are searched in blocks: only tokens go into a block, and pairs come out of it that have all that is alike.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Scratch, _powers, binary_column, blocks, column_bytes, materialize, mix, shingles, sorted_groups, trimmed, word_hashes

_U = np.uint64
WORDS, SHORTEST, SIMILARITY = 5, 50, 0.8
#: Hash functions (LOW at most), and how many must agree on a pair of texts.
HASHES, ENOUGH, LOW = 5, 2, 8
#: Signatures of at most SHORT windows are joined pair by pair; of more, by each run of tokens with the first that has it
#: and, under the first SEARCHED functions, by a search of their different windows in blocks of about WINDOWS.
SHORT, SEARCHED, WINDOWS = 16, 3, 8192
#: Bits of the filter by which windows of long groups are found again, at least FILTER_SHARE for each group; a false hit costs
#: time only.  Where there are more groups, the windows are sent to their texts instead.
FILTER_BITS, FILTER_SHARE = 1 << 26, 8
#: Tokens on either side of a window's least one that are searched, columns that one product of them takes, and in how many
#: windows of a block a token is counted pair by pair.
REACH, COLUMNS, FEW = 48, 2048, 6
#: Small groups are searched together, about so many windows at once.  So many pairs are looked at first, then as many again as before.
TOGETHER, FIRST = 128, 64
#: The common values of up to so many windows are counted all against all; of more, each is held against those that it may tell something of.
DENSE = 256
#: Windows that a task of the search is dealt, and pairs that one of the last comparison is: their bytes, by which Spark joins small tasks, say little of the work.
DEALT, COMPARED = 4096, 2048
#: Tokens in a piece of a text as it is sent to be compared.
PIECE = 128
#: Ids up to this number are broadcast (about 150 bytes each, so 80 MB at most) to pick texts; beyond it, they are joined by a shuffle.
BROADCAST_IDS = 1 << 19
#: Stretches with this share of the hits that they need are tried first.
LOOSE = 0.95
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values, by blocks: prefix minima of one block against suffix minima of the one before."""
    n = len(h)
    x = np.concatenate([h, np.full(-n % width, _TOP, _U)]).reshape(-1, width)
    before = np.minimum.accumulate(x, 1).reshape(-1)
    after = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def compact_windows(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, most: int = 63) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, c - l, r - c) of the compact windows of at least width tokens; the extents end at most.

    h has the hashes of several texts, [starts[i], ends[i]) of each.  Ties go to the left one: hashes on the left must
    be larger, those on the right at least as large.  A window is that wide just if its c is the least of some
    width tokens, so the minima of all runs of width tokens give every c.
    """
    none = np.zeros(0, np.int64)
    wide = ends - starts >= width
    n = len(h)
    if not wide.any():
        return none, none, none
    low = _U((1 << n.bit_length()) - 1)
    h = (h & ~low) | np.arange(n, dtype=_U)  # the place as the last digits: unlike values, the left one less
    tables, step = [h], 1
    while 2 * step <= min(most, n):
        t = tables[-1]
        tables.append(np.minimum(t[:-step], t[step:]))
        step *= 2
    k = min(width.bit_length(), len(tables)) - 1
    t, off = tables[k], width - (1 << k)  # two runs of a table's length cover one of width, if that isn't over twice as long
    least = np.minimum(t[: n - width + 1], t[off : off + n - width + 1]) if off <= 1 << k else window_minima(h, width)
    mark = np.zeros(len(least) + 1, np.int64)
    mark[starts[wide]] = 1
    mark[ends[wide] - width + 1] -= 1
    new = np.cumsum(mark[:-1]) > 0
    new[1:] &= (least[1:] != least[:-1]) | (mark[1:-1] != 0)
    c = (least[new] & low).astype(np.int64)  # of runs further right, the least is further right too: each comes once
    text = np.searchsorted(starts, c, "right") - 1
    first, last, own = starts[text], ends[text], h[c]
    left, right = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        s, t = 1 << k, tables[k]
        lo = c - left - s
        left += s * ((lo >= first) & (left + s <= most) & (t.take(lo, mode="clip") > own))  # what is clipped isn't in the text
        hi = c + right + 1
        right += s * ((hi + s <= last) & (right + s <= most) & (t.take(hi, mode="clip") > own))
    return c, left, right


def text_windows(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and places of the compact windows of texts under all hash functions, and where each text's begin.

    The signature's low bits name the function.  A place packs the position (32 bits) and the extents (8 each).
    """
    owners, signatures, places = [], [], []
    for k in range(HASHES):
        h = mix(tokens ^ mix(np.full(1, k + 1, _U)))
        c, left, right = compact_windows(h, starts, ends, width)
        text, sig = np.searchsorted(starts, c, "right") - 1, h[c]
        owners.append(text)
        signatures.append((sig & ~_U(LOW - 1)) | _U(k))
        places.append((c - starts[text]).astype(_U) << _U(32) | left.astype(_U) << _U(24) | right.astype(_U) << _U(16))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[order], np.arange(len(starts) + 1))
    return np.concatenate(signatures)[order].view(np.int64), np.concatenate(places)[order].view(np.int64), begins


def _token_lists(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, words, tokens) of each text of a batch."""
    data, offsets = column_bytes(batch.column(column))
    for i, j in blocks(offsets):
        hashes, _, _, first = word_hashes(data, offsets[i : j + 1])
        grams, _ = shingles(hashes, first, WORDS)
        for row in range(i, j):
            a, b = int(first[row - i]), int(first[row - i + 1])
            yield row, b - a, grams[a : max(a, b - WORDS + 1)]


def _content(text: str) -> list[Column]:
    """128 bits, as c0 and c1, that stand for a text."""
    return [F.xxhash64(text).alias("c0"), F.xxhash64(F.lit(1), text).alias("c1")]


def _texts(df: DataFrame, contents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of each of contents, from the row that it is named after."""
    contents = contents.select("c0", "c1", "first", "id")
    contents = F.broadcast(contents) if contents.count() <= BROADCAST_IDS else contents
    rows = df.select(F.col(key).alias("first"), *_content(text), F.col(text).alias("text")).where(F.col("text").isNotNull()).alias("r")
    joined = rows.join(contents.alias("c"), (F.col("r.c0") == F.col("c.c0")) & (F.col("r.c1") == F.col("c.c1")) & F.col("r.first").eqNullSafe(F.col("c.first")))
    return joined.select("id", "text")


def _contents(df: DataFrame, key: str, text: str) -> DataFrame:
    """Different texts: c0 and c1, first (smallest key), copies, and id, which orders them by first."""
    found = df.where(F.col(text).isNotNull()).select(*_content(text), F.col(key).alias("key")).groupBy("c0", "c1").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    hashed = F.xxhash64("first", "c0", "c1")
    if not whole:
        return found.withColumn("id", hashed)
    names = found.groupBy("first").agg(F.count("*").alias("_n"), F.min(F.struct("c0", "c1")).alias("_own")).where("_n > 1 or first is null")
    found = found.join(F.broadcast(names) if names.count() <= BROADCAST_IDS else names, found["first"].eqNullSafe(names["first"]), "left").select(found["*"], "_n", "_own")
    own = F.col("_n").isNull() | (F.struct("c0", "c1") == F.col("_own")) & F.col("first").isNotNull()
    return found.select("c0", "c1", "first", "copies", F.when(own, F.col("first").cast("long")).otherwise(hashed).alias("id"))


def _windows(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in blocks(offsets):
                hashes, _, _, first = word_hashes(data, offsets[i : j + 1])
                tokens, _ = shingles(hashes, first, WORDS)
                starts, ends = first[:-1], np.maximum(first[:-1], first[1:] - WORDS + 1)
                at = np.flatnonzero(ends > starts)  # texts without tokens have no place of their own
                sig, place, begins = text_windows(tokens, starts[at], ends[at], width)
                all_ = np.zeros(j - i + 1, np.int64)
                all_[at + 1] = np.diff(begins)
                cuts = pa.array(np.cumsum(all_), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(sig)), pa.ListArray.from_arrays(cuts, pa.array(place))], ["id", "words", "signatures", "places"])

    return texts.mapInArrow(trimmed(run), "id long, words long, signatures array<long>, places array<long>")


def _filter(signatures: DataFrame) -> np.ndarray:
    """The FILTER_BITS bits of a set of signatures, by their low bits."""
    bit = F.col("sig").bitwiseAND(F.lit(FILTER_BITS - 1))
    found = signatures.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for row in found.toArrow().to_pylist():
        out[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _hits(batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, offsets: np.ndarray, width: int, bits: np.ndarray | None):
    """Tokens, where each text's begin and end, the texts, and the windows of long groups in them: text, signature, place.

    They are those that the filter has, or else those that the batch names (sigs, places).
    """
    hashes, _, _, first = word_hashes(data, offsets[i : j + 1])
    tokens, _ = shingles(hashes, first, WORDS)
    starts, ends = first[:-1], np.maximum(first[:-1], first[1:] - WORDS + 1)
    at = np.flatnonzero(ends > starts)
    if bits is not None:
        sig, place, begins = text_windows(tokens, starts[at], ends[at], width)
        low = sig & (FILTER_BITS - 1)
        hit = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
        text = np.repeat(np.arange(len(at)), np.diff(begins))
        return tokens, starts[at], at, text[hit], sig[hit], place[hit]
    sigs, places = (batch.column(c).slice(i, j - i) for c in (2, 3))
    text = np.searchsorted(at, np.repeat(np.arange(j - i), np.diff(sigs.offsets.to_numpy())))
    return tokens, starts[at], at, text, sigs.flatten().to_numpy(), places.flatten().to_numpy()


def _long_windows(texts: DataFrame, filter_: np.ndarray | None, width: int) -> DataFrame:
    """(kind, hash, id, x, y): of kind 0, hashes of the runs of width tokens in windows of long groups, with the first and
    last place of each in the text; of kind 1, hashes of the tokens of those windows, with their signatures and places."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_) if filter_ is not None else None
    size = min(width, 64)  # as far as extents reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared is not None else None
        for batch in batches:
            ids = batch.column(0)
            data, offsets = column_bytes(batch.column(1))
            for i, j in blocks(offsets):
                tokens, starts, at, text, sig, place = _hits(batch, i, j, data, offsets, width, bits)
                if not len(sig):
                    continue
                c = (place >> 32) + starts[text]
                left, right = place >> 24 & 255, place >> 16 & 255
                mark = np.zeros(len(tokens) + 1, np.int64)
                np.add.at(mark, np.maximum(c - left, c - size + 1), 1)
                np.add.at(mark, np.minimum(c + right - size + 1, c) + 1, -1)
                pos = np.flatnonzero(np.cumsum(mark) > 0)
                if len(pos):
                    grams = _sums(tokens, pos, pos + size)
                    owner = np.searchsorted(starts, pos, "right") - 1
                    order = np.lexsort((pos, grams, owner))
                    grams, owner, pos = grams[order], owner[order], pos[order]
                    new = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]))
                    last = np.append(new[1:], len(pos)) - 1
                    base = starts[owner[new]]
                    yield _rows(0, grams[new].view(np.int64), ids.take(pa.array(at[owner[new]] + i)), pos[new] - base, pos[last] - base)
                some = ((sig & (LOW - 1)) < SEARCHED) & (_changes(tokens, c - np.minimum(left, REACH), c + np.minimum(right, REACH)) >= _least_common(width) - 1)
                c, left, right = c[some], np.minimum(left[some], REACH), np.minimum(right[some], REACH)
                content = mix(_sums(tokens, c - left, c + right + 1) + left.astype(_U))
                yield _rows(1, content.view(np.int64), ids.take(pa.array(at[text[some]] + i)), sig[some], place[some])

    return texts.mapInArrow(trimmed(run), "kind int, hash long, id long, x long, y long")


def _changes(tokens: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How often a token from start to last is another than the one before it: with one more, at least as many as there are different ones."""
    total = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(tokens[1:] != tokens[:-1], out=total[1:-1])
    return total[last] - total[start]


def _rows(kind: int, *columns) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "hash", "id", "x", "y"])


def _sums(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of tokens[start:end] of each, in their order."""
    p, q = _powers(len(tokens) + 1)
    total = np.zeros(len(tokens) + 1, _U)
    np.cumsum(mix(tokens) * p[: len(tokens)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(_U))


def _found_again(long_: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, scratch: Scratch) -> DataFrame:
    """What _long_windows tells of the windows (sig, id, place) of long groups."""
    groups = scratch.materialize(long_.select("sig").distinct(), "long-groups")
    if groups.count() * FILTER_SHARE <= FILTER_BITS:
        texts, filter_ = texts_of(long_.select("id").distinct()), _filter(groups)
    else:
        named = long_.groupBy("id").agg(F.collect_list(F.struct("sig", "place")).alias("w")).select("id", F.col("w.sig").alias("sigs"), F.col("w.place").alias("places"))
        texts, filter_ = texts_of(named.select("id")).join(named, "id").select("id", "text", "sigs", "places"), None
    return scratch.materialize(_long_windows(texts, filter_, width), "long-windows")


def _same(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, bit, ca, cb, ca_to, cb_to): each text with the first one that has a run of tokens, of those in windows of long groups.

    All windows with a run have its signature under each hash function, so a long group has every text with the run.
    """
    runs = found.where("kind = 0").select(F.col("hash").alias("run"), "id", F.col("x").alias("lo"), F.col("y").alias("hi"))
    first = runs.groupBy("run").agg(F.min(F.struct("id", "lo", "hi")).alias("p"), F.max("id").alias("_b")).where("p.id <> _b").select("run", "p")
    met = runs.join(scratch.materialize(first, "same-firsts"), "run").where("p.id <> id")
    return met.select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.lit((1 << HASHES) - 1).alias("bit"), F.col("p.lo").alias("ca"), F.col("lo").alias("cb"), F.col("p.hi").alias("ca_to"), F.col("hi").alias("cb_to"))


def _near(found: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, scratch: Scratch) -> DataFrame:
    """(a, b, bit, ca, cb, ca_to, cb_to): texts whose windows in a long group are alike, in more than runs of width tokens.

    Of windows with the same tokens the first stands for all (the others have its runs).  A group is dealt into
    blocks, and each pair of blocks searched by itself; a window takes 2 bytes a token there.
    """
    windows = found.where("kind = 1").select("hash", "id", F.col("x").alias("sig"), F.col("y").alias("place"))
    reps = scratch.materialize(windows.groupBy("sig", "hash").agg(F.min(F.struct("id", "place")).alias("w")).select("sig", "w.id", "w.place"), "near-windows")
    sizes = scratch.materialize(reps.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "near-groups")
    asked = scratch.materialize(reps.join(sizes, "sig").groupBy("id").agg(F.collect_list(F.struct("sig", "n", "place")).alias("w")), "near-asked")
    asked = asked.select("id", *(F.col(f"w.{c}").alias(c) for c in ("sig", "n", "place")))
    sent = texts_of(asked.select("id")).join(asked, "id").select("id", "text", "sig", "n", "place").mapInArrow(trimmed(_window_tokens), "sig long, n long, id long, place long, tokens binary")
    g = F.ceil(F.col("n") / WINDOWS).cast("int")
    sent = sent.select("sig", g.alias("g"), F.pmod(F.xxhash64("id", "place"), g).cast("int").alias("b"), "id", "place", "tokens").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    sent = sent.select("sig", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "place", "tokens")
    windows_sent = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / WINDOWS))).first()[0] or 0
    dealt = sent.repartition(-(-windows_sent // DEALT) or 1, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for table in _together(sorted_groups(batches, 3)):
            left, right = search_windows(table, width)
            if not len(left):
                continue
            ids, places = table["id"].to_numpy(), table["place"].to_numpy() >> 32
            out.append((ids[left], ids[right], places[left], places[right]))
            size += len(left)
            if size > 10_000:
                yield _four(out)
                out, size = [], 0
        if size:
            yield _four(out)

    pairs = dealt.mapInArrow(trimmed(run), "a long, b long, ca long, cb long")
    return pairs.select("a", "b", F.lit((1 << HASHES) - 1).alias("bit"), "ca", "cb", F.col("ca").alias("ca_to"), F.col("cb").alias("cb_to"))


def _together(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Small groups as one table of about TOGETHER windows (group says whose each is): each search has costs of its own."""
    held, sizes = [], []
    for table in tables:
        if table.num_rows > TOGETHER // 2 or table["j"][0].as_py() > 0:
            yield table
            continue
        held.append(table)
        sizes.append(table.num_rows)
        if sum(sizes) >= TOGETHER:
            yield pa.concat_tables(held).append_column("group", pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            held, sizes = [], []
    if held:
        yield pa.concat_tables(held).append_column("group", pa.array(np.repeat(np.arange(len(sizes)), sizes)))


def _four(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "ca", "cb"])


def _window_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window that a text is asked for: its tokens up to REACH around its least one, 16 bits each."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in blocks(offsets):
            hashes, _, _, first = word_hashes(data, offsets[i : j + 1])
            tokens, _ = shingles(hashes, first, WORDS)
            tokens = (tokens >> _U(48)).astype(np.uint16)
            lists = [batch.column(c).slice(i, j - i) for c in (2, 3, 4)]
            text = np.repeat(np.arange(j - i), np.diff(lists[0].offsets.to_numpy()))
            sig, n, place = (x.flatten().to_numpy() for x in lists)
            c = (place >> 32) + first[text]
            start, end = c - np.minimum(place >> 24 & 255, REACH), c + np.minimum(place >> 16 & 255, REACH) + 1
            for k in range(0, len(c), 4096):
                own = [tokens[a:b].tobytes() for a, b in zip(start[k : k + 4096].tolist(), end[k : k + 4096].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sig[k : k + 4096]), pa.array(n[k : k + 4096]), batch.column(0).take(pa.array(text[k : k + 4096] + i)), pa.array(place[k : k + 4096]), pa.array(own, pa.binary())], ["sig", "n", "id", "place", "tokens"])


def _in_common(values: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many different values (those of 64 bits by their low 48) each of left has in common with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    n = max(int(left.max()), int(right.max()), int(owner.max(initial=0))) + 1
    kind = np.uint32 if values.dtype == np.uint16 else _U  # a value beside its owner, of 16 bits, in as few as will do
    both = np.sort((values.astype(kind) << kind(16)) | owner.astype(kind))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    owner, values = (both & kind(0xFFFF)).astype(np.int64), both >> kind(16)
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(both) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(both)))
    if (times > 1).sum() > COLUMNS // 4:  # of many, the values of few windows are counted pair by pair
        at_left, at_right = np.full(n, -1), np.full(n, -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        for f in range(2, FEW + 1):
            members = owner[begin[times == f][:, None] + np.arange(f)]
            x, y = at_left[members], at_right[members]
            for u in range(f):
                for v in range(f):
                    both_in = (x[:, u] >= 0) & (y[:, v] >= 0)
                    if u != v and both_in.any():
                        np.add.at(out, (x[both_in, u], y[both_in, v]), 1)
        several = times > FEW
    else:
        several = times > 1  # what one window alone has joins nothing
    place = np.cumsum(new) - 1
    keep = several[place] if len(place) else np.zeros(0, bool)
    owner, column = owner[keep], (np.cumsum(several) - 1)[place[keep]]
    columns = int(several.sum())
    for k in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        m = np.zeros((n, min(COLUMNS, columns - k)), np.float32)
        m[owner[a:b], column[a:b] - k] = 1
        out += m[left] @ m[right].T
    return out


class _Search:
    """Windows of a pair of blocks, what is known of each of their places, and the pairs that told it (out).

    known has for each token the least other text that has it in an alike passage, as far as is known: n if none is, -1 where a window has no token.
    """

    def __init__(self, table: pa.Table, width: int) -> None:
        data, offsets = binary_column(table["tokens"])
        self.tokens = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint16)
        self.offsets = (offsets - offsets[0]) // 2
        self.n, self.sizes = table.num_rows, np.diff(self.offsets)
        self.owner = np.repeat(np.arange(self.n), self.sizes)
        self.ids = np.unique(table["id"].to_numpy(), return_inverse=True)[1] if "id" in table.column_names else np.arange(self.n)
        self.group = table["group"].to_numpy() if "group" in table.column_names else np.zeros(self.n, np.int64)
        self.width = min(width, 2 * REACH)  # of longer passages, what lies around the windows' least tokens
        self.fewest, self.unlike = _fewest_values(self.tokens, self.owner, self.offsets, self.width)
        self.size = min(self.width, 64)
        runs = _run_hashes(self.tokens, self.size)
        self.run_at = np.flatnonzero(self.owner[: len(runs)] == self.owner[len(self.tokens) - len(runs) :]) if len(runs) else np.zeros(0, np.int64)
        self.runs = runs[self.run_at] ^ mix(self.group[self.owner[self.run_at]].astype(_U))
        self.begin = REACH - np.minimum(table["place"].to_numpy() >> 24 & 255, REACH)  # a window's first token, where its least one is at REACH
        self.column = np.arange(len(self.tokens)) - np.repeat(self.offsets[:-1] - self.begin, self.sizes)
        self.out: list[tuple[int, int]] = []
        self.rows: dict[int, tuple] = {}

    @property
    def least(self) -> int:
        """With fewer values in common two windows have no diagonal, and only runs that are known."""
        return _least_common(self.width)

    def open(self) -> None:
        n = self.n
        self.lines = np.repeat(-1 - np.arange(n, dtype=np.int32)[:, None], 2 * REACH + 1, axis=1)  # no two windows agree where they have no token
        self.lines[self.owner, self.column] = self.tokens
        self.known = np.full(self.lines.shape, -1, np.int32)
        self.known[self.owner, self.column] = n
        _cover_runs(self.known, self.runs, self.owner[self.run_at], self.column[self.run_at], self.ids, self.size)
        self.again = self.sizes - np.bincount(np.unique(self.owner << 16 | self.tokens) >> 16, minlength=n)

    def number(self, values: np.ndarray, count: int) -> None:
        """For worth: values has the number of each token, count in all, or -1."""
        self.cells = np.full(self.lines.shape, count, np.int32)
        self.cells[self.owner, self.column] = np.where(values < 0, count, values)
        self.places = np.full((2, count + 1), -1, np.int16)  # the first and the last place of a window's values; none has them between calls

    def worth(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of others, of larger texts, in which or of which window a may tell something.

        Alike passages have 2 * SIMILARITY / (1 + SIMILARITY) of half the places that both take together in common.  So from one
        token that the other window has to another, the tokens in common between them say whether a passage may go that far.
        """
        known, ids, n, need = self.known, self.ids, self.lines.shape[1], SIMILARITY / (1 + SIMILARITY)
        at = np.arange(n, dtype=np.int16)
        columns = np.flatnonzero(self.cells[a] < self.places.shape[1] - 1)
        own = self.cells[a][columns]
        self.places[0, own[::-1]], self.places[1, own] = columns[::-1], columns
        cells = self.cells[others]
        there = self.places[0].take(cells)
        last = there if not self.again[a] else self.places[1].take(cells)
        self.places[:, own] = -1
        hit = there >= 0
        before = np.cumsum(hit, 1, dtype=np.int16)
        again = self.again[a] + self.again[others]
        loose = again > WORDS  # with many like tokens in one window this bounds nothing
        lag = max(0, int(np.ceil(2 * need * self.width - 1e-3)) - 1 - min(WORDS, int(again.max())))  # of width tokens so many are in common at least
        enough = before[:, -1] >= np.maximum(self.least, need * (self.fewest[a] + self.fewest[others]) - 1e-3)
        before -= hit
        before *= 9
        before -= 4 * at
        start = np.where(hit, before - 4 * last, np.int16(16000))
        end = np.where(hit, before - 4 * there + (1 + 4 * np.minimum(again, WORDS)).astype(np.int16)[:, None], np.int16(-16000))
        stop = end[:, lag:] >= np.minimum.accumulate(start, 1)[:, : n - lag]
        some = (stop.any(1) | loose) & enough
        if not some.all():
            others, there, hit, start, end, stop, loose = others[some], there[some], hit[some], start[some], end[some], stop[some], loose[some]
        begin = start[:, : n - lag] <= np.maximum.accumulate(end[:, ::-1], 1)[:, ::-1][:, lag:]
        lo, hi = begin.argmax(1)[:, None], n - 1 - stop[:, ::-1].argmax(1)[:, None]
        within = (at >= lo) & (at <= hi)
        new = loose | ((known[others] > ids[a]) & within).any(1)
        rest = np.flatnonzero(~new & (known[a].max() > ids[others]))
        if len(rest):
            within, there = within[rest] & hit[rest], there[rest]
            lo, hi = np.where(within, there, n).min(1)[:, None], np.where(within, there, -1).max(1)[:, None]
            new[rest] = ((known[a] > ids[others[rest]][:, None]) & (at >= lo) & (at <= hi)).any(1)
        return others[new]

    def look(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> int:
        """Compares pairs, x being of the smaller text and h how many different values they have in common; those that tell something go to out.  Says how many there was something to ask of."""
        lines, known, ids, unlike, width, need = self.lines, self.known, self.ids, self.unlike, self.width, SIMILARITY / (1 + SIMILARITY)
        most_x, most_y = (known[w].max(1) for w in (x, y)) if len(x) < self.n else (known.max(1)[w] for w in (x, y))
        new = (most_x > ids[y]) | (most_y > ids[x])
        x, y, h = x[new], y[new], h[new]
        looked = len(x)
        if not len(x):
            return looked
        hit = lines[x] == lines[y]
        hits, straight, plain = (hit, hit.copy()), hit.sum(1) + 2 >= h, (hit.sum(1) >= h) & unlike[x] & unlike[y]
        more = np.flatnonzero((hit.sum(1) < h) | ~(unlike[x] & unlike[y]))  # else all that they have in common is in place
        off = np.zeros(len(x), np.int64)
        *found, off[more] = _beside(lines[x[more]], lines[y[more]], 2 * WORDS)
        for side, own in zip(hits, found, strict=True):
            side[more] = own
        rest = np.maximum(0, h - np.minimum(hits[0].sum(1), hits[1].sum(1)))  # what lies further off
        new = rest > WORDS
        for side, me, other in zip(hits, (x, y), (y, x), strict=True):
            own = known[me]
            open_ = own > ids[other][:, None]
            new |= (side & open_).any(1) | _gaps(own, ~open_)
        x, y, rest, straight, plain, off, hits = x[new], y[new], rest[new], straight[new], plain[new], off[new], (hits[0][new], hits[1][new])
        if not len(x):
            return looked
        share = np.where(unlike[x] & unlike[y], 2 * need, LOOSE * 2 * need)
        new = _best_stretch(hits[0], share, width) + rest >= -1e-3
        two = np.flatnonzero(~(plain | new))  # plain ones have the same hits on both sides
        new[two] = _best_stretch(hits[1][two], share[two], width) + rest[two] >= -1e-3
        x, y, rest, share, straight, plain, off, hits = x[new], y[new], rest[new], share[new], straight[new], plain[new], off[new], (hits[0][new], hits[1][new])
        if not len(x):
            return looked
        share = np.where(straight, share, LOOSE * 2 * need)  # one of two stretches may be longer than the other
        at, two, bounds = np.arange(known.shape[1]), np.flatnonzero(~plain), np.empty((2, len(x), known.shape[1]), bool)
        bounds[:, plain] = _dense(hits[0][plain], width)
        if len(two):
            for bound, side in zip(bounds, hits, strict=True):
                lo, hi = _reach(side[two], share[two], width, rest[two] > WORDS)
                bound[two] = (at >= lo[:, None]) & (at < hi[:, None])
        exact = two[(rest[two] == 0) & unlike[x[two]] & unlike[y[two]]]
        if len(exact):
            for bound, more in zip(bounds, _bounds([side[exact] for side in hits], width, off[exact]), strict=True):
                bound[exact] &= more
        new = ((known[x] > ids[y][:, None]) & bounds[0]).any(1) | ((known[y] > ids[x][:, None]) & bounds[1]).any(1)
        begin, sizes = self.begin, self.sizes
        for k in np.flatnonzero(new).tolist():
            u, v = int(x[k]), int(y[k])
            if not ((known[u] > ids[v]) & bounds[0][k]).any() and not ((known[v] > ids[u]) & bounds[1][k]).any():
                continue
            told = False
            if plain[k]:
                found = _straight_passages(hits[0][k], (begin[u], begin[v]), (begin[u] + sizes[u], begin[v] + sizes[v]), width)
            else:
                if len(self.rows) > 1024:
                    self.rows.clear()
                for w in {u, v} - self.rows.keys():
                    self.rows[w] = _numbered(self.tokens[self.offsets[w] : self.offsets[w + 1]])
                found = _shared_passages(self.rows[u], self.rows[v], width)
            for u_from, u_to, v_from, v_to in found:
                for w, o, lo, hi in ((u, v, u_from, u_to), (v, u, v_from, v_to)):
                    place = known[w, begin[w] + lo : begin[w] + hi]
                    told |= bool((place > ids[o]).any())
                    np.minimum(place, ids[o], out=place)
            if told:
                self.out.append((u, v))
        return looked


def _least_common(width: int) -> int:
    return max(2, min(width, 2 * REACH) // 4)


def search_windows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a pair of blocks (b, i, j, place, tokens; id, else each row is a text; group, if they are of several) whose windows are alike: all such pairs that tell something new.

    A pair is left out only if each place that it could cover in either window is known to be shared with the other text or with one of a
    smaller id: by a run of width tokens, or by pairs before it, which come by their smaller and then by their larger id.
    So what of each window other texts have, and the least id that has each place of it, are those of all pairs (but for
    places that only widen a short passage).
    Candidates have as many different tokens in common as alike passages have, and in one of them a stretch with
    such a share of them, a few tokens off at most; they are compared along diagonals.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second = table["i"][0].as_py(), table["j"][0].as_py()
    many = table.num_rows > DENSE and "group" not in table.column_names
    order = np.argsort(table["id"].to_numpy(), kind="stable") if many and "id" in table.column_names else np.arange(table.num_rows)
    table = table.take(pa.array(order)) if many else table
    mine = table["b"].to_numpy()
    left = np.flatnonzero(mine == first)
    right = left if first == second else np.flatnonzero(mine == second)
    if not len(left) or not len(right):
        return none
    search = _Search(table, width)
    if many:
        _search_lists(search, None if first == second else mine)
    else:
        _search_all(search, left, right)
    return tuple(order[np.array(x, np.int64)] for x in zip(*search.out, strict=True)) if search.out else none


def _search_all(search: _Search, left: np.ndarray, right: np.ndarray) -> None:
    """Looks at the pairs of left and right, whose common values are counted by products of matrices."""
    tokens, owner, column, ids, group, fewest = search.tokens, search.owner, search.column, search.ids, search.group, search.fewest
    common = _in_common(tokens, owner, left, right)
    if left is right:
        common[np.tril_indices(len(left))] = 0
    if group.any():
        common[group[left][:, None] != group[right]] = 0
    need = SIMILARITY / (1 + SIMILARITY)
    i, j = np.nonzero((common >= search.least) & (common >= need * (fewest[left][:, None] + fewest[right]) - 1e-3))
    if len(search.run_at):  # all that some have in common is one run, with whose first text they are joined otherwise
        shared = _in_common(search.runs, owner[search.run_at], left, right)[i, j]
        told = (shared > 0) & (common[i, j] <= shared + search.size - 1)
        i, j = i[~told], j[~told]
    a, b = left[i], right[j]
    apart = ids[a] != ids[b]
    i, j, a, b = i[apart], j[apart], a[apart], b[apart]
    if not len(a):
        return
    swap = ids[a] > ids[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((ids[b], ids[a]))
    i, j, a, b = i[order], j[order], a[order], b[order]
    how = common[i, j]
    search.open()
    known = search.known
    todo, looked, most, e = np.ones(len(a), bool), 0, 8192, 0
    while e < len(a):
        s, e = e, min(len(a), e + min(max(FIRST, e), 4096))  # few at first, as most of what comes is known by them
        if looked >= most:  # what comes has nothing to tell if all that it has in common is known to be so by a smaller text yet
            looked, most = 0, 2 * most
            closed = known[owner, column] <= ids[a[s]]
            both = _in_common(tokens[closed], owner[closed], left, right) if closed.any() else np.zeros_like(common)
            gaps = _gaps(known, known <= ids[a[s]])
            todo[s:] = (both[i[s:], j[s:]] < how[s:]) | gaps[a[s:]] | gaps[b[s:]]
        now = s + np.flatnonzero(todo[s:e])
        if len(now):
            looked += search.look(a[now], b[now], how[now])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all of the ranges, and the number of the range of each."""
    size = np.maximum(0, end - start)
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(start - (np.cumsum(size) - size), size), which


def _different(values: np.ndarray, owner: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, owner) of what values of others an owner has too, once each, values being numbered, the rarest first; and for each of values the place of its pair, or -1."""
    number = np.unique(values, return_inverse=True)[1]
    n = int(owner.max(initial=0)) + 1
    pairs, back = np.unique(owner * (int(number.max(initial=0)) + 1) + number, return_inverse=True)
    owners, numbers = np.divmod(pairs, int(number.max(initial=0)) + 1)
    times = np.bincount(numbers)
    shared = times > 1
    if side is not None:  # what one side alone has joins nothing
        first = np.bincount(numbers, side[owners] == side[0])
        shared = (first > 0) & (first < times)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(np.where(shared, times, n + 1), kind="stable")] = np.arange(len(times))
    keep = shared[numbers]
    numbers, owners = rank[numbers[keep]], owners[keep]
    order = np.lexsort((numbers, owners))
    place = np.full(len(pairs), -1)
    place[np.flatnonzero(keep)[order]] = np.arange(len(order))
    return numbers[order], owners[order], place[back]


def _in_common_with(a: np.ndarray, b: np.ndarray, values: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many values (those of window w begin at starts[w]) the windows of each pair have in common; pairs of one a follow each other, and mark is a false array to work on."""
    out = np.zeros(len(a), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)] if len(a) else [0]
    for k, m in zip(cuts[:-1], cuts[1:], strict=True):
        own = values[starts[a[k]] : starts[a[k] + 1]]
        mark[own] = True
        mine, which = _ranges(starts[b[k:m]], starts[b[k:m] + 1])
        out[k:m] = np.bincount(which[mark[values[mine]]], minlength=m - k)
        mark[own] = False
    return out


def _search_lists(search: _Search, side: np.ndarray | None) -> None:
    """Looks at pairs of windows (which come by their texts' ids), of different sides if they have sides: each with those after it that it may tell something of.

    A passage begins and ends with tokens in common and lies in a dense stretch of values that others have too.  So to tell something of
    a window, another has such a value at a place of it that isn't known yet, or the window has a gap in what is known; and both have one of
    the rarest values of either in common.  In a family of alike windows the first ones tell nearly all of the rest.
    """
    n, ids, need = search.n, search.ids, SIMILARITY / (1 + SIMILARITY)
    values, owners, place = _different(search.tokens, search.owner, side)
    count = int(values.max(initial=-1)) + 1
    least = np.maximum(search.least, np.ceil(need * (search.fewest + search.fewest.min()) - 1e-3)).astype(np.int64)
    have = np.bincount(owners, minlength=n)
    fit = have >= least
    if not fit.any():
        return
    starts = np.concatenate([[0], np.cumsum(have)])
    rare = (np.arange(len(values)) - starts[owners] <= have[owners] - least[owners]) & fit[owners]

    def lists(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows by their values, and where of each entry's list those after its own window begin and end."""
        kept = np.flatnonzero(kept)
        order = kept[np.lexsort((owners[kept], values[kept]))]
        begin, end = np.zeros((2, len(values)), np.int64)
        begin[order], end[order] = np.arange(1, len(order) + 1), np.searchsorted(values[order], values[order], "right")
        return owners[order], begin, end

    rare_windows, rare_begin, rare_end = lists(rare)
    windows, begin, end = lists(fit[owners])
    long_ = np.bincount(owners, (rare_end - rare_begin).clip(0), n)
    run_values, run_owners, _ = _different(search.runs, search.owner[search.run_at], side) if len(search.run_at) else (np.zeros(0, np.int64), np.zeros(0, np.int64), None)
    run_starts = np.concatenate([[0], np.cumsum(np.bincount(run_owners, minlength=n))])
    mark, run_mark = np.zeros(count, bool), np.zeros(int(run_values.max(initial=-1)) + 1, bool)
    search.open()
    search.number(np.where(place < 0, -1, values[place]), count)
    known, within, at = search.known, _coverable(search, place), np.arange(search.known.shape[1])
    entries = np.full(known.shape, -1)
    entries[search.owner, search.column] = place

    def look(pairs: list[tuple[int, np.ndarray]]) -> None:
        a, b = np.repeat([x for x, _ in pairs], [len(y) for _, y in pairs]), np.concatenate([y for _, y in pairs])
        how = _in_common_with(a, b, values, starts, mark)
        kept = (how >= search.least) & (how >= need * (search.fewest[a] + search.fewest[b]) - 1e-3)
        if len(run_mark):  # all that some have in common is one run, with whose first text they are joined otherwise
            shared = _in_common_with(a, b, run_values, run_starts, run_mark)
            kept &= (shared == 0) | (how > shared + search.size - 1)
        a, b, how = a[kept], b[kept], how[kept]
        for k in range(0, len(a), 4096):
            search.look(a[k : k + 4096], b[k : k + 4096], how[k : k + 4096])

    held, size, most, since = [], 0, 1, n
    for a in np.flatnonzero(fit).tolist():
        if since >= max(64, n // 16):
            since, open_ = 0, (known > ids[a]) & within & fit[:, None]
            closed = within & (known >= 0) & ~open_
            first, last = closed.argmax(1), known.shape[1] - 1 - closed[:, ::-1].argmax(1)
            gaps = (open_ & (at > first[:, None]) & (at < last[:, None])).any(1) & closed.any(1)
            new = np.zeros(len(values), bool)
            new[entries[open_ & (entries >= 0)]] = True
            new = np.flatnonzero(new)  # by window
            new_values, new_windows = values[new], owners[new]
            new_starts = np.searchsorted(new_windows, np.arange(n + 1))
        some, later, found = slice(starts[a], starts[a + 1]), new_starts[a + 1], np.zeros(n, bool)
        found[rare_windows[_ranges(rare_begin[some], rare_end[some])[0]]] = True
        if long_[a] > (len(new) - later) // 8:  # else these are few enough
            able = gaps | gaps[a]
            mark[values[some]] = True
            able[new_windows[later:][mark[new_values[later:]]]] = True
            mark[values[some]] = False
            mine = new[new_starts[a] : later]
            able[windows[_ranges(begin[mine], end[mine])[0]]] = True
            found &= able
        after = np.flatnonzero(found)
        after = after[ids[after] > ids[a]]
        after = after if side is None else after[side[after] != side[a]]
        after = search.worth(a, after) if len(after) > FEW else after
        since += 1
        if len(after):
            held.append((a, after))
            size += len(after)
        if size >= most:  # few at first, as most of what comes is known by them
            look(held)
            held, size, most, since = [], 0, min(1024, 2 * most), since + max(16, n // 64)
    if held:
        look(held)


def _coverable(search: _Search, place: np.ndarray) -> np.ndarray:
    """Which places could be in a passage: in a window of unlike tokens, those in a stretch with SIMILARITY of values that others have too."""
    hit = np.zeros(search.lines.shape, bool)
    some = place >= 0
    hit[search.owner[some], search.column[some]] = True
    lo, hi = _reach(hit, np.full(search.n, SIMILARITY, np.float32), search.width, np.zeros(search.n, bool))
    at = np.arange(hit.shape[1])
    return (_within(hit, SIMILARITY) & (at >= lo[:, None]) & (at < hi[:, None])) | ~search.unlike[:, None]


def _fewest_values(tokens: np.ndarray, owner: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values the run of width tokens with the fewest has, of each owner; whether all of the owner's are different."""
    n, at = len(offsets) - 1, np.arange(len(tokens))
    order = np.lexsort((at, tokens, owner))
    again = (tokens[order[1:]] == tokens[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    unlike = np.ones(n, bool)
    unlike[owner[order[1:][again]]] = False
    before = offsets[:-1][owner] - 1
    before[order[1:][again]] = order[:-1][again]
    count = np.zeros(len(tokens) + 1, np.int64)  # by a run's first place: a token counts in runs from after its like before it
    np.add.at(count, np.maximum(before + 1, at - width + 1), 1)
    count[1:] -= 1
    count = np.cumsum(count[:-1])
    whole = at + width <= offsets[1:][owner]
    fewest = np.full(n, width)
    np.minimum.at(fewest, owner[whole], count[whole])
    return fewest, unlike


def _gaps(known: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Which rows have places between closed ones that aren't closed."""
    closed = closed & (known >= 0)
    return (closed[:, 1:] > closed[:, :-1]).sum(1) + closed[:, 0] > 1


def _cover_runs(known: np.ndarray, runs: np.ndarray, owner: np.ndarray, column: np.ndarray, ids: np.ndarray, size: int) -> None:
    """Enters the least other text of those in the blocks that have each run of size tokens."""
    if not len(runs):
        return
    run, me = np.unique(runs, return_inverse=True)[1], ids[owner]
    far = int(ids.max()) + 1
    least = np.full(int(run.max()) + 1, far)
    np.minimum.at(least, run, me)
    second = np.full(len(least), far)
    later = me != least[run]
    np.minimum.at(second, run[later], me[later])
    other = np.where(later, least[run], second[run])
    met = other < far
    row, start, other = owner[met], column[met], other[met].astype(np.int32)
    for k in range(size):
        np.minimum.at(known, (row, start + k), other)


def _beside(x: np.ndarray, y: np.ndarray, off: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens of each row of x the row of y has in their place, or up to off beside it; which of y that of x; and how far beside it they are at most."""
    m, n = x.shape
    hit_x, hit_y, most = np.zeros(x.shape, bool), np.zeros(x.shape, bool), np.zeros(m, np.int64)
    for d in range(-off, off + 1):
        p, q = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))
        same = x[:, p] == y[:, q]
        hit_x[:, p] |= same
        hit_y[:, q] |= same
        most[same.any(1)] = np.maximum(most[same.any(1)], abs(d))
    return hit_x, hit_y, most


def _balance(hit: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Hits before each place beyond share of the tokens there."""
    total = np.zeros((len(hit), hit.shape[1] + 1), np.float32)
    np.cumsum(hit, 1, dtype=np.float32, out=total[:, 1:])
    return total - np.arange(hit.shape[1] + 1, dtype=np.float32) * np.reshape(np.asarray(share, np.float32), (-1, 1))


def _best_stretch(hit: np.ndarray, share: np.ndarray, width: int) -> np.ndarray:
    """The most hits beyond share that a stretch of width tokens and more has, of each row."""
    p = _balance(hit, share)
    return (p[:, width:] - np.minimum.accumulate(p, 1)[:, : p.shape[1] - width]).max(1)


def _reach(hit: np.ndarray, share: np.ndarray, width: int, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where stretches with share of hits go, from a hit to a hit; the whole row where all_ says so."""
    n = hit.shape[1]
    size = int(np.ceil(float(share.min()) * width - 1e-3))
    p = _balance(hit, share)
    last = (p[:, size:] >= np.minimum.accumulate(p, 1)[:, : n + 1 - size] - 1e-3) & hit[:, size - 1 :]
    first = (p[:, : n + 1 - size] <= np.maximum.accumulate(p[:, ::-1], 1)[:, ::-1][:, size:] + 1e-3) & hit[:, : n + 1 - size]
    lo, hi = first.argmax(1), n - last[:, ::-1].argmax(1)
    lo, hi = np.where(first.any(1), lo, 0), np.where(last.any(1), hi, 0)
    return np.where(all_, 0, lo), np.where(all_, n, hi)


def _shared(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, id, place, n) of the windows whose signature n windows have, 2 at least."""
    postings = windows.select("id", F.explode(F.arrays_zip("signatures", "places")).alias("w")).select(F.col("w.signatures").alias("sig"), "id", F.col("w.places").alias("place"))
    counts = postings.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    # what a join needs of groups is written first: both its sides are then shuffled as they are, and Spark splits hot signatures
    return postings.join(scratch.materialize(counts, "signatures"), "sig")


def _pairs(shared: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, scratch: Scratch) -> DataFrame:
    """(a, b, a_from, a_to, b_from, b_to): pairs of texts on which enough hash functions agree or that have a run in common, and where to compare them."""
    few = shared.where(F.col("n") <= SHORT).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("id", "place"))).alias("g"))
    few = few.select("sig", F.explode(F.expr(f"flatten(transform(g, (p, i) -> transform(filter(slice(g, i + 2, {SHORT}), q -> q.id <> p.id), q -> struct(p, q))))")).alias("x")).select("sig", F.col("x.p").alias("p"), F.col("x.q").alias("q"))
    many = shared.where(F.col("n") > SHORT).select("sig", "id", "place")

    def field(side: str, shift: int, bits: int):
        return F.shiftrightunsigned(F.col(f"{side}.place"), shift).bitwiseAND(F.lit((1 << bits) - 1))

    left = F.least(field("p", 24, 8), field("q", 24, 8))
    right = F.least(field("p", 16, 8), field("q", 16, 8))
    joined = few.where(left + right + 1 >= int(width * SIMILARITY))
    bit = F.expr(f"shiftleft(1, cast(sig & {LOW - 1} as int))")
    joined = joined.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), bit.alias("bit"), field("p", 32, 32).alias("ca"), field("q", 32, 32).alias("cb"))
    joined = joined.select("*", F.col("ca").alias("ca_to"), F.col("cb").alias("cb_to"))
    if many.limit(1).count():
        found = _found_again(many, texts_of, width, scratch)
        joined = joined.unionByName(_same(found, scratch)).unionByName(_near(found, texts_of, width, scratch))
    pairs = joined.groupBy("a", "b").agg(F.bit_or("bit").alias("bits"), *(f(c).alias(n) for x in "ab" for f, c, n in ((F.min, f"c{x}", f"{x}_from"), (F.max, f"c{x}_to", f"{x}_to"))))
    margin = width + WORDS
    wide = [c for x in "ab" for c in (F.greatest(F.lit(0).cast("long"), F.col(f"{x}_from") - margin).alias(f"{x}_from"), (F.col(f"{x}_to") + margin).alias(f"{x}_to"))]
    return pairs.where(F.bit_count("bits") >= ENOUGH).select("a", "b", *wide)


def _pieces(texts: DataFrame) -> DataFrame:
    """(id, piece, tokens): a text's tokens, 32 bits each, PIECE at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, pieces = [], [], []
            for row, _, tokens in _token_lists(batch, 1):
                short = (tokens >> _U(32)).astype(np.uint32)
                for k in range(0, len(short), PIECE):
                    ids.append(row)
                    numbers.append(k // PIECE)
                    pieces.append(short[k : k + PIECE].tobytes())
                if len(ids) > 5000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(numbers, pa.int64()), pa.array(pieces, pa.binary())], ["id", "piece", "tokens"])
                    ids, numbers, pieces = [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(numbers, pa.int64()), pa.array(pieces, pa.binary())], ["id", "piece", "tokens"])

    return texts.mapInArrow(trimmed(run), "id long, piece long, tokens binary")


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """From where to where hits follow each other."""
    edge = np.zeros(len(hit) + 2, bool)
    edge[1:-1] = hit
    edge = np.flatnonzero(edge[1:] != edge[:-1]).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def _within(hit: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Which places are in a stretch, from a hit to a hit, with share of hits."""
    p = _balance(hit, share)
    before = np.minimum.accumulate(np.where(hit, p[:, :-1], np.float32(np.inf)), 1)
    after = np.maximum.accumulate(np.where(hit, p[:, 1:], np.float32(-np.inf))[:, ::-1], 1)[:, ::-1]
    return after >= before - 1e-3


def _dense(hit: np.ndarray, width: int) -> np.ndarray:
    """Which places passages may take, of rows that have all tokens in common in one place (with nothing off, _bounds has these on both sides)."""
    share, at = 2 * SIMILARITY / (1 + SIMILARITY), np.arange(hit.shape[1])
    if not len(hit):
        return hit
    lo, hi = _reach(hit, np.full(len(hit), share, np.float32), width, np.zeros(len(hit), bool))
    return _within(hit, share) & (at >= lo[:, None]) & (at < hi[:, None])


def _bounds(hits: list[np.ndarray], width: int, off: np.ndarray) -> list[np.ndarray]:
    """Which places of either row, without like tokens of its own, passages of a pair may take if all tokens in common are at most off apart.

    In one of two passages of the SIMILARITY the tokens in common are 2 * SIMILARITY / (1 + SIMILARITY) at least, in the other fewer, as
    it is up to 2 * off longer.
    """
    share, n = 2 * SIMILARITY / (1 + SIMILARITY), hits[0].shape[1]
    at, dense = np.arange(n), [_dense(hit, width) for hit in hits]
    first, last = np.maximum(0, at - off[:, None]), np.minimum(n, at + off[:, None] + 1)
    out = []
    for side, hit in enumerate(hits):
        total = np.pad(np.cumsum(dense[1 - side], 1, dtype=np.int32), ((0, 0), (1, 0)))
        beside = np.take_along_axis(total, last, 1) > np.take_along_axis(total, first, 1)
        out.append(dense[side] | (_within(hit, np.maximum(SIMILARITY, share * (1 - off / (SIMILARITY * width)))) & beside))
    return out


def _spans(runs: list[tuple[int, int]], width: int, share: float) -> list[tuple[int, int]]:
    """Stretches, from a hit to a hit, whose hits are share of them, and of width: runs of hits, joined over gaps."""
    out: list[tuple[int, int, int]] = []
    for s, e in runs:
        n = e - s
        while out and out[-1][2] + n >= share * (e - out[-1][0]):  # a longer run may reach further back
            s, n = out[-1][0], n + out.pop()[2]
        out.append((s, e, n))
    return [(s, e) for s, e, n in out if n >= share * width]


def _widened(s: int, e: int, lo: int, hi: int, n: int, m: int, width: int) -> tuple[int, int, int, int]:
    """[s, e) of n tokens and [lo, hi) of m, made width long, on both sides where there is room."""
    more = width - min(e - s, hi - lo)
    if more <= 0:
        return s, e, lo, hi
    left = min(s, lo, max(more // 2, more - min(n - e, m - hi)))
    right = min(n - e, m - hi, more - left)
    return s - left, e + right, lo - left, hi + right


def _places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x whose value y has, and the first place in y of each."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(y, kind="stable")
    sorted_ = y[order]
    at = np.searchsorted(sorted_, x)
    at[at == len(y)] = 0
    hit = np.flatnonzero(sorted_[at] == x)
    return hit, order[at[hit]]


def _diagonals(places: tuple[list, list], least: int, beside: int = 3) -> list[list[int]]:
    """Shifts from a to b that at least least tokens of a (by their first place in b) or of b (in a) suggest, and those close to them that beside tokens do; close ones together.

    places has those first places, None where there is none.
    """
    votes = Counter([p - i for i, p in enumerate(places[0]) if p is not None])
    for shift, n in Counter([i - p for i, p in enumerate(places[1]) if p is not None]).items():
        if n > votes[shift]:
            votes[shift] = n
    strong, out = sorted(shift for shift, n in votes.items() if n >= least), []
    if not strong:
        return out
    for shift in sorted(shift for shift, n in votes.items() if n >= min(beside, least)):
        at = bisect_left(strong, shift)
        if any(abs(near - shift) <= 2 * WORDS for near in strong[max(0, at - 1) : at + 1]):
            if out and shift - out[-1][-1] <= 2 * WORDS:
                out[-1].append(shift)
            else:
                out.append([shift])
    return out


def _run_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    n = len(tokens)
    if n < size:
        return np.zeros(0, _U)
    p, q = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(mix(tokens.astype(_U)) * p[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * q[: n - size + 1])


def _same_stretches(x: np.ndarray, y: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(from, to, place): stretches of x of which y has every run of width tokens, and a place in y of their first run."""
    hit, place = _places(_run_hashes(x, width), _run_hashes(y, width))
    if not len(hit):
        return []
    new = np.concatenate([[0], np.flatnonzero(np.diff(hit) > width) + 1])
    last = np.append(new[1:], len(hit)) - 1
    return list(zip(hit[new].tolist(), (hit[last] + width).tolist(), place[new].tolist(), strict=True))


def _stretches(lines: list[np.ndarray], shifts: list[int], n: int, m: int, width: int, alike: Callable[[int, int, int, int], bool]) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to) of what is alike along diagonals close together: lines says where a (of n tokens) has the token of b (of m) that is shift further."""
    out, share = [], 2 * SIMILARITY / (1 + SIMILARITY)  # the hits of passages of that similarity
    hit = np.any(lines, axis=0) if len(lines) > 1 else lines[0]
    runs = _runs(hit)

    def add(s: int, e: int) -> bool:
        if len(lines) == 1 and hit[s] and hit[e - 1]:
            lo, hi = s + shifts[0], e + shifts[0]
        else:
            ends = [(int(at[k]) + s + shift) for line, shift in zip(lines, shifts, strict=True) for at in (np.flatnonzero(line[s:e]),) if len(at) for k in (0, -1)]
            lo, hi = min(ends), max(ends) + 1
        u, v, lo, hi = _widened(s, e, lo, hi, n, m, width)
        if min(v - u, hi - lo) < width or not alike(u, v, lo, hi):
            return False
        out.append((u, v, lo, hi))
        return True

    for s, e in _spans(runs, width, LOOSE * share):  # hits on no diagonal are left to alike
        if add(s, e):
            continue
        for u, v in _spans([run for run in runs if s <= run[0] < e], width, share):
            if add(u, v):
                continue
            for line, shift in zip(lines, shifts, strict=True):  # not alike as a whole: what is the same
                out += [(u + i, u + j, u + i + shift, u + j + shift) for i, j in _runs(line[u:v]) if j - i >= width]
    total = np.zeros(n + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    if total[-1] - max([total[v] - total[u] for u, v, _, _ in out], default=0) >= share * width:  # what is alike within a stretch that isn't, and meets nothing that is known
        good = np.flatnonzero(total[width:] - total[:-width] >= share * width)
        seen = np.zeros(n + 1, np.int64)
        for u, v, _, _ in out:
            seen[u + 1 : v + 1] = 1
        seen = np.cumsum(seen)
        good = good[seen[good + width] == seen[good]]
        for some in np.split(good, np.flatnonzero(np.diff(good) > width) + 1) if len(good) else ():
            at = int(some[np.argmax(total[some + width] - total[some])])
            add(at, at + width)
    return out


def shared_passages(a: np.ndarray, b: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to) of the passages of a and b, in tokens, that are alike.

    Tokens are compared along diagonals; diagonals a few tokens apart, as insertions make them, are taken together.
    Stretches of either that the other has too, at whatever place, are added where no diagonal covers them.
    Most pairs are a hundred tokens each, for which dicts and sets take less time than arrays.
    """
    return _shared_passages(_numbered(a), _numbered(b), width)


def _numbered(tokens: np.ndarray) -> tuple[np.ndarray, list[int], dict[int, int]]:
    """Tokens, as a list too, and the first place of each."""
    x = tokens.tolist()
    return tokens, x, dict(zip(reversed(x), range(len(x) - 1, -1, -1), strict=True))


def _shared_passages(mine: tuple, other: tuple, width: int) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    (a, x, first_x), (b, y, first_y) = mine, other
    places = list(map(first_y.get, x)), list(map(first_x.get, y))

    def alike(u: int, v: int, lo: int, hi: int) -> bool:
        mine, other = set(x[u:v]), set(y[lo:hi])
        both = len(mine & other)
        return both >= SIMILARITY * (len(mine) + len(other) - both)

    for shifts in _diagonals(places, max(2, width // 4)):
        lines = []
        for shift in shifts:
            lo, hi = max(0, -shift), min(len(x), len(y) - shift)
            line = np.zeros(len(x), bool)
            line[lo:hi] = a[lo:hi] == b[lo + shift : hi + shift]
            lines.append(line)
        out += _stretches(lines, shifts, len(x), len(y), width, alike)
    left = [_rows_left(places[side], [span[2 * side : 2 * side + 2] for span in out], width) for side in (0, 1)]
    more = [_uncovered(_same_stretches(*pair, width), [span[2 * side : 2 * side + 2] for span in out], len(pair[0])) if left[side] else [] for side, pair in enumerate(((a, b), (b, a)))]
    return out + [(s, e, at, at + width) for s, e, at in more[0]] + [(at, at + width, s, e) for s, e, at in more[1]]


def _rows_left(places: list, spans: list[tuple[int, int]], width: int) -> bool:
    """Whether width tokens in a row have a place in the other text, and one of such a row is in no span."""
    has = bytearray([p is not None for p in places])
    left, row, at = has[:], bytes([1]) * width, has.find(bytes([1]) * width)
    if at < 0:
        return False
    for s, e in spans:
        left[s:e] = bytes(e - s)
    while at >= 0:
        end = has.find(0, at)
        end = end if end >= 0 else len(has)
        if 1 in left[at:end]:
            return True
        at = has.find(row, end)
    return False


def _uncovered(found: list[tuple[int, int, int]], spans: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """Those of found that aren't within spans."""
    known = np.zeros(n, bool)
    for s, e in spans:
        known[s:e] = True
    return [x for x in found if not known[x[0] : x[1]].all()]


def _straight_passages(hit: np.ndarray, begins: tuple[int, int], ends: tuple[int, int], width: int) -> list[tuple[int, int, int, int]]:
    """As shared_passages, of two rows without like tokens of their own, begins to ends, that have all that is in both in one place: where hit says."""
    total = [0, *accumulate(hit[begins[0] : ends[0]].tolist())]
    shift = begins[0] - begins[1]

    def alike(u: int, v: int, lo: int, hi: int) -> bool:
        both = max(0, total[min(v, max(hi - shift, 0))] - total[max(u, min(lo - shift, v))])
        return both >= SIMILARITY * (v - u + hi - lo - both)

    if total[-1] < max(2, width // 4):
        return []
    return _stretches([hit[begins[0] : ends[0]]], [shift], ends[0] - begins[0], ends[1] - begins[1], width, alike)


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, a_from, a_to, b, b_from, b_to) in words, of the passages that the pairs share."""
    asked = None
    for side, me in enumerate("ab"):
        numbers = F.explode(F.sequence(F.floor(F.col(f"{me}_from") / PIECE), F.floor(F.col(f"{me}_to") / PIECE)))
        one = pairs.select("a", "b", F.lit(side).alias("side"), F.col(me).alias("id"), numbers.alias("piece"))
        asked = one if asked is None else asked.unionByName(one)
    sent = asked.join(_pieces(texts), ["id", "piece"]).select("a", "b", "side", "piece", "tokens")
    sent = sent.repartition(-(-pairs.count() // COMPARED) or 1, "a", "b").sortWithinPartitions("a", "b", "side", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = None, ([], [])
        out: list[tuple] = []

        def close() -> None:
            runs: list[list] = [[], []]  # pieces that follow each other, of each side
            for side in (0, 1):
                for number, data in pieces[side]:
                    if runs[side] and runs[side][-1][1] == number:
                        runs[side][-1][1] += 1
                        runs[side][-1][2].append(data)
                    else:
                        runs[side].append([number, number + 1, [data]])
            for fa, _, da in runs[0]:
                a = np.frombuffer(b"".join(da), np.uint32)
                for fb, _, db in runs[1]:
                    b = np.frombuffer(b"".join(db), np.uint32)
                    for s, e, lo, hi in shared_passages(a, b, width):
                        out.append((last[0], fa * PIECE + s, fa * PIECE + e + WORDS - 1, last[1], fb * PIECE + lo, fb * PIECE + hi + WORDS - 1))

        for batch in batches:
            firsts, seconds, *rest = (batch.column(c).to_pylist() for c in range(5))
            for pair, side, number, data in zip(zip(firsts, seconds, strict=True), *rest, strict=True):
                if pair != last:
                    if last is not None:
                        close()
                    last, pieces = pair, ([], [])
                pieces[side].append((number, data))
            if len(out) > 10_000:
                yield _span_batch(out)
                out.clear()
        if last is not None:
            close()
        if out:
            yield _span_batch(out)

    return sent.mapInArrow(trimmed(run), "a long, a_from long, a_to long, b long, b_from long, b_to long")


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "a_from", "a_to", "b", "b_from", "b_to"])


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of an id that overlap or touch, as one: (id, first_word, end_word, other), other being the least of theirs."""
    spans = spans.groupBy("id", "s", "e").agg(F.min("other").alias("other"))
    order = W.partitionBy("id").orderBy("s", "e")
    start = F.coalesce(F.col("s") > F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("_new", start.cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("id", "_island").agg(F.min("s").alias("first_word"), F.max("e").alias("end_word"), F.min("other").alias("other")).drop("_island")


def _found(df: DataFrame, key: str, text: str, shortest: int) -> tuple[DataFrame, DataFrame]:
    """Contents, with their words, and the verified spans between them."""
    width, scratch, earlier = shortest - WORDS + 1, Scratch(df.sparkSession), Scratch(df.sparkSession)
    contents = earlier.materialize(_contents(df, key, text), "contents")
    windows = earlier.materialize(_windows(_texts(df, contents, key, text), width), "compact-windows")
    shared = scratch.materialize(_shared(windows, earlier), "windows-shared")
    contents = materialize(contents.join(windows.groupBy("id").agg(F.max("words").alias("words")), "id"), "contents")
    earlier.drop()

    def texts_of(ids: DataFrame) -> DataFrame:
        return _texts(df, scratch.materialize(contents.join(ids, "id", "left_semi"), "passage-texts"), key, text)

    pairs = scratch.materialize(_pairs(shared, texts_of, width, scratch), "passage-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    spans = materialize(_verified(pairs, texts_of(wanted), width), "passages")
    scratch.drop()
    return contents, spans


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(key, first_word, end_word, n_words, earliest_id, repeats, copies): each row's passages of at least shortest words that other texts, or copies of it, have.

    Passages of a row that overlap are one.  repeats says whether a text with a smaller key has (part of) it;
    earliest_id is the least id known to have it, ids being the texts' smallest keys (a hash if that is null or names
    several texts).  A row with copies has its whole text as a passage.  Repeats within a text alone don't count.

    A null or short text has none, nor has a row without repeats; null keys are kept; repeated rows are copies;
    an empty table gives none; other columns are left out.

    Of passages that are the same for shortest words none is missed.  Near ones are missed where fewer than ENOUGH of
    HASHES min-hashes agree (6 in 1000 at a similarity of just SIMILARITY).  Under signatures of more than SHORT
    windows one of the first SEARCHED is enough (missed: 8 in 1000): all their different windows are compared, and pairs that
    are alike there count unless others cover the same places with the same or smaller ids.  Long groups of the other functions aren't
    searched: a pair that meets in long groups of these alone needs ENOUGH short ones of the rest (missed, at the worst, 1 in 10 at
    a similarity of just SIMILARITY).
    """
    contents, spans = _found(df, key, text, shortest)
    both = spans.select(F.col("a").alias("id"), F.col("a_from").alias("s"), F.col("a_to").alias("e"), F.col("b").alias("other"))
    both = both.unionByName(spans.select(F.col("b").alias("id"), F.col("b_from").alias("s"), F.col("b_to").alias("e"), F.col("a").alias("other")))
    whole = contents.where((F.col("copies") > 1) & (F.col("words") >= shortest)).select("id", F.lit(0).cast("long").alias("s"), F.col("words").alias("e"), F.col("id").alias("other"))
    merged = _merged(both.unionByName(whole))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), *_content(text))
    placed = rows.join(contents.select("c0", "c1", "id", "first", "copies").join(merged, "id"), ["c0", "c1"])
    later = (F.col("other") < F.col("id")) | ~F.col("_key").eqNullSafe(F.col("first"))
    return placed.select(F.col("_key").alias(key), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), F.least("id", "other").alias("earliest_id"), later.alias("repeats"), "copies")


def _without(texts: pa.Array, starts: list[list[int]], ends: list[list[int]]) -> list[str]:
    """Each text without its words [start, end) of each span."""
    out = []
    for value, s, e in zip(texts, starts, ends, strict=True):
        data = value.as_py().encode()
        _, at, _, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        at = [*at.tolist(), len(data)]
        left, pos = [], 0
        for x, y in zip(s, e, strict=True):
            left.append(data[pos : at[x]])
            pos = at[min(y, len(at) - 1)]
        left.append(data[pos:])
        out.append(b"".join(left).decode())
    return out


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", shortest: int = SHORTEST) -> DataFrame:
    """df with the passages cut that a text with a smaller key has; n_chars, where it is there, is counted anew.

    Rows that have nothing left, and copies of at least shortest words but the one with the smallest key, go; of
    rows repeating a key and text, one stays.  Rows without words (null and empty texts) and rows with a null key stay
    as they are, unless they repeat; an empty table gives none; all columns are kept, whatever their names.
    """
    contents, spans = _found(df, key, text, shortest)
    cuts = _merged(spans.select(F.col("b").alias("id"), F.col("b_from").alias("s"), F.col("b_to").alias("e"), F.col("a").alias("other")))
    cuts = cuts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("cuts"))
    plan = contents.where("words >= %d" % shortest).join(cuts, "id", "left").where("copies > 1 or cuts is not null")
    plan = materialize(plan.select("c0", "c1", "first", F.lit(True).alias("touched"), "copies", "cuts"), "cuts")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_IDS else plan  # else Spark may shuffle all texts for a few cuts
    whole = df.select(F.struct("*").alias("r"), F.col(key).alias("key"), *_content(text)).join(plan, ["c0", "c1"], "left")
    alone = whole.where("touched is null").select("r.*")
    kept = whole.where(F.col("touched") & F.col("key").eqNullSafe(F.col("first")))
    kept = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["c0", "c1"]))  # what is there once isn't shuffled
    starts, ends = (F.coalesce(F.col(f"cuts.{f}"), F.array().cast("array<long>")).alias(f) for f in ("first_word", "end_word"))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _without(batch.column(2).field(at), batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], ["cut", "r"])

    cut = kept.select(starts, ends, "r").mapInArrow(trimmed(run), StructType([StructField("cut", StringType()), kept.schema["r"]]))
    cut = cut.where(F.regexp_count("cut", F.lit(r"[^\x20\x09-\x0D]")) > 0)
    new = {text: F.col("cut")} | ({n_chars: F.length("cut").cast(df.schema[n_chars].dataType)} if n_chars in df.columns else {})
    return alone.unionByName(cut.select(*(new.get(c, F.col("r")[c]).alias(c) for c in df.columns)))
