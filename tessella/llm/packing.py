"""Packing tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import forget_tables, give_back, materialize, small_batches, trimmed

#: Pieces in a bin, on average; each bin is packed by one task, from lengths alone.
BIN_PIECES = 16384
#: Byte strings of token ids that one task remembers.
CACHED_WORDS = 100_000
# Letters, digits and white space of the characters that the fast path takes; other texts go to the library whole.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼½¾"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*\Z")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^ \t\n\r{_LETTER}{_DIGIT}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Bytes of a pre-token's ids, by pre-token.

    A byte-level tokeniser encodes pre-tokens one by one, so a text's ids are those of its pre-tokens in a row;
    each distinct one is encoded once by the library's model, and kept as long as it is met again.  Other
    tokenisers, texts with rare characters, and texts with an added token in them, are left to the library whole.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model, self.letters, self.older = tokenizer, tokenizer.model, _byte_letters(), {}
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) if added else r"(?!)")
        self.by_word = tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not tokenizer.pre_tokenizer.add_prefix_space

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        if self.by_word and _PLAIN.match(text) and not self.added.search(text):
            return b"".join(map(self.__getitem__, _SPLIT.findall(text)))
        return self.encoded(text)


@lru_cache(2)
def word_ids(vocabulary: str, split_special: bool = False) -> WordIds:
    """One per worker process and vocabulary: a process runs many tasks.  split_special: the names of special tokens in a text count as its words."""
    from tokenizers import Tokenizer

    forget_tables()  # what operators before left in this process
    tokenizer = Tokenizer.from_file(vocabulary)
    give_back()
    if split_special:
        tokenizer.encode_special_tokens = True
    return WordIds(tokenizer)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree that finds the tightest that fits."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _set(self, capacity: int, on: int) -> None:
        i = capacity + self.size
        while i and self.tree[i] != on:
            self.tree[i] = on
            i //= 2
            if i:
                on = self.tree[2 * i] | self.tree[2 * i + 1]

    def add(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._set(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least length, and that capacity; it is taken out."""
        i, tree = length + self.size, self.tree
        while not tree[i]:
            while i & 1:
                i //= 2
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        found = self.at[capacity].pop()
        if not self.at[capacity]:
            self._set(capacity, 0)
        return found, capacity


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """Window and offset of each length (in falling order), and each window's fill."""
    opened, fill, ids, offsets = OpenWindows(window), [], [], []
    for n in lengths:
        found = opened.take(n)
        if found is None:
            found = len(fill), window
            fill.append(0)
        at, capacity = found
        ids.append(at)
        offsets.append(fill[at])
        fill[at] += n
        if capacity > n:
            opened.add(capacity - n, at)
    return ids, offsets, fill


def token_pieces(df: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", split_special: bool = False) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens) of each document's ids followed by end_id: whole windows, then the rest.

    Names of special tokens in a text give those tokens, as the library has it, or with split_special are words like
    others.  A null or empty text is the end id alone; null keys are kept; repeated rows each give their pieces; an
    empty table gives none; a text of any length is one row's work; other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(vocabulary, split_special), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(words.text(value.as_py() or "") + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    stop = min(n, start + window)
                    rows.append((doc, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], [key, "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(key, text).mapInArrow(trimmed(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", split_special: bool = False) -> DataFrame:
    """Pieces with sequence_id, offset, sequence_tokens (the window's fill) and padded_length.

    The pieces' figures are written first, so that texts are read and tokenised once, in small batches.  Each bin of about BIN_PIECES of
    them is packed on its own, by best-fit decreasing over the lengths; they are dealt round robin, so one key or
    source can't fill a bin, nor can documents of many pieces.  Windows are padded to the full length unless their
    fill is a power of two.

    Texts, keys, repeated rows, empty tables and other columns: as for token_pieces.
    """
    with small_batches(df.sparkSession):
        pieces = materialize(token_pieces(df, vocabulary, window, end_id, key, text, split_special), "pieces")
    bins = max(1, -(-pieces.count() // BIN_PIECES))
    kind = df.schema[key].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        table = table.sort_by([("length", "descending"), (key, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        ids, offsets, fill = best_fit(table["length"].to_pylist(), window)
        base = TaskContext.get().partitionId() << 32
        used = [fill[i] for i in ids]
        table = table.append_column("sequence_id", pa.array([base + i for i in ids], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        table = table.append_column("sequence_tokens", pa.array(used, pa.int64())).append_column("padded_length", pa.array([n if n & (n - 1) == 0 else window for n in used], pa.int64()))
        yield from table.to_batches()

    return pieces.repartition(bins).mapInArrow(trimmed(run), f"`{key}` {kind}, {', '.join(f'{c} long' for c in [*names, 'sequence_id', 'offset', 'sequence_tokens', 'padded_length'])}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
