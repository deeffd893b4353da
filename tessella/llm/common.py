"""Shared helpers: written tables in the shared folder, and vectorised word kernels.

The kernels work on whole Arrow string columns as flat byte arrays, so there is
no Python loop over words.  A word is a run of bytes other than space and
0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that one kernel call takes at once (a longer text is taken alone).
CHUNK_BYTES = 1 << 20
#: Spark's setting for the bytes of a batch that goes to Python, and what texts are sent by: a task holds a batch
#: several times, in the JVM (outside its heap) and in its worker.
BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a new local one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> bool:
    """Rows go to Python in batches of about BATCH_BYTES from now on; False, and nothing changes, if the session has a limit of its own."""
    if spark.conf.get(BATCHES, None) is not None:
        return False
    spark.conf.set(BATCHES, str(BATCH_BYTES))
    return True


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches for what is run within."""
    bound = bound_batches(spark)
    try:
        yield
    finally:
        if bound:
            spark.conf.unset(BATCHES)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and lost executors cost nothing."""
    return _written(df, new_path(df.sparkSession, tag))


#: Where the shared folder is a mounted file system, tables that a run makes for itself get no checksum files beside
#: theirs: Hadoop's class for such folders starts a process four times a file to set permissions, this one once.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that only the making of other written tables needs; drop() removes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def materialize(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(new_path(self.spark, tag))
        return _written(df, self.paths[-1])

    def drop(self) -> None:
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _table(n: int, by: int) -> np.ndarray:
    out = np.full(n, by, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += np.uint8(32)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        n = max(n, CHUNK_BYTES + 1)
        _POWERS.update(p=_table(n, _BASE), q=_table(n, _INVERSE))
    return _POWERS["p"], _POWERS["q"]


def _words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Prefix sums of the lower-cased bytes' polynomial, inverse powers, starts and ends of words, and each text's first word."""
    cuts = (offsets - offsets[0]).astype(np.int64)
    n = len(data)
    raw = data.tobytes()  # bytes are translated several times faster than arrays are indexed
    word = np.frombuffer(raw.translate((~separators).tobytes()), bool)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = _powers(n + 1)
    values = np.frombuffer(raw.translate(_LOWER.tobytes()), np.uint8).astype(_U)
    values += _U(1)
    values *= p[:n]
    total = np.zeros(n + 1, _U)
    np.cumsum(values, out=total[1:])
    return total, q, starts, ends, np.searchsorted(starts, cuts)


def _hashed(total: np.ndarray, q: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(_U))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts data[offsets[i]:offsets[i+1]]: hashes, byte starts, byte ends, and the first word's number of each text.

    The hash is of the word's lower-cased bytes; the last array has one entry more than there are texts.
    """
    base = int(offsets[0])
    total, q, starts, ends, first = _words(data[base : int(offsets[-1])], offsets, _SPACE)
    return _hashed(total, q, starts, ends), starts + base, ends + base, first


def word_start_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word hashes, each text's first word, and for each of lengths the hashes of the words' first so many bytes."""
    total, q, starts, ends, first = _words(data[int(offsets[0]) : int(offsets[-1])], offsets, separators)
    return _hashed(total, q, starts, ends), first, [_hashed(total, q, starts, np.minimum(ends, starts + n)) for n in lengths]


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of k words from each position on; which of them lie within one text (first: as from word_hashes)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    out = np.zeros(n, _U)
    for i in range(k):
        out = out * _U(_BASE) + hashes[i : n + i]
    ok = np.ones(n, bool)
    for i in range(1, k):
        at = first[1:-1] - i
        ok[at[(at >= 0) & (at < n)]] = False
    return mix(out), ok


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of an Arrow string column; a null counts as empty."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(offsets: np.ndarray, most: int = 0):
    """Ranges (i, j) of texts of about most bytes each, one text at least."""
    most, i, n = most or CHUNK_BYTES, 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def binary_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of an Arrow binary column without nulls."""
    import pyarrow as pa

    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def sorted_groups(batches, n_keys: int):
    """Arrow tables, one for each run of rows that agree in the first n_keys columns (integers or binaries), of rows that come sorted by them.

    Only one group is held at a time.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for i in range(n_keys):
            column = batch.column(i)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        key = tuple(batch.column(i)[0] for i in range(n_keys))
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(i)[batch.num_rows - 1] for i in range(n_keys))
    if held:
        yield pa.Table.from_batches(held)


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels after the pairs (i, j) are joined: each part has its least number as label."""
    while len(i):
        a, b = labels[i], labels[j]
        at = a != b
        if not at.any():
            break
        i, j, a, b = i[at], j[at], a[at], b[at]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def trimmed(run):
    """run, a function of a task's batches, that gives the memory that it has freed back at its end: workers live on between tasks."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def forget_tables() -> None:
    """Frees the kernels' tables: for a worker that goes on to work without them (they are made anew where they are needed)."""
    _POWERS.clear()
    give_back()


def give_back() -> None:
    """Gives the process's freed memory back."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)
