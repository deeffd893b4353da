"""WARC archives: a writer that stores equal payloads once, and a reader that splits gzip files by byte range."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MAGIC = b"\x1f\x8b\x08"
#: Bytes of archive that one reading range owns; most ranges in one stage's tasks.
SPLIT_BYTES, MOST_TASKS = 8 << 20, 20_000
_READ = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Hadoop's names of stores that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
#: Bytes of a range's records that are held until its members are known to follow each other; beyond, they are read again.
HELD_BYTES = 32 << 20


def _system(path: str):
    """Arrow's file system for a Hadoop path, and the path there; what has no scheme, or file:, is taken as it stands (spaces and all)."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), re.sub(r"^/{2,}", "/", rest) if scheme == "file" and colon else path
    return fs.FileSystem.from_uri(_arrow_uri(path))


def _arrow_uri(path: str) -> str:
    scheme, _, rest = path.partition(":")
    return f"{_SCHEMES.get(scheme, scheme)}:{rest}"


def _open(path: str, write: bool = False):
    system, at = _system(path)
    return system, at, system.open_output_stream(at) if write else system.open_input_file(at)


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(key) -> str:
    return f"<urn:row:{'' if key is None else quote(str(key), safe='')}>"


def page_record(key, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of refers_to, whose block is the HTTP head alone."""
    headers = {"WARC-Record-ID": _urn(key), "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    headers["WARC-Payload-Digest"] = f"sha1:{_digest(payload)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        return _record("revisit", headers | {"WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(refers_to), "Content-Type": "application/http; msgtype=response"}, http)
    return _record("response", headers | {"Content-Type": "application/http; msgtype=response"}, http + payload)


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row under path, a URI that every executor reaches; return (path, bytes, records) of each file.

    Of rows with equal payloads of at least least bytes, the one with the smallest key is the response and the
    others revisit it.  The choice is made on (key, digest) rows, pre-aggregated by digest, before the payloads are
    shuffled once, by key.  A task writes under a name of its own and renames at its end, so a task that is run
    again replaces its file.

    A null payload is empty; a null url gives no target; a null key is the largest (rows with one revisit others, and
    are responses where no row of the payload has a key); of rows with one key and payload all are responses if any is; repeated rows each give a record; an empty table gives files without pages.
    """
    text = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), text.alias("_payload"))
    slim = rows.where(F.octet_length("_payload") >= least).select("_key", F.sha1("_payload").alias("_sha"))
    first = slim.groupBy("_sha").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = slim.join(first, "_sha").where("not (_key <=> _first)").select("_key", "_sha", "_first").distinct()
    again = again.select(F.col("_key").alias("_again"), F.col("_sha").alias("_same"), "_first")
    rows = rows.withColumn("_sha", F.sha1("_payload"))
    ready = rows.join(again, (F.col("_sha") == F.col("_same")) & F.col("_key").eqNullSafe(F.col("_again")), "left").select("_key", "_url", "_payload", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        system, at, out = None, "", None
        total = records = 0
        for batch in batches:
            for k, u, p, first_key in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    system, at, out = _open(f"{path}/_tmp-{uuid.uuid4().hex}", write=True)
                    total += out.write(_record("warcinfo", {"WARC-Record-ID": f"<urn:file:{TaskContext.get().partitionId()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                total += out.write(page_record(k.as_py(), u.as_py(), p.as_py(), first_key.as_py()))
                records += 1
        if out is not None:
            out.close()
            system.move(at, _system(name)[1])
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [total], "records": [records]})

    _make(path)
    return materialize(ready.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


def _make(path: str) -> None:
    system, at = _system(path)
    system.create_dir(at, recursive=True)


class _Bytes:
    """A file's bytes from a position on, read as they are needed and let go once passed."""

    def __init__(self, file, start: int) -> None:
        self.file, self.base, self.data, self.ended = file, start, bytearray(), False
        file.seek(start)

    def fill(self, upto: int) -> bool:
        """Read on to position upto at least; False if the file ends before."""
        while not self.ended and self.base + len(self.data) < upto:
            more = self.file.read(max(_READ, upto - self.base - len(self.data)))
            self.ended = not more
            self.data += more
        return self.base + len(self.data) >= upto

    def drop(self, upto: int) -> None:
        if upto - self.base > _READ:
            del self.data[: upto - self.base]
            self.base = upto


def _walk(file, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, content) of the members that a reader finds who begins at start.

    A candidate is a place with the gzip magic.  It counts if what it holds begins as a WARC record does and its
    checksum is right; then the next candidate is where it ends.
    """
    data, at = _Bytes(file, start), start
    while at < end:
        data.drop(at)
        if not data.fill(at + len(MAGIC)):
            return
        found = data.data.find(MAGIC, at - data.base)
        while found < 0 and not data.ended and data.base + len(data.data) < end + len(MAGIC):
            skip = max(0, len(data.data) - len(MAGIC) + 1)
            data.fill(data.base + len(data.data) + 1)
            found = data.data.find(MAGIC, skip)
        if found < 0 or data.base + found >= end:
            return
        at = data.base + found
        unpacker, out, pos, good = zlib.decompressobj(31), bytearray(), at, False
        try:
            while not unpacker.eof and data.fill(pos + 1):
                piece = bytes(data.data[pos - data.base : pos - data.base + 65536])
                out += unpacker.decompress(piece)
                pos += len(piece) - len(unpacker.unused_data)
                if len(out) >= 8 and not out.startswith(b"WARC/1."):
                    break
            good = unpacker.eof and out.startswith(b"WARC/1.")
        except zlib.error:
            pass
        if good:
            yield at, pos, bytes(out)
            at = pos
        else:
            at += 1


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members with a WARC header that start in [start, end), whatever the ranges: those that a reader from the file's start finds.

    A member that starts in the range is read on beyond its end; other ranges leave it alone.  Where a range begins
    within a member, what looks like a member may be part of its payload (an archive that was stored as it is).  Its
    chain then breaks off, and the members are sought from the file's start on; only such an archive that goes on beyond the range
    isn't told apart.
    """
    if not start:
        yield from ((at, content) for at, _, content in _walk(file, start, end))
        return
    held, size, last, broken = [], 0, None, False
    for at, pos, content in _walk(file, start, end):
        if last not in (None, at):
            broken = True
            break
        last, size = pos, size + len(content)
        if size <= HELD_BYTES:
            held.append((at, content))
    if last is not None and not broken:
        file.seek(last)
        broken = file.read(len(MAGIC)) not in (MAGIC, b"")  # the last is followed by another, or by the file's end
    if broken:
        yield from ((at, content) for at, _, content in _walk(file, 0, end) if at >= start)
    elif size <= HELD_BYTES:
        yield from held
    else:
        yield from ((at, content) for at, _, content in _walk(file, start, end))


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names; type under warc-type) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers.get("content-length", len(rest)))]


_OUT = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"


def read_archives(spark: SparkSession, path: str, split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A row per response or revisit record of the *.warc.gz files under path.

    Each task takes byte ranges of files; a record belongs to the range that its first byte is in, so any split
    gives the same rows.  payload_bytes is what was read of a response, and the HTTP head's Content-Length of a revisit;
    payload_digest is that of what was read (of a revisit, the stated one), and digest_ok says whether it is the stated
    one.  payload is null for revisits or without payloads.

    Record ids are as written: an empty id for a null key; a record without a target has a null one; equal records are
    each a row; files without records, and no files, give none; a payload of any size is one row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    n = max(1, min(MOST_TASKS, ranges.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                with _open(name)[2] as file:
                    for offset, content in members(file, start, start + split):
                        headers, block = parse_record(content)
                        if headers.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        sizes = [line[15:] for line in http.decode("latin-1").split("\r\n") if line.lower().startswith("content-length:")]
                        response, stated = headers["warc-type"] == "response", headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        digest = _digest(payload) if response else stated
                        id_ = lambda k, h=headers: unquote(h[k].removeprefix("<urn:row:").removesuffix(">")) if k in h else None
                        rows.append((name, offset, id_("warc-record-id"), headers["warc-type"], headers.get("warc-target-uri"), id_("warc-refers-to"), digest, len(payload) if response else int(sizes[0]) if sizes else None, digest == stated if response else None, payload if response and payloads else None))
                        held += len(payload) if payloads else 200
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(n).mapInArrow(run, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])
