"""Media columns: AVI motion-JPEG, its frames, shots and timed clips.

Frames are baseline JPEG.  The encoder keeps a payload in the quantised DCT coefficients, the unit that
JPEG stores without loss: 576 bytes are the 9 blocks of a 24 x 24 grey frame.  Its Huffman tables give each
coefficient a code of 9 - s bits and s bits of amplitude, so frames can be coded and decoded by array
operations; frames with other tables are decoded symbol by symbol.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, SIDE, RATE = 576, 24, 24
#: Frames coded or decoded at once, which bounds the memory that a long payload takes.
BLOCK = 2048
#: Shot detection: frames on either side that set the threshold, deviations above their mean, least difference.
SPAN, DEVIATIONS, LEAST = 8, 3.0, 0.10
BINS = 16
#: Bytes of media in an Arrow batch.
BATCH_BYTES = 4 << 20

_LENGTHS, _SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
# The code lengths and symbols of JPEG's typical Huffman tables (ITU-T T.81, K.3), which frames in AVI may
# leave out.  The symbols of the AC tables that aren't named follow in rising order.
_DC_LENGTHS = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]))
_AC_LENGTHS = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]))
_AC_FIRST = (
    bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    bytes.fromhex("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
)


@lru_cache
def typical_tables() -> dict[int, tuple[bytes, bytes]]:
    """Lengths and symbols of the typical tables, by class and number."""
    every = sorted({0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))})
    out = {}
    for i in range(2):
        out[i] = _DC_LENGTHS[i], bytes(range(12))
        out[16 + i] = _AC_LENGTHS[i], _AC_FIRST[i] + bytes(x for x in every if x not in _AC_FIRST[i])
    return out


@lru_cache
def zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


@lru_cache
def _inverse() -> np.ndarray:
    """Matrix from a block's coefficients, in zigzag order, to its 64 pixels less 128."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[zigzag()].astype(np.float32)


@lru_cache
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit code of the values -255..255 (at value + 255), and value of each 9-bit code."""
    values = np.arange(-255, 256)
    size = np.array([int(abs(v)).bit_length() for v in values])
    codes = 512 - (2 << size) + np.where(values > 0, values, values + (1 << size) - 1)
    codes = np.where(size == 0, 510, codes).astype(np.uint16)
    back = np.zeros(512, np.int16)
    back[codes] = values
    return codes, back


@lru_cache
def _head() -> bytes:
    """A frame's bytes up to its scan."""
    table = _LENGTHS + _SYMBOLS
    return (
        b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x01" * 64 + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", SIDE, SIDE) + b"\x01\x01\x11\x00"
        + b"\xff\xc4" + struct.pack(">H", 4 + 2 * len(table)) + b"\x00" + table + b"\x10" + table + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    )


def _scans(payload: np.ndarray) -> list[bytes]:
    """The scan of each frame of payload."""
    codes, _ = _codes()
    v = payload.reshape(-1, 9, 64).astype(np.int16)
    dc = v[:, :, 0] - 128
    v = np.where(v < 128, v - 128, v - 127)  # never 0: no runs, no end of block
    v[:, 0, 0] = dc[:, 0]
    v[:, 1:, 0] = dc[:, 1:] - dc[:, :-1]
    w = codes[v.reshape(-1, 8) + 255]
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (w[:, j - 1] << (8 - j)) | (w[:, j] >> (j + 1))
    out[:, 8] = w[:, 7]
    flat = out.reshape(-1)
    full = flat == 255
    count = full.reshape(-1, 648).sum(1)
    stuffed = np.zeros(len(flat) + int(count.sum()), np.uint8)
    stuffed[np.arange(len(flat)) + np.cumsum(full) - full] = flat
    ends = np.cumsum(648 + count)
    data = stuffed.tobytes()
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encode(payload: bytes) -> bytes:
    """An AVI file of payload, which must be a positive multiple of FRAME bytes long."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    chunks, index, at, head = [], [], 4, _head()
    for i in range(0, len(payload), FRAME * BLOCK):
        for scan in _scans(np.frombuffer(payload, np.uint8, min(FRAME * BLOCK, len(payload) - i), i)):
            n = len(head) + len(scan) + 2
            index.append(struct.pack("<4sIII", b"00dc", 16, at, n))
            chunks += (struct.pack("<4sI", b"00dc", n), head, scan, b"\xff\xd9", b"\0" * (n & 1))
            at += 8 + n + (n & 1)
    frames = len(index)
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 16, frames, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    chunk = lambda name, data: struct.pack("<4sI", name, len(data)) + data
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    body = b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    if len(body) >= 1 << 32:
        raise ValueError("an AVI file of one RIFF list can't exceed 4 GiB")
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def riff_index(media: bytes) -> tuple[float, np.ndarray]:
    """Frames a second, and offset and size of each video frame by the index (by the chunks if there is none)."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = 0.0, None, None

    def walk(at: int, end: int) -> None:
        nonlocal rate, movi, index
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", media, at)
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = (at + 8, min(end, at + 8 + n))
                else:
                    walk(at + 12, min(end, at + 8 + n))
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids" and not rate:
                scale, per = struct.unpack_from("<II", media, at + 28)
                rate = per / scale if scale else 0.0
            elif name == b"avih" and n >= 4 and not rate:
                (us,) = struct.unpack_from("<I", media, at + 8)
                rate = 0.0 if not us else rate
            elif name == b"idx1":
                index = np.frombuffer(media, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]), n // 16, at + 8)
            at += 8 + n + (n & 1)

    walk(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        kind = index["id"]
        index = index[(kind == b"00dc") | (kind == b"00db")]
        base = movi[0] if not len(index) or index["at"][0] < movi[0] else 0
        return rate or float(RATE), np.stack([index["at"].astype(np.int64) + base + 8, index["n"].astype(np.int64)], 1)
    at, found = movi[0] + 4, []
    while at + 8 <= movi[1]:
        name, n = struct.unpack_from("<4sI", media, at)
        if name in (b"00dc", b"00db"):
            found.append((at + 8, n))
        at += 8 + n + (n & 1)
    return rate or float(RATE), np.array(found, np.int64).reshape(-1, 2)


@lru_cache(64)
def _parse(head: bytes) -> dict:
    """Tables and sizes of a frame's segments up to its scan."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    while at < len(head):
        marker, (n,) = head[at + 1], struct.unpack_from(">H", head, at + 2)
        data = head[at + 4 : at + 2 + n]
        if marker == 0xDB:
            while data:
                wide = data[0] >> 4
                out["quant"][data[0] & 15] = np.frombuffer(data[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                data = data[65 + 64 * wide :]
        elif marker == 0xC4:
            while data:
                total = sum(data[1:17])
                out["huff"][data[0]] = (bytes(data[1:17]), bytes(data[17 : 17 + total]))
                data = data[17 + total :]
        elif marker in (0xC0, 0xC1):
            out["height"], out["width"] = struct.unpack_from(">HH", data, 1)
            out["parts"] = [(data[6 + 3 * i], data[7 + 3 * i] >> 4, data[7 + 3 * i] & 15, data[8 + 3 * i]) for i in range(data[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", data)
        elif marker == 0xDA:
            out["scan"] = [(data[1 + 2 * i], data[2 + 2 * i] >> 4, data[2 + 2 * i] & 15) for i in range(data[0])]
        at += 2 + n
    if "parts" not in out or "scan" not in out:
        raise ValueError("a frame without size or scan")
    out["fixed"] = len(out["parts"]) == 1 and not out["restart"] and all(v == (_LENGTHS, _SYMBOLS) for v in out["huff"].values()) and {0x00, 0x10} <= set(out["huff"]) and out["parts"][0][1:3] == (1, 1) and not (out["height"] % 8 or out["width"] % 8)
    out["huff"] = typical_tables() | out["huff"]
    return out


def _head_size(media: bytes, at: int, end: int) -> int:
    i = at + 2
    while i + 4 <= end and media[i] == 0xFF:
        n = struct.unpack_from(">H", media, i + 2)[0]
        if media[i + 1] == 0xDA:
            return i + 2 + n - at
        i += 2 + n
    raise ValueError("a frame without a scan")


@lru_cache(64)
def _huffman(table: tuple[bytes, bytes]) -> tuple[list[int], list[int]]:
    """Length and symbol of the code that each 16 bits begin with; length 0 where there is none."""
    lengths, symbols, code, k = [0] * 65536, [0] * 65536, 0, 0
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            a, b = code << (16 - length), (code + 1) << (16 - length)
            lengths[a:b], symbols[a:b] = [length] * (b - a), [table[1][k]] * (b - a)
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, symbols


class _Bits:
    """The bits of a scan, taken from the front; only a few bytes are held as a number."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        more = self.data[self.at : self.at + 4]
        self.held = self.held << 32 | int.from_bytes(more + bytes(4 - len(more)), "big")
        self.at += 4
        self.n += 32

    def take(self, n: int) -> int:
        if self.n < n:
            self._fill()
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        if 8 * self.at - self.n > 8 * len(self.data):
            raise ValueError("a frame's scan ends early")
        return out

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.n < 16:
            self._fill()
        code = self.held >> (self.n - 16)
        if not table[0][code]:
            raise ValueError("a code that isn't in the table")
        self.take(table[0][code])
        return table[1][code]

    def value(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _any_frame(head: dict, scan: bytes) -> np.ndarray:
    """Quantised coefficients (blocks, 64 in zigzag order) of the first component, in the order of coding."""
    tables = {k: _huffman(v) for k, v in head["huff"].items()}
    parts = {p[0]: p for p in head["parts"]}
    wide, high = max(p[1] for p in head["parts"]), max(p[2] for p in head["parts"])
    alone = len(head["scan"]) == 1
    units = (-(-head["width"] // 8) * -(-head["height"] // 8)) if alone else (-(-head["width"] // (8 * wide)) * -(-head["height"] // (8 * high)))
    out, done = [], 0
    for run in re.split(rb"\xff[\xd0-\xd7]", scan):
        bits = _Bits(run.replace(b"\xff\x00", b"\xff"))
        last = dict.fromkeys(parts, 0)
        for _ in range(min(head["restart"] or units, units - done)):
            done += 1
            for c, dc, ac in head["scan"]:
                for _ in range(1 if alone else parts[c][1] * parts[c][2]):
                    block = [0] * 64
                    last[c] += bits.value(bits.symbol(tables[dc]))
                    block[0], k = last[c], 1
                    while k < 64:
                        s = bits.symbol(tables[16 + ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15 and k < 64:
                            block[k] = bits.value(s & 15)
                        k += 1
                    if c == head["scan"][0][0]:
                        out.append(block)
    return np.array(out, np.int32)


def frames(media: bytes, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of frames: quantised coefficients and pixels of the first component, (frames, blocks, 64) each."""
    data = np.frombuffer(media, np.uint8)
    for i in range(0, len(index), BLOCK):
        at, n = index[i : i + BLOCK].T
        if (at + n > len(data)).any() or (n < 4).any():
            raise ValueError("the index points outside the file")
        size = _head_size(media, int(at[0]), int(at[0] + n[0]))
        parsed = _parse(media[int(at[0]) : int(at[0]) + size])
        same = bool((n > size + 2).all()) and bool((data[at[:, None] + np.arange(size)] == data[at[0] : at[0] + size]).all())
        if parsed["fixed"] and same:
            n = n - size - 2
            first = np.cumsum(n) - n
            scan = data[np.arange(int(n.sum())) + np.repeat(at + size - first, n)]
            keep = np.ones(len(scan), bool)
            keep[1:] = (scan[1:] != 0) | (scan[:-1] != 255)
            b = scan[keep].reshape(-1, 9).astype(np.uint16)
            w = np.stack([((b[:, j] << (j + 1)) | (b[:, j + 1] >> (7 - j))) & 511 for j in range(8)], 1)
            coefficients = _codes()[1][w].reshape(len(at), -1, 64)
            coefficients[:, :, 0] = np.cumsum(coefficients[:, :, 0], 1, dtype=np.int16)
            yield coefficients, _pixels(coefficients, parsed)
        else:
            for a, m in zip(at.tolist(), n.tolist(), strict=True):
                size = _head_size(media, a, a + m)
                parsed = _parse(media[a : a + size])
                end = media.rfind(b"\xff\xd9", a, a + m)
                coefficients = _any_frame(parsed, media[a + size : end if end >= 0 else a + m])[None]
                yield coefficients, _pixels(coefficients, parsed)


def _pixels(coefficients: np.ndarray, head: dict) -> np.ndarray:
    quant = head["quant"][head["parts"][0][3]]
    flat = (coefficients.reshape(-1, 64) * quant) @ _inverse()
    return np.clip(np.rint(flat) + 128, 0, 255).astype(np.uint8).reshape(coefficients.shape)


def payload_bytes(coefficients: np.ndarray) -> bytes:
    """What the encoder stored in these coefficients."""
    v = coefficients.copy()
    out = np.where(v < 0, v + 128, v + 127)
    out[:, :, 0] = v[:, :, 0] + 128
    return out.astype(np.uint8).tobytes()


def histograms(pixels: np.ndarray) -> np.ndarray:
    """Share of the pixels in each of BINS bins, by frame."""
    n = pixels[0].size
    at = (pixels.reshape(len(pixels), -1) >> 4).astype(np.int64) + BINS * np.arange(len(pixels))[:, None]
    return np.bincount(at.reshape(-1), minlength=BINS * len(pixels)).reshape(-1, BINS) / n


def cuts(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots after the first, and the difference of each frame to the one before.

    A cut is a difference of at least LEAST that exceeds the mean of those within SPAN frames (itself left out)
    by DEVIATIONS standard deviations, and is the largest of them.
    """
    d = np.zeros(len(shares))
    d[1:] = np.abs(shares[1:] - shares[:-1]).sum(1) / 2
    if len(d) < 3:
        return np.flatnonzero(d >= max(LEAST, 0.5)), d
    lo, hi = np.maximum(1, np.arange(len(d)) - SPAN), np.minimum(len(d), np.arange(len(d)) + SPAN + 1)
    s, q = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    n = np.maximum(1, hi - lo - 1)
    mean = (s[hi] - s[lo] - d) / n
    deviation = np.sqrt(np.maximum(0, (q[hi] - q[lo] - d * d) / n - mean * mean))
    padded = np.pad(d, SPAN, constant_values=-1.0)
    top = np.lib.stride_tricks.sliding_window_view(padded, 2 * SPAN + 1).max(1)
    return np.flatnonzero((d >= LEAST) & (d > mean + DEVIATIONS * deviation) & (d >= top)), d


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of FRAME, as AVI.

    A null text is empty; a null key is kept; repeated rows are each coded; an empty table gives none; other
    columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, media, held = [], [], [], 0
            for i, value in enumerate(batch.column(1)):
                data = (value.as_py() or "").encode()
                keys.append(i)
                sizes.append(len(data))
                media.append(encode(data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))))
                held += len(media[-1])
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])
                    keys, sizes, media, held = [], [], [], 0

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


_CLIP = pa.struct([("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("difference", pa.float64())])
_READ = {"frames": "long", "rate": "double", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "histogram": "array<double>", "clips": "array<struct<first_frame:long,n_frames:long,start_s:double,end_s:double,difference:double>>", "error": "string"}


def read_media(media: bytes) -> dict:
    """Figures, payload digests and clips of one AVI file; the payload is streamed, not kept."""
    rate, index = riff_index(media)
    digest, tail, total, shares = hashlib.sha256(), b"", 0, []
    for coefficients, pixels in frames(media, index):
        if coefficients.max(initial=0) <= 128 and coefficients.min(initial=0) >= -128:
            data = payload_bytes(coefficients)
            digest.update(data)
            tail, total = (tail + data)[-32:], total + len(data)
        shares.append(histograms(pixels))
    shares_ = np.concatenate(shares) if shares else np.zeros((0, BINS))
    at, d = cuts(shares_)
    starts = [0, *at.tolist()] if len(shares_) else []
    clips = [{"first_frame": a, "n_frames": b - a, "start_s": a / rate, "end_s": b / rate, "difference": float(d[a])} for a, b in zip(starts, [*starts[1:], len(shares_)], strict=True)]
    return {"frames": len(index), "rate": rate, "payload_bytes": total, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "histogram": (shares_.mean(0) if len(shares_) else np.zeros(BINS)).tolist(), "clips": clips}


def media_rows(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """One row per media value: the columns keep, its figures, and its clips in time order.

    A null or broken value gives no clips and an error; repeated rows are each read; an empty table gives none; a value
    of any size is one row's work, its frames BLOCK at a time; columns that keep doesn't name are left out.
    """
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    floats = pa.list_(pa.float64())
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": floats}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)):
                data = value.as_py()
                row: dict = {"error": "null"} if data is None else {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                if data is not None:
                    try:
                        row |= read_media(data)
                    except (ValueError, struct.error, IndexError, KeyError) as e:
                        row["error"] = str(e) or type(e).__name__
                rows.append({"clips": []} | row)
            made = [pa.array([r.get(c) for r in rows], types.get(t, pa.list_(_CLIP))) for c, t in _READ.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], [*keep, *_READ])

    return df.select(*keep, media).mapInArrow(run, ", ".join([*kinds, *(f"{c} {t}" for c, t in _READ.items())]))


def clip_rows(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per clip of media_rows' result: its number in the file, frames and times.

    Null, broken and empty media have no clips, so no rows; repeated rows each give theirs; an empty table gives none.
    """
    return rows.select(*keep, F.posexplode("clips").alias("clip", "_c")).select(*keep, "clip", "_c.*")
