"""Media columns: texts as 8-bit grey PNG images in binary columns.

``store`` writes each payload as a PNG (signature, IHDR, IDAT chunks of zlib
data, IEND) with filtered rows. ``load`` reads a PNG back: it walks the chunks,
tests every checksum, inflates and undoes the row filters with numpy. From the
loaded image come a 64-bit hash of low cosine-transform frequencies and the
digests. It is a map over Arrow batches; nothing shuffles.

Edge cases: null and empty texts are one row of 64 zero bytes; equal texts give
equal values, so repeated rows do; an empty table gives no rows; other columns
are ignored; very long texts are tall images, one at a time in memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import slices, text_of

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media binary, hash binary, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """Zero bytes appended up to a positive multiple of ``width``."""
    return data + bytes(-len(data) % width if data else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(image: np.ndarray, level: int = 4, chunk: int = 1 << 16, filters: np.ndarray | None = None) -> bytes:
    """An 8-bit grey PNG. ``filters``: the filter type of each row, 0 (none) or
    2 (up); by default one type for all rows, whichever deflates better."""
    height, width = image.shape
    if filters is None:
        return min((encode_png(image, level, chunk, np.full(height, kind, dtype=np.uint8)) for kind in (0, 2)), key=len)
    up = image.copy()
    up[1:] -= image[:-1]
    rows = np.empty((height, width + 1), dtype=np.uint8)
    rows[:, 0] = filters
    rows[:, 1:] = np.where(filters[:, None] == 2, up, image)
    data = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + chunk]) for i in range(0, len(data), chunk)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Undo PNG row filters of one-byte pixels. Runs of rows with one of the types
    none, sub and up are undone at once; average and paeth go pixel by pixel."""
    out = rows.copy()
    bounds = [0, *(np.flatnonzero(np.diff(filters)) + 1).tolist(), len(filters)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        kind = filters[a] if b > a else 0
        if kind == 1:
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(int) if y else np.zeros(out.shape[1], dtype=int)
                left = corner = 0
                for x, value in enumerate(rows[y].tolist()):
                    if kind == 3:
                        guess = (left + int(above[x])) // 2
                    else:
                        p = left + int(above[x]) - corner
                        guess = min((left, int(above[x]), corner), key=lambda v, p=p: abs(p - v))
                    corner, left = int(above[x]), (value + guess) & 255
                    out[y, x] = left
        elif kind:
            raise ValueError(f"unknown PNG filter {kind}")
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The image of an 8-bit grey PNG; ValueError where anything is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, data, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(media):
            raise ValueError("PNG ends early")
        (length,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + length]
        if len(body) < length or struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only plain 8-bit grey is read")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if raw.size != size[1] * (size[0] + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(size[1], size[0] + 1)
    return _unfilter(raw[:, 1:], raw[:, 0])


@lru_cache(maxsize=4)
def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(k), np.arange(n) + 0.5))


def dct_hash(image: np.ndarray, side: int = 32, low: int = 8) -> bytes:
    """``low * low`` bits: which low cosine frequencies of the image, averaged to
    ``side`` by ``side`` boxes, exceed their median (the constant one left out)."""
    y = np.linspace(0, image.shape[0], side + 1).astype(int)
    x = np.linspace(0, image.shape[1], side + 1).astype(int)
    y1, x1 = np.maximum(y[1:], y[:-1] + 1), np.maximum(x[1:], x[:-1] + 1)  # a box has a pixel at least
    y0, x0 = np.minimum(y[:-1], image.shape[0] - 1), np.minimum(x[:-1], image.shape[1] - 1)
    y1, x1 = np.minimum(y1, image.shape[0]), np.minimum(x1, image.shape[1])
    y0, x0 = np.minimum(y0, y1 - 1), np.minimum(x0, x1 - 1)
    # Rows are summed first, so what is held beside the image is ``side`` rows. In
    # an image of fewer rows than boxes every box is one row high.
    rows = np.add.reduceat(image, y0, axis=0, dtype=np.int64) if image.shape[0] >= side else image[y0].astype(np.int64)
    sums = np.concatenate([np.zeros((side, 1), dtype=np.int64), np.cumsum(rows, axis=1)], axis=1)
    boxes = (sums[:, x1] - sums[:, x0]) / np.outer(y1 - y0, x1 - x0)
    c = _cosines(side, low)
    freq = np.round(c @ boxes @ c.T, 6).ravel()
    return np.packbits(freq > np.median(freq[1:])).tobytes()


def media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document the stored image (``media``), the hash of what is read back
    (``hash`` and, in hex, ``feature``) and digests of payload and stored form."""

    def one(doc: int | None, text: str) -> tuple:
        raw = text.encode()
        stored = encode_png(np.frombuffer(pad(raw, width), dtype=np.uint8).reshape(-1, width))
        image = decode_png(stored)
        back = image.tobytes()
        found = dct_hash(image)
        return doc, len(raw), stored, found, found.hex(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in slices(batches):
            rows = [one(doc, text) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(task, SCHEMA)
