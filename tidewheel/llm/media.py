"""Payloads as PNG images in a binary column, and hashes of what is read back.

A payload is padded with bytes 255 to a positive multiple of 576 and becomes
an 8-bit grey image of WIDTH columns. The PNG is written chunk by chunk (IHDR,
IDAT through zlib, IEND, each with its CRC) and read back with every checksum
tested; rows are unfiltered in numpy, whole runs of rows of one filter at
once. The feature is a hash of low frequencies: the image is brought to 32 x
32, transformed by cosines, and each of the 8 x 8 lowest coefficients gives a
bit, set if it is over their median.

Cases: null and empty texts give one block of padding; equal texts give equal
values; repeated rows and null ids are kept; very long texts make tall images;
damaged images raise ValueError in decode and are flagged by try_decode; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewheel.llm.common import keep_nothing, text_of, written

UNIT = 576
WIDTH = 96
LEVEL = 5
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
_k = np.arange(LOW)[:, None]
COSINES = np.cos(np.pi * _k * (2 * np.arange(SIDE)[None] + 1) / (2 * SIDE))


def pad(payload: bytes) -> bytes:
    return payload + b"\xff" * (max(1, -(-len(payload) // UNIT)) * UNIT - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(samples: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG of whole rows; of the filters none, left and up, the one of least absolute sum."""
    image = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    left, up = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    choices = [image, left, up]
    kind = int(np.argmin([np.abs(c.view(np.int8).astype(np.int16)).sum() for c in choices]))
    rows = np.empty((len(image), width + 1), dtype=np.uint8)
    rows[:, 0], rows[:, 1:] = kind, choices[kind]
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray, step: int = 1) -> np.ndarray:
    """Undo PNG filters: rows hold a filter type and then bytes; step is the bytes of a pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("an unknown filter")
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
        kind, part = int(kinds[low]), out[low:high]
        above = out[low - 1] if low else np.zeros(out.shape[1], dtype=np.uint8)
        if kind == 1:
            for c in range(step):
                np.cumsum(part[:, c::step], axis=1, dtype=np.uint8, out=part[:, c::step])
        elif kind == 2:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind >= 3:
            for row in part:
                _sequential(row, above, step, paeth=kind == 4)
                above = row
    return out


def _sequential(row: np.ndarray, above: np.ndarray, step: int, paeth: bool) -> None:
    """Average and Paeth rows: each pixel needs the one before it."""
    for at in range(0, len(row), step):
        now = slice(at, at + step)
        b = above[now].astype(np.int16)
        a = row[at - step : at].astype(np.int16) if at else np.zeros_like(b)
        if paeth:
            c = above[at - step : at].astype(np.int16) if at else np.zeros_like(b)
            pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
            guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        else:
            guess = (a + b) // 2
        row[now] = (row[now] + guess) & 255


def decode(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, grey-alpha, RGB or RGBA PNG as rows x bytes; ValueError where it is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None:
        raise ValueError("the image is cut short")
    width, height, depth, colour, _, _, interlace = head
    step = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or not step or interlace:
        raise ValueError("this kind of image is not supported")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as problem:
        raise ValueError("the image data are damaged") from problem
    if len(raw) != height * (width * step + 1):
        raise ValueError("the image data have another size")
    return unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(height, width * step + 1), step)


def try_decode(media: bytes) -> np.ndarray | None:
    try:
        return decode(media)
    except ValueError:
        return None


def _resize(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n < SIDE:
        return np.take(image, np.arange(SIDE) * n // SIDE, axis=axis)
    edges = np.arange(SIDE + 1) * n // SIDE
    sums = np.add.reduceat(image, edges[:-1], axis=axis, dtype=np.int64)
    sizes = np.diff(edges)
    return sums / (sizes[:, None] if axis == 0 else sizes[None, :])


def cosine_hash(image: np.ndarray) -> str:
    small = _resize(_resize(image, 0), 1)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    bits = low[1:] > np.median(low[1:])
    return f"{int.from_bytes(np.packbits(np.append(False, bits)).tobytes(), 'big'):016x}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_nothing()
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            texts = part.column(1).to_pylist()
            images = pa.array([encode(pad(t)) for t in texts], type=pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], type=pa.int64()), images], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the PNG as binary column media."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for media in batch.column(2).to_pylist():
            image = decode(media)
            payload = image.tobytes()
            row = (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-32:]),
                len(media),
                hashlib.sha256(media).hexdigest(),
                cosine_hash(image),
            )
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        names = [f.split()[0] for f in FEATURES.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names)


def features(media: DataFrame) -> DataFrame:
    """Per stored image what is read back: sizes, digests and the cosine hash."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Write the images as a table in the shared folder and compute features of the bytes read from it."""
    return features(written(to_media(docs), "media"))
