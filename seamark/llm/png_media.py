"""Binary columns of lossless images, and their perceptual hashes.

A payload of bytes becomes a greyscale PNG, 64 samples wide: a filter byte before each row, zlib in IDAT chunks, a CRC on every
chunk. Each row takes the filter of the five that leaves the least sum of absolute differences (ties: the first). Reading checks
signature, chunk CRCs, zlib's Adler sum and the size, and undoes the filters with numpy, for many images at once: a sample needs
those to its left, above and above left, so all samples on one diagonal of all images are made in one step. The hash is a
low-frequency cosine transform: the image is averaged to 32 x 32, the 8 x 8 lowest frequencies are compared with their median,
giving 8 bytes in a binary column.

Defined results: a null or empty text is one row of zero samples; equal texts give equal bytes and hashes; null doc_ids and
repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches

WIDTH, LEVEL, CHUNK = 64, 6, 1 << 16
#: Samples whose filters are undone at once (an image with more goes alone).
AT_ONCE = 1 << 19
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of `unit`."""
    return raw + bytes(unit * max(1, -(-len(raw) // unit)) - len(raw))


def _guess(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the format's filter `kind` expects of a sample, from 16-bit neighbours."""
    if kind == 0:
        return np.zeros_like(left)
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) >> 1
    by_left, by_up = np.abs(up - corner), np.abs(left - corner)
    by_corner = np.abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def filtered(rows: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Rows with the filter's number before them; without `kind` the filter that leaves the least, row by row."""
    h, w = rows.shape
    wide = np.zeros((h + 1, w + 1), np.int16)
    wide[1:, 1:] = rows
    left, up, corner, now = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1], wide[1:, 1:]
    out = np.empty((h, w + 1), np.uint8)
    if kind is not None:
        out[:, 0], out[:, 1:] = kind, (now - _guess(kind, left, up, corner)).astype(np.uint8)
        return out
    every = np.stack([(now - _guess(k, left, up, corner)).astype(np.uint8) for k in range(5)])
    best = np.abs(every.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
    out[:, 0], out[:, 1:] = best, every[best, np.arange(h)]
    return out


def encode_png(payload: bytes, width: int = WIDTH, row_filter: int | None = None, level: int = LEVEL) -> bytes:
    """`row_filter`: one for all rows; else each row has its own."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packed = zlib.compress(filtered(rows, row_filter).tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing, as rows. ValueError if anything is damaged."""
    return unfilter([read_lines(data)])[0]


def decode_many(images: list[bytes]) -> Iterator[np.ndarray]:
    """The samples of each image, AT_ONCE samples at a time."""
    part: list[np.ndarray] = []
    held = 0
    for data in images:
        lines = read_lines(data)
        if part and (held + lines.size > AT_ONCE or lines.shape[1] != part[0].shape[1]):
            yield from unfilter(part)
            part, held = [], 0
        part.append(lines)
        held += lines.size
    if part:
        yield from unfilter(part)


def read_lines(data: bytes) -> np.ndarray:
    """The rows of an image as they are stored, each with its filter's number before it."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not header or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("image data of another size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if (lines[:, 0] > 4).any():
        raise ValueError("unknown row filter")
    return lines


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of images of one width: diagonal by diagonal, of all images in one step."""
    heights = np.array([len(x) for x in images])
    w, lines = images[0].shape[1] - 1, np.concatenate(images)
    if not lines[:, 0].any():
        return np.split(lines[:, 1:], np.cumsum(heights)[:-1])
    # Each image has a row of zeros above it and all rows one zero before them, so every sample has its three neighbours.
    first = np.cumsum(heights) - heights
    inside = np.arange(len(lines)) - np.repeat(first, heights)
    place = np.arange(len(lines)) + np.repeat(np.arange(len(images)) + 1, heights)
    out = np.zeros((len(lines) + len(images), w + 1), np.int16)
    flat = out.ravel()
    step = (inside[:, None] + np.arange(w)).ravel()
    order = np.argsort(step, kind="stable")
    ends = np.cumsum(np.bincount(step))
    at = (place[:, None] * (w + 1) + 1 + np.arange(w)).ravel()[order]
    kinds, raw = np.repeat(lines[:, 0], w)[order], lines[:, 1:].ravel()[order].astype(np.int16)
    used = np.flatnonzero(np.bincount(kinds, minlength=5)).tolist()
    begin = 0
    for end in ends.tolist():
        here, kind = at[begin:end], kinds[begin:end]
        left, up, corner = flat[here - 1], flat[here - w - 1], flat[here - w - 2]
        guess = _guess(used[0], left, up, corner)
        for k in used[1:]:
            guess = np.where(kind == k, _guess(k, left, up, corner), guess)
        flat[here] = (raw[begin:end] + guess) & 255
        begin = end
    return np.split(out[place, 1:].astype(np.uint8), np.cumsum(heights)[:-1])


_BASIS = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def dct_hash(rows: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies are above their median (the mean, frequency 0, isn't in the median)."""
    h, w = rows.shape
    small = _averaged(_averaged(rows.astype(np.float64)).T).T
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _averaged(x: np.ndarray) -> np.ndarray:
    """SIDE rows from any number of rows."""
    n = len(x)
    at = np.arange(SIDE) * n // SIDE
    if n < SIDE:
        return x[at]
    return np.add.reduceat(x, at, axis=0) / np.diff(np.append(at, n))[:, None]


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [(t or "").encode() for t in b.column("text").to_pylist()]
        media = pa.array([encode_png(pad(x)) for x in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("hash", pa.binary())])
    for b in batches:
        rows = []
        media = b.column("media").to_pylist()
        for data, samples in zip(media, decode_many(media), strict=True):
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), dct_hash(samples)))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *schema.names])


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the text's UTF-8, padded, as a PNG in a binary column."""
    small_batches(docs.sparkSession, 128)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode_batches, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_feature_batches, FEATURES)


def op3_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(media_table(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "uncompressed")
    return media_features(stored).withColumn("feature", F.lower(F.hex("hash"))).drop("hash")
