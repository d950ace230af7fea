"""Operator 7: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form, and difference hashes.

Decoders read the Netpbm kinds P1 to P6 (8-bit) and uncompressed BMP of 1, 8, 24 and 32 bits. Resizing takes the mean of
each target pixel's area by an integral image, with exact whole numbers. A tile is the resized grey image as an NPY
file's bytes; the difference hash compares each pixel of a 9 x 8 area-resized grey image with its right neighbour.

Bytes are stored as images of 64 grey samples a row: PGM where the number of rows is even, BMP where it is odd.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal values; repeated rows repeat their
result; a null doc_id is carried; an image that can't be decoded gives null values in ``decode_images``; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, text_bytes

ROW = 64
TILE = 16
_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit BMP with a grey palette; rows from the bottom, padded to 4 bytes."""
    height, width = samples.shape
    palette = np.repeat(np.arange(256, dtype="<u4") * 0x010101, 1).astype("<u4").tobytes()
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    start = 14 + 40 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with samples of up to 8 bits -> height x width, or height x width x 3."""
    kind = int(data[1:2])
    at, fields = 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _FIELD.match(data, at)
        if found is None:
            raise ValueError("bad Netpbm header")
        fields.append(int(found[1]))
        at = found.end()
    width, height = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    depth = 3 if kind in (3, 6) else 1
    count = width * height * depth
    if not 0 < top < 256 or not count:
        raise ValueError("bad Netpbm size or depth")
    if kind <= 3:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        numbers = list(body.translate(None, b" \t\n\r\v\f")) if kind == 1 else [int(x) for x in body.split()]
        values = np.array(numbers[:count], np.int64) - (48 if kind == 1 else 0)
    elif kind == 4:
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        values = bits[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8, count, at + 1)
    if len(values) != count or ((kind <= 3 or top < 255) and values.max() > top):
        raise ValueError("bad Netpbm samples")
    if kind in (1, 4):
        values = (1 - values) * 255
    elif top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    values = values.astype(np.uint8, copy=False)
    return values.reshape(height, width, 3) if depth == 3 else values.reshape(height, width)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP -> height x width for grey palettes, else height x width x 3 (red, green, blue)."""
    start, size, width, height, _, bits, packing = struct.unpack_from("<4xIIiiHHI", data, 6)
    if packing not in (0,) or bits not in (1, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    places = np.unpackbits(rows, axis=1)[:, :width] if bits == 1 else rows[:, :width]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    if places.size and int(places.max()) >= used:
        raise ValueError("bad BMP palette")
    colours = palette[places]
    return np.ascontiguousarray(colours[:, :, 0]) if (palette[:, :1] == palette).all() else colours


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_netpbm(data)
    raise ValueError("no Netpbm or BMP image")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else ((image.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(axis=2) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area, rounded down; source pixels that it cuts count by their share.

    The integral over a fraction of a row or column lies on the line between its neighbours in the integral image, so
    with ``height * width`` times the scale all values are whole numbers.
    """
    rows, columns = image.shape
    total = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(parts + 1, dtype=np.int64) * n
        return place // parts, place % parts

    y, y_part = edges(rows, height)
    x, x_part = edges(columns, width)
    down = total[y] * height + (total[np.minimum(y + 1, rows)] - total[y]) * y_part[:, None]
    at = down[:, x] * width + (down[:, np.minimum(x + 1, columns)] - down[:, x]) * x_part[None, :]
    area = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return (area // (rows * columns)).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    small = area_resize(image, 8, 9).astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, area_resize(image, size, size), allow_pickle=False)
    return out.getvalue()


def store(data: bytes) -> bytes:
    """Bytes, padded with zeros to a positive multiple of ``ROW``, as an image file's bytes."""
    padded = data + bytes(-len(data) % ROW if data else ROW)
    samples = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    return encode_bmp(samples) if len(samples) % 2 else encode_pgm(samples)


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_py() or b""
            media = store(data)
            image = decode(media)
            payload = image.tobytes()
            rows.append((doc_id, len(data), len(payload), sha(payload), zlib.crc32(payload[-ROW:]), len(media), sha(media), difference_hash(image), sha(npy_tile(image))))
        yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names=names)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(x.as_py() or b"") for x in batch.column(1)], pa.binary())], names=["doc_id", "media"])


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(1):
                try:
                    image = decode(media.as_py() or b"")
                    plain = grey(image)
                    rows.append((image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, npy_tile(plain, size), difference_hash(plain)))
                except (ValueError, struct.error):
                    rows.append((None,) * 5)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "width", "height", "channels", "tile_npy", "difference_hash"])

    return run


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> ``(doc_id, media)``: each text's bytes as an image file."""
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")), _stored, "doc_id long, media binary")


def decode_images(media: DataFrame, size: int = TILE) -> DataFrame:
    """``media(doc_id, media)`` -> size, channels, NPY tile and difference hash of each image."""
    return map_arrow(media.select("doc_id", "media"), _features(size), "doc_id long, width int, height int, channels int, tile_npy binary, difference_hash string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' bytes stored as images, read back, with their features."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_arrow(docs, _digests, _DIGESTS)


QUERIES = {"op7_media": op7_media}
ORACLES: dict[str, str] = {}
