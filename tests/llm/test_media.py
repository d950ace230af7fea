import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tarnflow.llm import media


def test_registered_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = media.op7_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id]
        payload = data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))
        stored = media.store(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert len(r.feature) == 16


def slow_resize(image, height, width):
    rows, columns = image.shape
    out = np.zeros((height, width), np.uint8)
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = Fraction(i * rows, height), Fraction((i + 1) * rows, height), Fraction(j * columns, width), Fraction((j + 1) * columns, width)
            total = Fraction(0)
            for y in range(int(y0), min(rows, int(y1) + 1)):
                for x in range(int(x0), min(columns, int(x1) + 1)):
                    share = max(Fraction(0), min(y1, y + 1) - max(y0, y)) * max(Fraction(0), min(x1, x + 1) - max(x0, x))
                    total += share * int(image[y, x])
            out[i, j] = int(total / ((y1 - y0) * (x1 - x0)))
    return out


@pytest.mark.parametrize("shape", [(1, 64), (2, 64), (7, 5), (20, 33), (8, 9)])
def test_area_resize_is_exact(shape):
    image = np.random.default_rng(2).integers(0, 256, shape, dtype=np.uint8)
    assert (media.area_resize(image, 8, 9) == slow_resize(image, 8, 9)).all()
    tile = np.load(io.BytesIO(media.npy_tile(image, 4)))
    assert (tile == slow_resize(image, 4, 4)).all()


def test_round_trips():
    rng = np.random.default_rng(1)
    for shape in [(1, 1), (3, 5), (4, 64), (9, 7)]:
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_pgm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == image).all()
    for n in (0, 1, 63, 64, 65, 128, 1000):
        data = bytes(rng.integers(0, 256, n, dtype=np.uint8))
        assert media.decode(media.store(data)).tobytes() == data + bytes(64 * max(1, -(-n // 64)) - n)


def test_other_kinds():
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1 15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n9 1\n\x80\x00").tolist() == [[0] + [255] * 8]
    assert media.decode(b"P6\n#x\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    rgb = head + (1).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24) + b"\x03\x02\x01\x00"
    assert media.decode(rgb).tolist() == [[[1, 2, 3]]]


def test_edge_rows(spark):
    rows = [(1, None, b""), (2, "", b""), (3, "x" * 300_000, b""), (None, "a", b""), (4, "a", b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    images = media.store_texts(docs)
    got = {r.doc_id: r for r in media.decode_images(images).collect()}
    assert got[1].tile_npy == got[2].tile_npy
    assert got[None].difference_hash == got[4].difference_hash
    assert (got[3].width, got[3].height) == (64, 4688)
    broken = spark.createDataFrame([(1, b"P5\n9 9\n255\nxx"), (2, None), (3, b"GIF"), (4, b"BM")], "doc_id long, media binary")
    assert [r.width for r in media.decode_images(broken).collect()] == [None] * 4
    assert media.decode_images(images.limit(0)).collect() == []


def test_samples_above_the_greatest_value_are_no_image():
    for data in (b"P5 2 1 100\n\xc8\x01", b"P2 2 1 100\n200 1", b"P6 1 1 9\n\x01\x02\x0a"):
        with pytest.raises(ValueError, match="bad Netpbm samples"):
            media.decode(data)
    assert media.decode(b"P5 2 1 100\n\x64\x00").tolist() == [[255, 0]]
