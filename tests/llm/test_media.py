import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoteloom.llm import media


@pytest.mark.parametrize("kind,channels", [("pgm", 1), ("ppm", 3), ("bmp", 3)])
@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 4)])
def test_round_trip(kind, channels, shape):
    image = np.random.default_rng(1).integers(0, 256, (*shape, channels)).astype(np.uint8)
    assert (media.decode(media.encode(image, kind)) == image).all()


def test_netpbm_kinds():
    assert media.decode(b"P1 # note\n3 2\n1 0 1\n010").tolist() == [[[0], [1], [0]], [[1], [0], [1]]]
    assert media.decode(b"P2\n2 1\n# top\n9\n3 9 ").tolist() == [[[3], [9]]]
    assert media.decode(b"P3 1 2 255 1 2 3 4 5 6").tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    assert media.decode(b"P4 9 1\n\x80\x80").reshape(-1).tolist() == [0, 1, 1, 1, 1, 1, 1, 1, 0]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[[258]]]


def bmp(bits, width, height, palette, body):
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(body), 0, 0, start, 40, width, height, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette + body


def test_bmp_kinds():
    palette = bytes([3, 2, 1, 0, 6, 5, 4, 0])
    for bits, row in ((1, b"\x40\0\0\0"), (4, b"\x01\0\0\0"), (8, b"\0\x01\0\0")):
        assert media.decode(bmp(bits, 2, 1, palette, row)).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode(bmp(32, 1, -2, b"", bytes(range(8)))).tolist() == [[[2, 1, 0]], [[6, 5, 4]]]


@pytest.mark.parametrize("data", [b"", b"P9 1 1 1\n0", b"P5 2 2 255\n\0", b"P5 0 1 255\n", b"P5 a 1 255\n", b"BM", bmp(8, 1, 1, bytes(4), b"\x05\0\0\0"), b"P2 1 1 3 9"])
def test_bad_images(data):
    with pytest.raises(media.BadImage):
        media.decode(data)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 9), st.integers(1, 9))
def test_resize_is_the_exact_mean(h, w, a, b):
    image = np.random.default_rng(h * 13 + w).integers(0, 256, (h, w)).astype(float)
    fine = np.repeat(np.repeat(image, a, 0), b, 1)  # every target cell is h x w of these
    want = fine.reshape(a, h, b, w).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, a, b), want)


def test_query_equals_plain_python(spark):
    texts = ["", None, "x", "é" * 400, "a" * 576, "b" * 577, "c" * 40000, "x"]
    docs = spark.createDataFrame([(None if i == 7 else i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = media.media_features(media.store_media(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = ("x" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(media.text_media(raw)).hexdigest()
        assert np.load(__import__("io").BytesIO(r["tile"])).shape == media.TILE
    assert media.media_features(media.store_media(docs.limit(0))).collect() == []


def plain_media(raw):
    """The stored form, tile and hash of a text's bytes, by loops."""
    rows = max(1, -(-len(raw) // 576))
    data = raw + b"\xff" * (rows * 576 - len(raw))
    if rows % 3 == 0:
        form, width, channels = b"P5\n576 %d\n255\n" % rows + data, 576, 1
    elif rows % 3 == 1:
        form, width, channels = b"P6\n192 %d\n255\n" % rows + data, 192, 3
    else:
        width, channels, body = 192, 3, b""
        for y in reversed(range(rows)):
            line = data[y * 576 : (y + 1) * 576]
            body += b"".join(line[i : i + 3][::-1] for i in range(0, 576, 3))
        form = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, 192, rows, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
    sample = lambda y, x: sum(data[y * 576 + x * channels + k] for k in range(channels)) / channels
    share = lambda lo, hi, i: max(0.0, min(hi, i + 1) - max(lo, i))
    tile = np.zeros((8, 9), np.uint8)
    for r in range(8):
        top, foot = r * rows / 8, (r + 1) * rows / 8
        for c in range(9):
            near, past = c * width / 9, (c + 1) * width / 9
            total = sum(sample(y, x) * share(top, foot, y) * share(near, past, x) for y in range(int(top), min(rows, int(foot) + 1)) for x in range(int(near), min(width, int(past) + 1)))
            tile[r, c] = int(total / ((foot - top) * (past - near)) + 0.5)
    bits = "".join("1" if tile[r, c + 1] > tile[r, c] else "0" for r in range(8) for c in range(8))
    return form, tile, f"{width}x{rows}x{channels}:{int(bits, 2):016x}"


def test_tile_and_hash_equal_plain_python(spark):
    rng = np.random.default_rng(4)
    texts = ["", "plain words " * 60, "ab" * 700, "z" * 2500, "".join(chr(c) for c in rng.integers(33, 126, 1201)), "é" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(media.store_media(docs)).collect():
        form, tile, feature = plain_media(texts[r["doc_id"]].encode())
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
        got = np.load(__import__("io").BytesIO(r["tile"]))
        assert got.dtype == np.uint8 and np.abs(got.astype(int) - tile).max() <= 1  # sums in another order may round elsewhere
        if (got == tile).all():
            assert r["feature"] == feature


def test_query_keeps_the_tiles(spark):
    from quoteloom.llm import queries

    found = queries.op7_media_columns(spark, "/root/testdata/sf0.001")
    assert "tile" in found.columns and found.where("tile is null").count() == 0
