"""Pixel kernels on made images."""

import struct
import zlib

import numpy as np
import pytest

from framelake.sources import features, kernels


def png(img):
    h, w, _ = img.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img[..., ::-1].reshape(h, 3 * w)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).integers(0, 256, (120, 160, 3), np.uint8)


def test_kernels(noise):
    flat = np.full((64, 64, 3), 127, np.uint8)
    assert kernels.sharpness(flat)[0] == 0 and kernels.exposure(flat)[0] == 1.0
    assert kernels.exposure(np.zeros((8, 8, 3), np.uint8))[0] == 0
    blurred = np.stack([kernels.resize_mean(noise[..., i].astype(float), 5) for i in range(3)], -1)
    assert kernels.sharpness(noise)[0] > 10 * kernels.sharpness(blurred)[0]
    assert kernels.region_sharpness(noise, -5, -5, 3, 3) == 0 and kernels.region_sharpness(noise, 10, 10, 30, 30) > 0
    near = (noise * 0.98).astype(np.uint8)
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert bits(kernels.phash(noise), kernels.phash(near)) <= 10 < bits(kernels.phash(noise), kernels.phash(noise[::-1]))
    hist = np.array(kernels.hsv_histogram(noise))
    assert len(hist) == 692 and np.allclose([hist[:180].sum(), hist[180:436].sum(), hist[436:].sum()], 1)
    assert sum(kernels.hsv_histogram(flat)) == 0  # an empty mask
    d = kernels.descriptors(noise)
    assert len(d) == 256 and all(len(x) == 32 for x in d) and kernels.descriptors(flat) == []
    assert kernels.resize(np.arange(8.0).reshape(1, 8), 1, 4).tolist() == [[0.5, 2.5, 4.5, 6.5]]


def test_hue_of_plain_colours():
    blue, green, red = ([255, 0, 0], [0, 255, 0], [0, 0, 255])
    assert kernels.hsv(np.array([[blue, green, red]], np.uint8))[0].tolist() == [[120, 255, 255], [60, 255, 255], [0, 255, 255]]


def test_focus_mask(noise):
    img = np.full((200, 300, 3), 120, np.uint8)
    img[50:150, 100:200] = noise[:100, :100]
    mask = kernels.focus_mask(img)
    assert mask[60:140, 110:190].mean() > 0.9 and mask[:30].mean() < 0.1
    assert kernels.mask_png(mask).startswith(b"\x89PNG")


def test_embedded_jpeg():
    a, b = b"\xff\xd8" + b"x" * 10 + b"\xff\xd9", b"\xff\xd8" + b"y" * 30 + b"\xff\xd9"
    assert kernels.embedded_jpeg(b"raw" + a + b"--" + b + b"\xff\xd8 open") == b and kernels.embedded_jpeg(b"none") == b"none"


def tiff(order="<"):
    entry = lambda tag, kind, n, value: struct.pack(order + "HHI", tag, kind, n) + value
    long = lambda x: struct.pack(order + "I", x)
    exif = [entry(0x829D, 5, 1, long(200)), entry(0x8827, 3, 1, struct.pack(order + "HH", 1600, 0)), entry(0x9003, 2, 20, long(220))]
    body = (b"II*\0" if order == "<" else b"MM\0*") + long(8) + struct.pack(order + "H", 1) + entry(0x8769, 4, 1, long(60)) + long(0)
    body = body.ljust(60, b"\0") + struct.pack(order + "H", 3) + b"".join(exif) + long(0)
    return body.ljust(200, b"\0") + struct.pack(order + "II", 14, 5) + b"\0" * 12 + b"2026:03:19 12:34:56\0"


def test_exif(spark):
    for order in "<>":
        assert kernels.exif(b"\xff\xd8\xff\xe1xxExif\0\0" + tiff(order)) == {"f_number": "14/5", "shutter": None, "iso": "1600", "time": "2026:03:19 12:34:56"}
    assert set(kernels.exif(b"nothing").values()) == {None}
    rows = spark.createDataFrame([("a", bytearray(tiff())), ("b", bytearray(b"x"))], "key string, content binary")
    got = {x.key: (x.f_number, x.iso, str(x.captured_at)) for x in features.exif_of(rows).collect()}
    assert got == {"a": ("2.8", "1600", "2026-03-19 12:34:56"), "b": (None, None, "None")}


def test_feature_rows(spark, tmp_path, noise):
    (tmp_path / "a.png").write_bytes(png(noise))
    (tmp_path / "b.png").write_bytes(b"broken")
    got = features.extract(features.images(spark, str(tmp_path))).collect()
    assert len(got) == 1 and got[0].key.endswith("a.png") and got[0].phash_hex == kernels.phash(noise)
    assert got[0].sharpness == pytest.approx(kernels.sharpness(noise)[0]) and len(got[0].hsv_histogram) == 692 and len(got[0].grid_sharps) == 16
    masks = features.focus_masks(features.images(spark, str(tmp_path))).collect()
    assert len(masks) == 1 and bytes(masks[0].mask_png).startswith(b"\x89PNG")
