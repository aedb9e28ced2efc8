import struct
import zlib

import numpy as np
import pytest

from twinsift.functions import fingerprints as P
from twinsift.sources.readers import read_images


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


NOISE = np.random.default_rng(1).integers(0, 256, (256, 256, 3)).astype(float)
RAMP = np.repeat(np.arange(256)[None, ::-1, None], 256, 0).repeat(3, 2).astype(float)


def test_solid_and_ramp():
    assert P.dhash(np.full((256, 256, 3), 90.0), 8) == bytes(8)
    assert P.edge_histogram(np.full((256, 256, 3), 90.0)) == [0] * 14
    assert P.dhash(RAMP, 12) == b"\xff" * 18
    assert P.dhash(RAMP[:, ::-1], 12) == bytes(18)


def test_histograms_add_up():
    h = P.colour_histogram(NOISE)
    assert len(h) == 32 and all(abs(sum(h[k : k + 8]) - 255) <= 4 for k in range(0, 32, 8))
    assert len(P.edge_histogram(NOISE)) == 14


def test_phash_is_63_bits_and_ignores_brightness():
    a, b = P.phash(NOISE), P.phash(NOISE + 20)
    assert len(a) == 8 and a[7] & 1 == 0 and a == b


def test_dct_matches_definition():
    v = np.random.default_rng(2).random(32)
    want = [sum(v[n] * np.cos(np.pi * (2 * n + 1) * k / 64) for n in range(32)) for k in range(32)]
    assert np.allclose(P.cosines() @ v, want)


def test_crops_have_names():
    assert [n for n, _ in P.crop_hashes(NOISE)] == ["center60", "center80", "tl", "tr", "bl", "br"]
    assert P.crop_hashes(NOISE[:4, :4]) == []


def test_variants_of_a_flip_match_the_original():
    smooth = P.resize(NOISE[:24:4, :24:4], 256, 256)
    f = P.fingerprint(smooth, True, True, False, False, False)
    g = P.fingerprint(smooth[:, ::-1], False, False, False, False, False)
    d = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert min(d(v["d8"], g["d8"]) for v in f["variants"]) <= 8


def test_reader_and_errors(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(NOISE))
    (tmp_path / "b.png").write_bytes(png(RAMP))
    (tmp_path / "broken.png").write_bytes(png(NOISE)[:200])
    images = read_images(spark, str(tmp_path))
    rows = {r["id"].split("/")[-1]: r for r in P.fingerprint_images(images, crops=True, colour=True, freq=True).collect()}
    assert set(rows) == {"a.png", "b.png", "broken.png"}
    assert rows["broken.png"]["d12"] is None and rows["broken.png"]["error"]
    assert rows["b.png"]["d12"] == (-1, -1, 65535) and rows["a.png"]["error"] is None
    bad = spark.sql("SELECT 'x' AS id, named_struct('origin', '', 'height', 2, 'width', 2, 'nChannels', 3, 'mode', 16, 'data', X'00') AS image")
    row = P.fingerprint_images(bad).first()
    assert row["d12"] is None and "size" in row["error"]


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_resize_keeps_constant(share):
    assert np.allclose(P.resize(np.full((10, 20), 7.0), int(20 * share), 5), 7.0)
