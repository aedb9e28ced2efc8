"""Fingerprints: SQL expressions over vectors, and one Arrow UDF over images.

Images come as gray or colour rows of Spark's image source (blue first) and are
resized by the bilinear rule of :func:`resize`, which is fixed here so that
hashes do not depend on a decoder. A row that cannot be hashed gets an error
text and null fingerprints; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- vectors --------------------------------------------------------------------------------------------------


def gradient_hash(vector: Column, size: int = 64) -> Column:
    """size - 1 bits: whether each value exceeds the next, first in the highest bit."""
    bits = F.sequence(F.lit(0), F.lit(size - 2))
    step = lambda a, i: F.call_function("shiftleft", a, F.lit(1)).bitwiseOR((F.get(vector, i) > F.get(vector, i + 1)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), step)


def flip_h(vector: Column, width: int = 8) -> Column:
    """A row-major grid mirrored left to right."""
    return F.transform(F.sequence(F.lit(0), F.size(vector) - 1), lambda i: F.get(vector, (F.floor(i / width) * width + width - 1 - i % width).cast("int")))


def flip_v(vector: Column, width: int = 8) -> Column:
    """A row-major grid mirrored top to bottom."""
    rows = F.floor(F.size(vector) / width)
    return F.transform(F.sequence(F.lit(0), F.size(vector) - 1), lambda i: F.get(vector, ((rows - 1 - F.floor(i / width)) * width + i % width).cast("int")))


def value_histogram(vector: Column, low: float = -1.0, high: float = 1.0, bins: int = 8) -> Column:
    """Counts of values in equal bins, scaled to bytes; outer values go to the end bins."""
    width = (high - low) / bins
    at = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x.cast("double") - low) / width).cast("int")))
    found = F.transform(vector, at)
    count = lambda b: F.size(F.filter(found, lambda x: x == b))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.floor(count(b) * 255 / F.size(vector) + 0.5).cast("int"))


def hash_bytes(h: Column) -> list[Column]:
    """The eight bytes of a long, first the highest."""
    return [F.call_function("shiftrightunsigned", h, F.lit(8 * (7 - k))).bitwiseAND(255) for k in range(8)]


def hash_bytes144(h: Column) -> list[Column]:
    """The eighteen bytes of a struct (w0, w1, w2)."""
    tail = h["w2"].cast("long")
    return [*hash_bytes(h["w0"]), *hash_bytes(h["w1"]), F.call_function("shiftrightunsigned", tail, F.lit(8)).bitwiseAND(255), tail.bitwiseAND(255)]


# --- images ---------------------------------------------------------------------------------------------------

WORK = 256
#: Luma weights; crop boxes by name as (x, y, share) of the side.
LUMA = (0.299, 0.587, 0.114)
CROPS = (("center60", 0.2, 0.2, 0.6), ("center80", 0.1, 0.1, 0.8), ("tl", 0.0, 0.0, 0.6), ("tr", 0.4, 0.0, 0.6), ("bl", 0.0, 0.4, 0.6), ("br", 0.4, 0.4, 0.6))
#: Fixed values of the edge histogram.
EDGE_LEAST, EDGE_TOP, DIRECTIONS, STRENGTHS = 30.0, 200.0, 6, 4


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with ratio (source - 1) / target."""
    h, w = img.shape[:2]
    y, x = np.arange(height) * ((h - 1) / height), np.arange(width) * ((w - 1) / width)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    if img.ndim == 3:
        fy, fx = fy[:, None, None], fx[None, :, None]
    else:
        fy, fx = fy[:, None], fx[None, :]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else rgb @ np.array(LUMA)


def dhash(img: np.ndarray, n: int) -> bytes:
    """n * n bits: whether a pixel exceeds its right neighbour, packed high bit first."""
    g = gray(resize(img, n + 1, n))
    return np.packbits(g[:, :-1] > g[:, 1:]).tobytes()


def crop_hashes(img: np.ndarray, n: int = 12) -> list[tuple[str, bytes]]:
    h, w = img.shape[:2]
    out = []
    for name, x, y, share in CROPS:
        cw, ch = int(np.floor(w * share + 0.5)), int(np.floor(h * share + 0.5))
        if cw >= 4 and ch >= 4:
            x0, y0 = int(w * x), int(h * y)
            out.append((name, dhash(img[y0 : y0 + ch, x0 : x0 + cw], n)))
    return out


def _half_up(x: np.ndarray) -> list[int]:
    return np.floor(x + 0.5).astype(int).tolist()


def colour_histogram(img: np.ndarray) -> list[int]:
    """Eight bins each of red, green, blue and luma at 64 x 64, scaled to bytes."""
    small = np.clip(resize(img if img.ndim == 3 else np.repeat(img[:, :, None], 3, 2), 64, 64), 0, 255)
    planes = [*np.moveaxis(small, 2, 0), gray(small)]
    counts = [np.bincount(np.minimum(p.astype(int) // 32, 7).ravel(), minlength=8) for p in planes]
    return _half_up(np.concatenate(counts) / 4096 * 255)


def edge_histogram(img: np.ndarray) -> list[int]:
    """Sobel edges at 64 x 64 by direction, strength and quadrant; zeros without edges."""
    g = gray(resize(img, 64, 64))
    d = lambda y, x: g[1 + y : 63 + y, 1 + x : 63 + x]
    gx = d(-1, 1) - d(-1, -1) + 2 * (d(0, 1) - d(0, -1)) + d(1, 1) - d(1, -1)
    gy = d(1, -1) - d(-1, -1) + 2 * (d(1, 0) - d(-1, 0)) + d(1, 1) - d(-1, 1)
    strength = np.hypot(gx, gy)
    y, x = np.nonzero(strength >= EDGE_LEAST)
    if not len(y):
        return [0] * (DIRECTIONS + STRENGTHS + 4)
    angle = np.arctan2(gy, gx)[y, x]
    angle = np.where(angle < 0, angle + np.pi, angle)
    direction = np.minimum((angle / np.pi * DIRECTIONS).astype(int), DIRECTIONS - 1)
    level = np.minimum((strength[y, x] / EDGE_TOP * STRENGTHS).astype(int), STRENGTHS - 1)
    quadrant = np.where(y + 1 < 32, 0, 2) + np.where(x + 1 < 32, 0, 1)
    counts = [np.bincount(direction, minlength=DIRECTIONS), np.bincount(level, minlength=STRENGTHS), np.bincount(quadrant, minlength=4)]
    return _half_up(np.concatenate(counts) / len(y) * 255)


def cosines(n: int = 32) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def phash(img: np.ndarray) -> bytes:
    """63 bits: which low frequencies, but for the mean, exceed their average; the last bit is zero."""
    c = cosines()
    f = (c @ gray(resize(img, 32, 32)) @ c.T)[:8, :8].ravel()[1:]
    return np.packbits(np.append(f > f.mean(), False)).tobytes()


def words144(raw: bytes) -> dict:
    w = np.frombuffer(raw, ">i8", 2)
    return {"w0": int(w[0]), "w1": int(w[1]), "w2": int.from_bytes(raw[16:18], "big")}


def _long(raw: bytes) -> int:
    return int.from_bytes(raw, "big", signed=True)


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Pixels as floats, gray or red-green-blue, from a row of the image source."""
    img = np.frombuffer(data, np.uint8)
    if height < 1 or width < 1 or len(img) != height * width * channels:
        raise ValueError("pixel data does not match the image's size")
    img = img.reshape(height, width, channels).astype(float)
    return img[:, :, 0] if channels == 1 else img[:, :, 2::-1]


def fingerprint(img: np.ndarray, variants: bool, rotations: bool, crops: bool, colour: bool, freq: bool) -> dict:
    img = resize(img, WORK, WORK)
    turned = ([np.flip(img, 1), np.flip(img, 0)] if variants else []) + ([np.rot90(img, k) for k in (3, 2, 1)] if rotations else [])
    both = lambda i: {"d8": _long(dhash(i, 8)), "d12": words144(dhash(i, 12))}
    return both(img) | {
        "variants": [both(t) for t in turned] or None,
        "crops": [{"name": n, "d12": words144(h)} for n, h in crop_hashes(img)] if crops else None,
        "color_hist": colour_histogram(img) if colour else None,
        "edge_hist": edge_histogram(img) if colour else None,
        "phash": _long(phash(img)) if freq else None,
        "error": None,
    }


def fingerprint_images(images: DataFrame, variants: bool = False, rotations: bool = False, crops: bool = False, colour: bool = False, freq: bool = False) -> DataFrame:
    """Fingerprints of ``(id, image)``, image as in Spark's image source."""
    from twinsift.schema import FINGERPRINTS

    names = ["d8", "d12", "variants", "crops", "color_hist", "edge_hist", "phash", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                try:
                    rows.append(fingerprint(decode(*i), variants, rotations, crops, colour, freq))
                except (TypeError, ValueError) as bad:
                    rows.append(dict.fromkeys(names) | {"error": str(bad)})
            out = pd.DataFrame(rows, columns=names, dtype=object)
            out.insert(0, "id", pdf["id"].astype(object))
            for c in ("d8", "phash"):
                out[c] = pd.array(out[c], "Int64")
            yield out

    cols = images.select(F.col("id").cast("string").alias("id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return cols.mapInPandas(run, FINGERPRINTS)
