"""Distances between fingerprints and what follows from them, as Column functions.

A distance that cannot be had is null, so that ``distance <= t`` is not true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift.config import SENSITIVITY

#: Fixed values of the decision ladder.
CROP_LENIENCY, CROP_COMBINED, PROMOTE_COMBINED, PROMOTE_REACH = 1.3, 0.12, 0.06, 2
COLOUR_SHARE, EDGE_SHARE = 0.4, 0.6
#: Lowest percent of each band.
BADGES = ((100, "identical"), (90, "near"), (75, "similar"))
CATEGORIES = ((100, "identical"), (95, "near-identical"), (85, "very-similar"), (70, "similar"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming144(a: Column, b: Column) -> Column:
    """Differing bits of two structs (w0, w1, w2) of 64, 64 and 16 bits."""
    return hamming(a["w0"], b["w0"]) + hamming(a["w1"], b["w1"]) + hamming(a["w2"].cast("long"), b["w2"].cast("long"))


def hamming_within(a: Column, b: Column, threshold: int) -> Column:
    """The distance, or null beyond the threshold."""
    d = hamming(a, b)
    return F.when(d <= threshold, d)


def best_of(a: Column, b: Column, distance=hamming) -> Column:
    """Least distance between two arrays of hashes; null if either is null or empty."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: distance(x, y)))))


def best_distance(base_a: Column, variants_a: Column, base_b: Column, variants_b: Column, distance=hamming) -> Column:
    """Least distance of base and variants of either side; null without a base."""
    side = lambda base, more: F.when(base.isNotNull(), F.concat(F.array(base), F.coalesce(more, F.array())))
    return best_of(side(base_a, variants_a), side(base_b, variants_b), distance)


def best_crop_distance(base_a: Column, crops_a: Column, base_b: Column, crops_b: Column, distance=hamming) -> Column:
    """Least of whole against crops, crops against whole and crops against crops; null without crops."""
    some = F.least(best_of(F.array(base_a), crops_b, distance), best_of(crops_a, F.array(base_b), distance), best_of(crops_a, crops_b, distance))
    return F.when((F.size(crops_a) > 0) & (F.size(crops_b) > 0), some)


def hist_distance(a: Column, b: Column) -> Column:
    """Mean difference of two byte histograms, 0 to 1."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total / (255.0 * F.size(a)))


def combined_hist_distance(colour: Column, edge: Column) -> Column:
    """Weighted colour and edge distance; the one that is there if the other is not."""
    both = COLOUR_SHARE * colour + EDGE_SHARE * edge
    return F.coalesce(both, colour, edge)


def extended_distance(dist: Column, threshold: int, crop: Column | None = None, combined: Column | None = None, parity: bool = False) -> Column:
    """The ladder: base match, crop match, promotion by histograms, else the base distance.

    ``parity`` accepts a crop up to 1.3 times the threshold, which then may
    exceed the threshold itself; otherwise a crop must be within it.
    """
    out = F.when(dist <= threshold, dist)
    if crop is not None:
        reach = -int(-threshold * CROP_LENIENCY // 1) if parity else threshold
        fits = crop <= reach
        if combined is not None:
            fits = fits & (combined < CROP_COMBINED)
        out = out.when(fits, F.least(dist, crop))
    if combined is not None:
        out = out.when((combined < PROMOTE_COMBINED) & (dist <= threshold * PROMOTE_REACH), F.lit(threshold))
    return out.otherwise(dist)


def phash_bound(threshold: int) -> int:
    return -(-threshold * 64 // 144)


def with_phash(dist: Column, phash: Column, bound: int) -> Column:
    """The lesser of the distance and the scaled frequency-hash distance, if that is within its bound."""
    scaled = F.floor(phash * 144 / 64 + 0.5).cast("int")
    return F.when(phash <= bound, F.least(dist, scaled)).otherwise(dist)


def sensitivity_threshold(level: Column) -> Column:
    """The largest distance of a sensitivity level; 10 if unknown."""
    out = F
    for known, distance in SENSITIVITY.items():
        out = out.when(level == known, distance)
    return out.otherwise(10)


def normalised_phash(d: Column) -> Column:
    return d / 64


def percent(dist: Column, bits: int = 144) -> Column:
    """100 only for distance 0, else 0 to 99; null for null."""
    rounded = F.floor((1 - dist / bits) * 100 + 0.5).cast("int")
    return F.when(dist.isNull(), None).when(dist == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), rounded)))


def export_percent(dist: Column, bits: int = 144) -> Column:
    return F.floor((1 - dist / bits) * 100 + 0.5).cast("int")


def _banded(pct: Column, bands, last: str) -> Column:
    out = F.when(pct.isNull(), None)
    for low, name in bands:
        out = out.when(pct >= low, name)
    return out.otherwise(last)


def badge(pct: Column) -> Column:
    return _banded(pct, BADGES, "loose")


def similarity_category(dist: Column, bits: int = 144) -> Column:
    return _banded(percent(dist, bits), CATEGORIES, "different")
