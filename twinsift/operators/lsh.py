"""Candidate pairs by locality-sensitive bands, and the choice of the bands.

A fingerprint's bytes are cut into bands; rows that agree in all bytes of a
band are candidates. Bands of a setting are disjoint, so a pair with fewer
differing bits than bands is always a candidate.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb, gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.fingerprints import hash_bytes, hash_bytes144
from twinsift.operators.pairs import tiled_pairs

#: Fixed values: (bands, bytes in each) by hash length and setting.
SETTINGS = {
    (144, "loose"): (12, 1), (144, "normal"): (6, 3), (144, "strict"): (4, 4),
    (64, "loose"): (8, 1), (64, "normal"): (4, 2), (64, "strict"): (2, 4),
}
#: Tiles of a comparison of all pairs; tasks are TILES * (TILES + 1) / 2.
TILES = 12
STRIDES = (7, 5, 11, 13, 3, 17, 19, 23)
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST, LOOK_AHEAD = 0.05, 10, 500, 19


def band_bytes(bits: int, setting: str) -> list[list[int]]:
    """Byte numbers of each band: steps of a stride coprime to the length."""
    bands, rows = SETTINGS[bits, setting]
    n = bits // 8
    stride = next(s for s in STRIDES if s < n and gcd(s, n) == 1)
    return [[(b * rows + r) * stride % n for r in range(rows)] for b in range(bands)]


def band_keys(parts: list[Column], bits: int, setting: str) -> Column:
    """Array of (band, key) structs; the key joins the band's bytes in a long."""
    out = []
    for band, at in enumerate(band_bytes(bits, setting)):
        key = parts[at[0]].cast("long")
        for i in at[1:]:
            key = F.call_function("shiftleft", key, F.lit(8)).bitwiseOR(parts[i].cast("long"))
        out.append(F.struct(F.lit(band).alias("band"), key.alias("key")))
    return F.array(*out)


def explode_bands(df: DataFrame, parts: list[Column], bits: int, setting: str, *keep: str) -> DataFrame:
    """One row for each band: the kept columns, band and key."""
    return df.select(*keep, F.explode(band_keys(parts, bits, setting)).alias("_b")).select(*keep, F.col("_b.band").alias("band"), F.col("_b.key").alias("key"))


def candidates(bands: DataFrame, id_: str = "id") -> DataFrame:
    """Distinct (i, j), i < j, that share a band."""
    a, b = bands.alias("a"), bands.alias("b")
    joined = a.join(b, F.expr(f"a.band = b.band AND a.key = b.key AND a.{id_} < b.{id_}"))
    return joined.select(F.col(f"a.{id_}").alias("i"), F.col(f"b.{id_}").alias("j")).distinct()


def probes(bands: DataFrame, bits: int, setting: str, *keep: str) -> DataFrame:
    """Each band's key and all keys one bit away from it."""
    rows = SETTINGS[bits, setting][1]
    flips = F.transform(F.sequence(F.lit(0), F.lit(8 * rows - 1)), lambda k: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return bands.select(*keep, "band", F.explode(F.concat(F.array("key"), flips)).alias("key"))


def multiprobe_candidates(bands: DataFrame, bits: int, setting: str, id_: str = "id") -> DataFrame:
    """Distinct (i, j), i < j, of which one's probe meets the other's key.

    Rows carry the keys of all their bands, and a pair is made only in the first band in which it
    meets, so that pairs are not dealt again to tell them apart. Ids with several keys in a band are
    joined apart, where a pair can come up more than once.
    """
    n = SETTINGS[bits, setting][0]
    of = lambda b: F.when(F.col("band") == b, F.col("key"))
    one = reduce(lambda x, y: x & y, [F.min(of(b)).eqNullSafe(F.max(of(b))) for b in range(n)])
    keys = bands.groupBy(id_).agg(F.array(*[F.max(of(b)) for b in range(n)]).alias("keys"), one.alias("one"))
    each = keys.filter("one").select(id_, "keys", F.posexplode("keys").alias("band", "key")).filter("key IS NOT NULL")
    a, b = probes(each, bits, setting, id_, "keys").alias("a"), each.alias("b")
    near = lambda k: F.coalesce(F.bit_count(F.get("a.keys", F.lit(k)).bitwiseXOR(F.get("b.keys", F.lit(k)))) <= 1, F.lit(False))
    before = reduce(lambda x, y: x | y, [(F.col("a.band") > k) & near(k) for k in range(n - 1)])
    once = a.join(b, F.expr(f"a.band = b.band AND a.key = b.key AND a.{id_} < b.{id_}") & ~before).select(F.col(f"a.{id_}").alias("i"), F.col(f"b.{id_}").alias("j"))
    several = bands.join(keys.filter("NOT one").select(id_), id_, "left_semi")
    probe, other = probes(several, bits, setting, id_).alias("a"), bands.alias("b")
    rest = probe.join(other, F.expr(f"a.band = b.band AND a.key = b.key AND a.{id_} <> b.{id_}"))
    return once.union(rest.select(F.least(f"a.{id_}", f"b.{id_}").alias("i"), F.greatest(f"a.{id_}", f"b.{id_}").alias("j")).distinct())


def lossless_candidates(hashes: DataFrame, parts, bits: int, threshold: int, id_: str = "id", value: str = "h") -> DataFrame:
    """Distinct (i, j), i < j, among which are all pairs with hashes within ``threshold`` bits.

    The hash is cut into blocks of two bytes. Of a near pair, some block differs
    in at most threshold / blocks bits (rounded down); both sides list the keys within half
    of that, so they meet. The larger the threshold, the more keys; nothing depends on the number
    of rows. An id may have several hashes. ``parts`` gives a hash's bytes.
    """
    n = bits // 16
    near = threshold // n
    masks = lambda k: [sum(1 << b for b in c) for size in range(k + 1) for c in combinations(range(16), size)]
    byte = parts(F.col(value))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), (byte[2 * i].cast("int") * 256 + byte[2 * i + 1].cast("int")).alias("key")) for i in range(n)])
    each = hashes.select(id_, F.explode(blocks).alias("_b")).select(id_, "_b.block", "_b.key").distinct()

    def side(k: int) -> DataFrame:
        flips = F.array(*map(F.lit, masks(k)))
        return each.select(id_, "block", F.explode(F.transform(flips, lambda x: F.col("key").bitwiseXOR(x))).alias("key"))

    a, b = side(near // 2).alias("a"), side(near - near // 2).alias("b")
    joined = a.join(b, F.expr(f"a.block = b.block AND a.key = b.key AND a.{id_} <> b.{id_}"))
    return joined.select(F.least(f"a.{id_}", f"b.{id_}").alias("i"), F.greatest(f"a.{id_}", f"b.{id_}").alias("j")).distinct()


def pairs_near(hashes: DataFrame, parts, bits: int, threshold: int, distance, id_: str = "id", value: str = "h") -> DataFrame:
    """Distinct (i, j), i < j, of exactly the ids with hashes within ``threshold`` bits; an id may have several hashes.

    Block b of two bytes is searched within r(b) bits, and the r(b) + 1 add up to threshold + 1: a pair beyond r(b) in
    each block would differ in more bits. Hashes are compared in the join, in the first block in which they meet, so
    that only near pairs leave it, however many share a block. Hashes are flat columns, which shuffle in fewer bytes.
    """
    n = bits // 16
    least, more = divmod(threshold + 1, n)
    reach = [least - (b >= more) for b in range(n)]
    words = [f"{value}.w0", f"{value}.w1", f"{value}.w2"] if bits == 144 else [value]
    at = lambda name: [F.col(f"{name}{k}") for k in range(len(words))]
    whole = lambda name: F.struct(*[c.alias(f"w{k}") for k, c in enumerate(at(name))]) if bits == 144 else at(name)[0]
    flat = hashes.filter(F.col(value).isNotNull()).select(id_, *[F.col(w).alias(f"_h{k}") for k, w in enumerate(words)])
    pair = lambda x, b: parts(x)[2 * b].cast("int") * 256 + parts(x)[2 * b + 1].cast("int")
    used = [b for b in range(n) if reach[b] >= 0]
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), pair(whole("_h"), b).alias("key")) for b in used])
    each = flat.select("*", F.explode(blocks).alias("_b")).select(id_, *at("_h"), "_b.block", "_b.key")

    def side(share) -> DataFrame:
        flips = lambda k: F.array(*[F.lit(sum(1 << b for b in c)) for size in range(k + 1) for c in combinations(range(16), size)])
        masks = F.when(F.col("block") < more, flips(share(least))).otherwise(flips(share(max(0, least - 1))))
        return each.select(id_, *at("_h"), "block", F.explode(F.transform(masks, lambda x: F.col("key").bitwiseXOR(x))).alias("key"))

    a, b = side(lambda r: r // 2).alias("a"), side(lambda r: r - r // 2).alias("b")
    x, y = whole("a._h"), whole("b._h")
    met = lambda k: F.bit_count(pair(x, k).bitwiseXOR(pair(y, k))) <= reach[k]
    before = reduce(lambda u, v: u | v, [(F.col("a.block") > k) & met(k) for k in used], F.lit(False))
    joined = a.join(b, F.expr(f"a.block = b.block AND a.key = b.key AND a.{id_} < b.{id_}") & (distance(x, y) <= threshold) & ~before)
    return joined.select(F.col(f"a.{id_}").alias("i"), F.col(f"b.{id_}").alias("j")).distinct()


def pairs_within(hashes: DataFrame, bits: int, threshold: int, distance, id_: str = "id", value: str = "h") -> DataFrame:
    """(i, j, dist), i < j, of all pairs of rows within ``threshold`` bits.

    Two random hashes meet by the keys of :func:`lossless_candidates` in ``meets`` of them on average. From one on, all
    pairs are fewer, so these are compared in tiles; below, the candidates are. Only pairs within the threshold leave the join.
    """
    n = bits // 16
    near = threshold // n
    keys = lambda k: sum(comb(16, size) for size in range(k + 1))
    meets = n * keys(near // 2) * keys(near - near // 2) / (1 << 16)
    dist = distance(F.col(f"a.{value}"), F.col(f"b.{value}"))
    if meets >= 1:
        joined = tiled_pairs(hashes, id_, TILES, value)
    else:
        parts = hash_bytes if bits == 64 else hash_bytes144
        found = lossless_candidates(hashes, parts, bits, threshold, id_, value)
        side = lambda name: hashes.select(id_, value).alias(name)
        joined = found.join(side("a"), F.col("i") == F.col(f"a.{id_}")).join(side("b"), F.col("j") == F.col(f"b.{id_}"))
    return joined.filter(dist <= threshold).select(F.col(f"a.{id_}").alias("i"), F.col(f"b.{id_}").alias("j"), dist.alias("dist"))


def bucket_stats(bands: DataFrame) -> DataFrame:
    """buckets, avg_size, max_size, singletons, candidate pairs and the reduction in percent."""
    sizes = bands.groupBy("band", "key").agg(F.count("*").alias("n"))
    rows = bands.filter("band = 0").agg(F.count("*").alias("rows"))
    total = sizes.agg(
        F.count("*").alias("buckets"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"),
        F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
    )
    every = F.col("rows") * (F.col("rows") - 1) / 2
    reduction = F.floor(100 * (1 - F.least(F.col("pairs") / every, F.lit(1.0))) + 0.5).cast("long")
    return total.join(rows).select("buckets", "avg_size", "max_size", "singletons", "pairs", F.when(every > 0, reduction).alias("reduction_pct"))


def sample_distances(fps: DataFrame, distance, n: int, id_: str = "id", fp: str = "fp") -> DataFrame:
    """Distances of each sampled row to the next ones in the sample's order.

    The sample is the ``n`` rows of smallest hashed id, so runs agree.
    """
    order = Window.orderBy("_r", id_)
    sample = fps.withColumn("_r", F.crc32(F.col(id_).cast("string"))).orderBy("_r", id_).limit(n).withColumn("_at", F.row_number().over(order))
    a, b = sample.alias("a"), sample.alias("b")
    pairs = a.join(b, F.expr(f"b._at > a._at AND b._at <= a._at + {LOOK_AHEAD}"))
    return pairs.select(distance(F.col(f"a.{fp}"), F.col(f"b.{fp}")).alias("d"))


def distribution(distances: DataFrame) -> DataFrame:
    """count, p10, p25, p50, p75, p90 at position floor(n * p / 100), and mean."""
    s = distances.agg(F.array_sort(F.collect_list("d")).alias("s"), F.avg("d").alias("mean"))
    at = lambda p: F.get("s", F.floor(F.size("s") * p / 100).cast("int")).cast("long").alias(f"p{p}")
    return s.filter(F.size("s") > 0).select(F.size("s").cast("long").alias("count"), *[at(p) for p in (10, 25, 50, 75, 90)], "mean")


def adaptive_setting(n: int, threshold: int) -> str:
    if n > 10_000:
        return "strict" if threshold <= 5 else "normal"
    if n < 1_000 or threshold >= 15:
        return "loose"
    return "strict" if threshold <= 6 else "normal"


def tuned_setting(stats, threshold: int) -> str:
    """From a row of :func:`distribution`; normal without one."""
    if stats is None:
        return "normal"
    if stats["p10"] > 1.5 * threshold:
        return "loose"
    return "strict" if stats["p50"] < 0.5 * threshold else "normal"


def choose_setting(fps: DataFrame, distance, threshold: int, mode: str = "planned", id_: str = "id", fp: str = "fp") -> str:
    """The setting asked for, or the one that the size and a bounded sample suggest."""
    if mode != "planned":
        return mode
    n = fps.count()
    if n < 200:
        return adaptive_setting(n, threshold)
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, int(n * SAMPLE_SHARE)))
    return tuned_setting(distribution(sample_distances(fps, distance, size, id_, fp)).first(), threshold)
