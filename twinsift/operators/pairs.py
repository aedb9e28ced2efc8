"""From candidate pairs to match edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled_pairs(df: DataFrame, id_: str, tiles: int, *keep: str) -> DataFrame:
    """All pairs i < j of rows, as an equi-join of tiles: exact, for brute-force comparisons.

    Every row goes to each pair of tiles that has its own, so a task compares
    one tile with another and no side is broadcast.
    """
    own = F.pmod(F.xxhash64(id_), F.lit(tiles)).cast("int")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda p: F.struct(F.least(own, p).alias("p"), F.greatest(own, p).alias("q"))))
    dealt = df.select(id_, *keep, own.alias("_own"), each.alias("_t")).select(id_, *keep, "_own", F.col("_t.p").alias("_p"), F.col("_t.q").alias("_q"))
    a, b = dealt.alias("a"), dealt.alias("b")
    meet = F.expr(f"a._p = b._p AND a._q = b._q AND a.{id_} < b.{id_} AND (a._own <> b._own OR a._p = a._q)")
    return a.join(b, meet)


def window_candidates(df: DataFrame, idx: str, reach: int, near: Column, *keep: str) -> DataFrame:
    """Pairs with i < j < i + reach for which ``near`` (over aliases a and b) holds.

    The range join is an equi-join on buckets of ``reach`` positions: a row looks
    into its own bucket and the next.
    """
    rows = df.select(idx, *keep).withColumn("_w", F.floor(F.col(idx) / reach))
    a = rows.withColumn("_w", F.explode(F.array("_w", F.col("_w") + 1))).alias("a")
    b = rows.alias("b")
    joined = a.join(b, F.expr(f"a._w = b._w AND a.{idx} < b.{idx} AND b.{idx} < a.{idx} + {reach}") & near)
    return joined.select(F.col(f"a.{idx}").alias("i"), F.col(f"b.{idx}").alias("j"))


def attach(pairs: DataFrame, rows: DataFrame, id_: str) -> DataFrame:
    """Pairs with both rows' columns as structs a and b."""
    side = lambda name: rows.select(F.col(id_).alias(f"_{name}"), F.struct(*rows.columns).alias(name))
    out = pairs.join(side("a"), F.col("i") == F.col("_a")).join(side("b"), F.col("j") == F.col("_b"))
    return out.drop("_a", "_b")


def matches(scored: DataFrame, threshold: int, dist: str = "dist") -> DataFrame:
    return scored.filter(F.col(dist) <= threshold)


def drop_rejected(edges: DataFrame, rejections: DataFrame, hash_a: str, hash_b: str) -> DataFrame:
    """Edges whose pair of hashes no reviewer has rejected, in either order."""
    lo, hi = F.least(hash_a, hash_b), F.greatest(hash_a, hash_b)
    gone = rejections.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    return edges.join(gone, (lo == F.col("_lo")) & (hi == F.col("_hi")), "left_anti")
