"""A fingerprint cache as a table keyed by id, content and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_AGE_DAYS = 90
KEY = ["id", "md5"]


def lookup(files: DataFrame, cache: DataFrame, needed: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): a hit has the same id and content and all needed features."""
    usable = cache.filter(needed).dropDuplicates(KEY)
    hits = files.select(*KEY).join(usable, KEY)
    return hits, files.join(usable.select(*KEY), KEY, "left_anti")


def features_present(colour: bool = False, crops: bool = False, variants: bool = False, phash: bool = False) -> Column:
    need = F.col("d12").isNotNull()
    for wanted, column in ((colour, "color_hist"), (colour, "edge_hist"), (crops, "crops"), (variants, "variants"), (phash, "phash")):
        if wanted:
            need = need & F.col(column).isNotNull()
    return need


def upsert(cache: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The cache with rows of the same key replaced and stamped ``now``."""
    fresh = rows.dropDuplicates(KEY).withColumn("ts", now)
    return cache.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh, allowMissingColumns=True)


def expire(cache: DataFrame, now: Column, days: int = MAX_AGE_DAYS) -> DataFrame:
    return cache.filter(F.col("ts") >= now - F.expr(f"interval {days} days"))


def delete(cache: DataFrame, ids: DataFrame) -> DataFrame:
    return cache.join(ids.select("id").distinct(), "id", "left_anti")


def by_md5(cache: DataFrame, md5: str) -> DataFrame:
    return cache.filter(F.col("md5") == md5)


def by_ids(cache: DataFrame, ids: DataFrame) -> DataFrame:
    return cache.join(ids.select("id").distinct(), "id", "left_semi")
