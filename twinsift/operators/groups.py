"""Groups of equal or matching files: making, ranking, scoring, filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.operators.components import connected_components
from twinsift.plans.workspace import materialize

NO_PRIORITY = 999999


def exact_groups(files: DataFrame, md5: str = "md5", size: str = "size") -> DataFrame:
    """(md5, size, n, first_id) of each content that at least two rows have."""
    known = files.filter(F.col(md5).isNotNull())
    return known.groupBy(md5, size).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def exact_edges(files: DataFrame) -> DataFrame:
    """An edge from each row of an exact group to its first: a star, not all pairs."""
    groups = exact_groups(files)
    joined = files.join(groups.select("md5", "size", "first_id"), ["md5", "size"]).filter("id <> first_id")
    return joined.select(F.col("first_id").alias("src"), F.col("id").alias("dst"))


def exact_group_stats(files: DataFrame) -> DataFrame:
    """Groups by checksum alone and the files in them."""
    g = files.filter("md5 IS NOT NULL").groupBy("md5").agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def match_groups(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, id): components of the edges; ids that are no file are left out, then groups of one."""
    members = connected_components(edges, "src", "dst").select(F.col("node").alias("id"), F.col("component").alias("group_id"))
    known = members.join(files.select("id"), "id", "left_semi")
    return multiple(known)


def multiple(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows of groups that have at least two."""
    many = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).filter("_n > 1")
    return rows.join(many, F.col(group).eqNullSafe(F.col("_g")), "left_semi")


def numbered(rows: DataFrame, *order, name: str) -> DataFrame:
    """``rows`` with their number from 1 in order.

    Ranges of the order are numbered apart and shifted by what stands before
    them, so no task sees more than a range. The ranges are written, since a
    range's number must not change between its uses.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    # a row for each partition
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    placed = ranged.withColumn("_at", at).join(F.broadcast(before), F.col("_range") == F.col("_r"))
    return placed.withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_range", "_r", "_at", "_before")


def folder_rank(priority: list[str], *fields: Column) -> Column:
    """Number of the first pattern that one of the fields contains."""
    out = F.lit(None).cast("int")
    patterns = [p.strip().lower() for p in priority if p.strip()]
    for i, pattern in reversed(list(enumerate(patterns))):
        found = F.lit(False)
        for f in fields:
            found = found | F.coalesce(F.lower(f).contains(pattern), F.lit(False))
        out = F.when(found, F.lit(i)).otherwise(out)
    return F.coalesce(out, F.lit(NO_PRIORITY))


def keep_key(rule: str, size: Column, modified: Column, width: Column | None = None, height: Column | None = None, rank: Column | None = None) -> Column | None:
    """What the kept row has least of; null for an unknown rule, by which the first row stays."""
    seconds, bytes_ = F.coalesce(modified.cast("long"), F.lit(0)), F.coalesce(size, F.lit(0))
    if rule == "newest":
        return -seconds
    if rule == "oldest":
        return seconds
    if rule == "largest":
        return -bytes_
    if rule == "smallest":
        return bytes_
    if rule == "hires":
        return -F.when((width > 0) & (height > 0), width.cast("long") * height).otherwise(bytes_)
    return rank if rule == "folderPriority" else None


def mark_keep(rows: DataFrame, key: Column | None, group: str = "group_id", order: str = "idx") -> DataFrame:
    """``rows`` with ``is_keep``: one row of each group, the first in order among equals; ``order`` tells a group's rows apart."""
    least = F.struct(*([key.alias("k")] if key is not None else []), F.col(order).alias("o"))
    marked = rows.withColumn("_key", least)
    first = marked.groupBy(F.col(group).alias("_g")).agg(F.min("_key").alias("_first"))
    joined = marked.join(first, F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("is_keep", F.col("_key").eqNullSafe(F.col("_first"))).drop("_key", "_g", "_first")


def keep_ids(rows: DataFrame, key: Column, group: list[str], order: str = "idx") -> DataFrame:
    """(group, keep): as :func:`mark_keep`, by a partial aggregate, so that a hot group is never sorted."""
    return rows.groupBy(*group).agg(F.min(F.struct(key.alias("k"), F.col(order).alias("o"))).alias("_b")).select(*group, F.col("_b.o").alias("keep"))


def wasted_bytes(rows: DataFrame, group: list[str], size: str = "size") -> DataFrame:
    """Bytes of each group beyond one copy."""
    s = F.coalesce(F.col(size), F.lit(0))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), (F.sum(s) - F.max(s)).alias("wasted")).filter("n > 1")


def best_percent(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """``rows`` with ``group_pct``, the highest percent of the group's rows that are not kept."""
    best = rows.groupBy(F.col(group).alias("_g")).agg(F.max(F.when(~F.col("is_keep"), F.col("pct"))).alias("group_pct"))
    return rows.join(best, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def similarity_filter(rows: DataFrame, least: int | None, group: str = "group_id") -> DataFrame:
    """Kept rows, and others of at least that percent; groups left with one row go."""
    return rows if least is None else multiple(rows.filter(F.col("is_keep") | (F.col("pct") >= least)), group)


def select_all(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_keep"))


def remove_ids(rows: DataFrame, ids: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows whose id is not in ``ids``; groups left with one row go."""
    return multiple(rows.join(ids.select("id").distinct(), "id", "left_anti"), group)


def ignore_groups(rows: DataFrame, groups: DataFrame, group: str = "group_id") -> DataFrame:
    return rows.join(groups.select(group).distinct(), group, "left_anti")


def display_order(rows: DataFrame) -> DataFrame:
    """Groups in order with a number from 1, each with its kept row first."""
    names = numbered(rows.select(F.col("group_id").alias("_g")).distinct(), "_g", name="group_number").withColumn("group_number", F.col("group_number").cast("int"))
    return rows.join(names, F.col("group_id").eqNullSafe(F.col("_g"))).drop("_g").orderBy("group_id", F.desc("is_keep"), "idx")


def page(rows: DataFrame, start: int, size: int, *order) -> DataFrame:
    """A slice of the ordered rows."""
    return numbered(rows, *order, name="_place").filter((F.col("_place") > start) & (F.col("_place") <= start + size)).drop("_place")


def filter_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("rows"))


def scan_stats(files: DataFrame, groups: DataFrame, cache_hits: int = 0) -> DataFrame:
    """One row: files, bytes, groups, grouped files, cache hits in percent."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    g = groups.agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("grouped_files"))
    return f.join(g).withColumn("cache_pct", F.when(F.col("files") > 0, F.floor(F.lit(cache_hits) * 100 / F.col("files") + 0.5).cast("long")).otherwise(0))


def hashing_stats(fingerprints: DataFrame, cache_hits: DataFrame) -> DataFrame:
    """One row: fingerprints made and failed, cache hits, and their share in tenths of a percent."""
    made = fingerprints.agg(F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    both = made.join(cache_hits.agg(F.count("*").alias("cache_hits")))
    share = F.col("cache_hits") * 1000 / F.greatest(F.lit(1), F.col("success") + F.col("cache_hits"))
    return both.withColumn("cache_permille", F.floor(share + 0.5).cast("long"))
