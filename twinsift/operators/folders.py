"""The folder tree: breadth-first listing, exclusions, limits, paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.operators.groups import numbered
from twinsift.plans.workspace import materialize

MAX_DEPTH = 50


def breadth_first(folders: DataFrame, roots: DataFrame, excluded: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of all folders under the roots, each once, at its least depth.

    An excluded folder is never entered, so its subtree is missing unless
    another way leads there. One join for each level, against the folders not
    seen yet; a cycle ends when a level brings nothing new. The depth has no
    limit unless the caller gives one.
    """
    tree = folders.select("id", "parent_id")
    gone = excluded.select("id").distinct() if excluded is not None else None

    def allowed(df: DataFrame) -> DataFrame:
        return df if gone is None else df.join(gone, "id", "left_anti")

    level = materialize(allowed(roots.select("id").distinct()).withColumn("depth", F.lit(0)), "level")
    seen = level
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        below = tree.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
        level = materialize(allowed(below.join(seen.select("id"), "id", "left_anti")).withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def files_in(files: DataFrame, folders: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Files of the listed folders, with their folder's depth."""
    return files.join(folders.select(F.col("id").alias(parent), "depth"), parent)


def flat(files: DataFrame, included: DataFrame, excluded: DataFrame | None = None, parent: str = "parent_id") -> DataFrame:
    """Files directly in the included folders, less the excluded ones."""
    keep = included.select(F.col("id").alias(parent)).distinct()
    if excluded is not None:
        keep = keep.join(excluded.select(F.col("id").alias(parent)).distinct(), parent, "left_anti")
    return files.join(keep, parent, "left_semi")


def scan_index(listed: DataFrame, *order: str) -> DataFrame:
    """``listed`` with ``idx`` from 0 in listing order: folder depth, folder, name, id by default.

    Rows are put in order over all partitions, whatever the size of a folder.
    """
    if order:
        raise ValueError("the listing order is fixed: depth, parent_id, name, id")
    return numbered(listed, "depth", "parent_id", "name", "id", name="_number").withColumn("idx", F.col("_number") - 1).drop("_number")


def first_items(indexed: DataFrame, limit: int | None) -> DataFrame:
    """The first files in listing order, before any filter."""
    return indexed if limit is None else indexed.filter(F.col("idx") < limit)


def paths(items: DataFrame, folders: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, path) of items with ``name`` and ``parent_id``: folder names from the top, joined by slashes.

    A missing parent ends the path there; so does the depth limit.
    """
    tree = folders.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("parent_id").alias("_parent"))
    open_ = items.select("id", F.concat(F.lit("/"), F.coalesce("name", F.lit(""))).alias("path"), F.col("parent_id").alias("up"))
    done = None
    for _ in range(max_depth):
        stepped = open_.join(tree, F.col("up") == F.col("_id"), "left")
        path = F.when(F.col("_id").isNotNull(), F.concat(F.lit("/"), F.coalesce("_name", F.lit("")), F.col("path"))).otherwise(F.col("path"))
        stepped = materialize(stepped.select("id", path.alias("path"), F.col("_parent").alias("up")), "paths")
        ended = stepped.filter("up IS NULL").select("id", "path")
        done = ended if done is None else done.union(ended)
        open_ = stepped.filter("up IS NOT NULL")
        if open_.isEmpty():
            break
    return done.union(open_.select("id", "path"))


def search(folders: DataFrame, query: str) -> DataFrame:
    """Folders whose name has the query, in any case, ordered by name."""
    return folders.filter(F.lower("name").contains(query.lower())).orderBy("name")


def children(folders: DataFrame, parent: str | int) -> DataFrame:
    return folders.filter(F.col("parent_id") == F.lit(parent))


def selection(included: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Included and excluded sets made exclusive: a folder in both is included."""
    inc = included.select("id").distinct()
    return inc, excluded.select("id").distinct().join(inc, "id", "left_anti")


def with_link(rows: DataFrame, link: Column) -> DataFrame:
    return rows.withColumn("link", link)
