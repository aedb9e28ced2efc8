"""What a reviewer decides: rejected pairs, trash, restore, undo, queue.

Actions are an append-only log (seq, id, name, action, status, ts); the state
of a file is its last successful action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Undo depth and life, queue and rejection limits, batch size.
UNDO_DEPTH, UNDO_SECONDS, MAX_REJECTIONS, BATCH = 50, 30 * 60, 10_000, 100


def ignore_pairs(rows: DataFrame, group: str = "group_id", id_: str = "id") -> DataFrame:
    """Distinct (group, i, j), i < j, of all pairs within the groups given.

    Called for the groups a reviewer ignores, whose pairs are what is recorded.
    """
    a, b = rows.alias("a"), rows.alias("b")
    joined = a.join(b, F.expr(f"a.{group} = b.{group} AND a.{id_} < b.{id_}"))
    return joined.select(F.col(f"a.{group}").alias(group), F.col(f"a.{id_}").alias("i"), F.col(f"b.{id_}").alias("j")).distinct()


def reject(pairs: DataFrame, hash_a: str, hash_b: str, seq: Column) -> DataFrame:
    """Rejections (lo, hi, seq) in canonical order."""
    return pairs.select(F.least(hash_a, hash_b).alias("lo"), F.greatest(hash_a, hash_b).alias("hi"), seq.alias("seq"))


def rejection_count(rejections: DataFrame) -> DataFrame:
    """One row: ``rejected``, the number of distinct rejected pairs."""
    return rejections.select("lo", "hi").distinct().agg(F.count("*").alias("rejected"))


def newest_rejections(rejections: DataFrame, most: int = MAX_REJECTIONS) -> DataFrame:
    """The newest distinct pairs, ``most`` of them: each counts from when it was first recorded."""
    first = rejections.groupBy("lo", "hi").agg(F.min("seq").alias("seq"))
    return first.orderBy(F.desc("seq"), "lo", "hi").limit(most)


def keep_unrejected(rows: DataFrame, rejected: DataFrame, group: str = "group_id", id_: str = "id") -> DataFrame:
    """Members that some partner of their group has not rejected; a group that would fall below two stays whole."""
    size = F.count("*").over(Window.partitionBy(group))
    both = rejected.select(F.col("i").alias("_x"), F.col("j").alias("_y")).union(rejected.select("j", "i")).distinct()
    g = rows.select(group, F.col(id_).alias("_y"))
    against = rows.select(group, F.col(id_).alias("_x")).join(both, "_x").join(g, [group, "_y"]).groupBy(group, "_x").agg(F.count("*").alias("_n"))
    marked = rows.withColumn("_size", size).join(against.withColumnRenamed("_x", id_), [group, id_], "left")
    stays = (F.coalesce("_n", F.lit(0)) < F.col("_size") - 1).cast("int")
    left = F.sum(stays).over(Window.partitionBy(group))
    return marked.withColumn("_stays", stays).withColumn("_left", left).filter("_stays = 1 OR _left < 2").drop("_size", "_n", "_stays", "_left")


def unprotected(rows: DataFrame, excluded: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Rows whose folder is not excluded; rows without a folder pass."""
    return rows.join(excluded.select(F.col("id").alias("_f")).distinct(), F.col(parent) == F.col("_f"), "left_anti")


def batches(ids: DataFrame, size: int = BATCH) -> DataFrame:
    """Ids with a batch number: ids are dealt by hash, so batches hold ``size`` on average."""
    n = max(1, -(-ids.count() // size))
    return ids.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(n)))


def trash_outcome(ids: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, outcome): success for 2xx and 404, failed for others, retry where no response came."""
    status = responses.groupBy("id").agg(F.max("status").alias("status"))
    ok = F.col("status").between(200, 299) | (F.col("status") == 404)
    return ids.join(status, "id", "left").select("id", F.when(F.col("status").isNull(), "retry").when(ok, "success").otherwise("failed").alias("outcome"))


def parse_batch_response(responses: DataFrame, boundary: str, text: str = "text") -> DataFrame:
    """(id, status) from multipart texts: a part's Content-ID, less its prefix, and its status line."""
    part = F.explode(F.split(text, F.lit("--" + boundary)))
    rows = responses.select(part.alias("part"))
    id_ = F.regexp_extract("part", r"(?i)content-id:\s*<?(?:response-)?(?:item-)?([^>\s]+)>?", 1)
    status = F.regexp_extract("part", r"HTTP/[\d.]+\s+(\d{3})", 1)
    return rows.select(id_.alias("id"), status.alias("status")).filter("id <> '' AND status <> ''").select("id", F.col("status").cast("int").alias("status"))


def undo_stack(actions: DataFrame, now: Column, depth: int = UNDO_DEPTH, seconds: int = UNDO_SECONDS) -> DataFrame:
    """Trashed files that can be restored, the latest first: young enough and within the depth."""
    trashed = actions.filter((F.col("action") == "trash")).orderBy(F.desc("seq")).limit(depth)
    return trashed.filter(F.col("ts") >= now - F.expr(f"interval {seconds} seconds"))


def file_state(actions: DataFrame) -> DataFrame:
    """(id, state): the last successful action of each file."""
    ok = F.col("status").between(200, 299) | (F.col("status") == 404)
    last = actions.filter(ok).groupBy("id").agg(F.max_by("action", "seq").alias("state"))
    return last


def pending_queue(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """Queued files, once each and in order of queueing, that no action has trashed yet."""
    done = file_state(actions).filter("state = 'trash'").select("id")
    first = queue.groupBy("id").agg(F.min("seq").alias("seq"))
    return first.join(done, "id", "left_anti")
