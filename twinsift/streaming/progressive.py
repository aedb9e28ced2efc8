"""Matches as they arrive: groups updated batch by batch, and the change feed.

State is a table in the sink's folder, a new version for each batch. A batch reads the
last version below its own number, so a batch that is given again, or to a new sink after a
restart, has the result it had.
A new edge can merge groups; then the groups that are absorbed are emitted as
retired, so a consumer keyed by group can replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinsift.operators.components import connected_components
from twinsift.plans.workspace import discard, materialize, remove, shared_dir, subfolders

LABELS = "node bigint, component bigint"
EMISSIONS = "batch bigint, group_id bigint, id bigint, retired boolean"


def merge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels with a batch of edges (src, dst) added.

    Only the labels of touched groups are linked again: an edge between nodes
    becomes an edge between their groups.
    """
    known = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    side = lambda df, c: df.join(known, F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_c", c)).drop("_n", "_c")
    fresh = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    linked = connected_components(side(side(edges.select("src", "dst"), "src"), "dst"))
    moved = linked.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return labels.union(fresh).join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


class Versions:
    """A table with a version for each batch that changed it, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def numbers(self) -> list[int]:
        """Versions whose writing ended."""
        names = [n for n in subfolders(self.spark, self.path) if n.startswith("v") and n[1:].isdigit()]
        return sorted(int(n[1:]) for n in names if subfolders(self.spark, f"{self.path}/{n}/done"))

    def before(self, batch: int | None = None) -> DataFrame:
        """The last version below ``batch``, or the last of all."""
        done = [n for n in self.numbers() if batch is None or n < batch]
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{done[-1]}/done/rows")

    def write(self, batch: int, rows: DataFrame) -> DataFrame:
        """Write a version; those before the last two go, since only the last batch can be given again."""
        columns = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/v{batch}/made/rows")
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        made, done = fs_path(f"{self.path}/v{batch}/made"), fs_path(f"{self.path}/v{batch}/done")
        fs = made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(done, True)
        fs.rename(made, done)
        for old in [n for n in self.numbers() if n < batch][:-1]:
            remove(self.spark, f"{self.path}/v{old}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{batch}/done/rows")


class ProgressiveGroups:
    """A foreachBatch sink that keeps labels and writes what changed.

    Emissions (batch, group_id, id, retired): all members of each group that a
    batch changed, and one row with null id for each group that it retired.
    A repeated batch id overwrites its own output, so a restart repeats nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.versions = Versions(spark, f"{path}/_labels", LABELS)

    @property
    def labels(self) -> DataFrame:
        return self.versions.before()

    def __call__(self, edges: DataFrame, batch: int) -> None:
        edges = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
        if edges.isEmpty():
            return
        before = self.versions.before(batch)
        after = self.versions.write(batch, merge_labels(before, edges))
        old, new = before.alias("o"), after.alias("n")
        changed = new.join(old, F.expr("n.node = o.node AND n.component = o.component"), "left_anti").select("component").distinct()
        members = after.join(changed, "component").select(F.lit(batch).alias("batch"), F.col("component").alias("group_id"), F.col("node").alias("id"), F.lit(False).alias("retired"))
        gone = before.select("component").distinct().join(after.select("component").distinct(), "component", "left_anti")
        retired = gone.select(F.lit(batch).alias("batch"), F.col("component").alias("group_id"), F.lit(None).cast("bigint").alias("id"), F.lit(True).alias("retired"))
        members.union(retired).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        discard(edges)


def emissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("group_id bigint, id bigint, retired boolean").option("basePath", path).parquet(f"{path}/batch=*").selectExpr("cast(batch as bigint) batch", "group_id", "id", "retired")


def current_groups(emitted: DataFrame) -> DataFrame:
    """(group_id, id) that a consumer holds: each group's last emission, without retired groups."""
    last = emitted.groupBy("group_id").agg(F.max("batch").alias("batch"))
    rows = emitted.join(last, ["group_id", "batch"])
    retired = rows.filter("retired").select("group_id")
    return rows.filter("NOT retired").join(retired, "group_id", "left_anti").select("group_id", "id")


def start_progressive(edges: DataFrame, path: str, checkpoint: str, sink: ProgressiveGroups) -> StreamingQuery:
    """Run a stream of edges through the sink until what is there now is read."""
    return edges.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- change feed ----------------------------------------------------------------------------------------------


def latest_changes(changes: DataFrame, id_: str = "file_id", seq: str = "seq") -> DataFrame:
    """The last change of each file; a trashed file counts as removed."""
    removed = F.col("removed")
    if "trashed" in changes.columns:
        removed = F.coalesce(removed, F.lit(False)) | F.coalesce(F.col("trashed"), F.lit(False))
    rows = changes.withColumn("removed", F.coalesce(removed, F.lit(False)))
    return rows.groupBy(id_).agg(F.max(F.struct(seq, *[c for c in rows.columns if c not in (id_, seq)])).alias("_l")).select(id_, "_l.*")


def merge_changes(files: DataFrame, latest: DataFrame, id_: str = "id", file_id: str = "file_id") -> DataFrame:
    """Listed ids less those changed, and the changed ones that are not removed: each id once."""
    changed = latest.select(F.col(file_id).alias(id_), "removed")
    kept = files.select(id_).distinct().join(changed.select(id_), id_, "left_anti").withColumn("changed", F.lit(False))
    return kept.union(changed.filter("NOT removed").select(id_, F.lit(True).alias("changed")))


class ChangeTable:
    """A foreachBatch sink that keeps the latest change of each file in the shared folder."""

    def __init__(self, spark: SparkSession, schema: str, id_: str = "file_id", seq: str = "seq", path: str | None = None):
        self.id, self.seq = id_, seq
        self.versions = Versions(spark, path or checkpoint_dir(spark, "change-table"), schema)

    @property
    def table(self) -> DataFrame:
        return self.versions.before()

    def __call__(self, rows: DataFrame, batch: int) -> None:
        before = self.versions.before(batch)
        self.versions.write(batch, latest_changes(before.union(rows.select(*before.columns)), self.id, self.seq))


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/twinsift/stream-{uuid.uuid4().hex}-{name}"


def expire(rows: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows younger than a time to live."""
    return rows.filter(F.col(ts) > F.current_timestamp() - F.expr(f"interval {seconds} seconds"))
