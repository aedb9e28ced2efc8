"""Readers: catalogue, images, change feed, cache records, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.predicates import is_supported, sized_link
from twinsift.schema import CHANGES, FILES


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A catalogue in the files schema; JSON sizes may be strings, as services send them."""
    if fmt == "json":
        raw = spark.read.schema(FILES.replace("size bigint", "size string")).json(path)
        return raw.withColumn("size", F.expr("coalesce(try_cast(size AS BIGINT), 0L)"))
    return spark.read.schema(FILES).format(fmt).load(path)


def listing(files: DataFrame, trashed: Column | None = None) -> DataFrame:
    """Rows that a listing returns: not trashed, and images by type or name. The filter reaches the scan."""
    rows = files.filter(is_supported(F.col("mime_type"), F.col("name")))
    return rows if trashed is None else rows.filter(~F.coalesce(trashed, F.lit(False)))


def files_of(files: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some ids."""
    return files.join(ids.select("id").distinct(), "id", "left_semi")


def listing_page(files: DataFrame, parent: str, size: int, after: tuple[str, int | str] | None = None) -> DataFrame:
    """The next ``size`` files of a folder in the order of (name, id), from the last (name, id) of the page before.

    The page token is a position in the order and not a count, so that no page
    reads or sorts those before it, and a file added meanwhile shifts none.
    """
    rows = files.filter(F.col("parent_id") == parent)
    if after is not None:
        name, id_ = (F.lit(x) for x in after)
        rows = rows.filter((F.col("name") > name) | ((F.col("name") == name) & (F.col("id") > id_)))
    return rows.orderBy("name", "id").limit(size)


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(id, image) of a folder of images; id is the path. An undecodable file has a height of -1, and ends with an error in its fingerprints."""
    reader = spark.read.format("image").option("dropInvalid", False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("image.origin").alias("id"), "image")


def read_blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(id, size, modified_time, content) of any files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"), "content")


def preferred_blob(thumb: Column, thumb_type: Column, full: Column) -> Column:
    """The thumbnail if it is an image of over 512 bytes, else the full content."""
    return F.when((F.octet_length(thumb) > 512) & thumb_type.startswith("image/"), thumb).otherwise(full)


def thumbnail_links(files: DataFrame, width: int = 256) -> DataFrame:
    return files.withColumn("thumbnail_link", sized_link(F.col("thumbnail_link"), width))


def start_token(changes: DataFrame) -> int:
    """The position after the last change."""
    return (changes.agg(F.max("seq")).first()[0] or 0) + 1


def changes_since(changes: DataFrame, token: int) -> DataFrame:
    return changes.filter(F.col("seq") >= token)


def stream_changes(spark: SparkSession, path: str, schema: str = CHANGES, per_trigger: int = 1) -> DataFrame:
    """The change feed as a stream of files; the offset is the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def import_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cache records from JSON lines, with a column ``error``: the line itself where it could not be read, else null."""
    return spark.read.schema(f"{schema}, error string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error").json(path)


def settings(table: DataFrame, defaults: dict[str, str]) -> dict[str, str]:
    """Values of the known keys from a (key, value, ts) table, the latest of each."""
    known = table.filter(F.col("key").isin(*defaults)).groupBy("key").agg(F.max_by("value", "ts").alias("value"))
    return defaults | {r["key"]: r["value"] for r in known.collect()}


def scan_history(events: DataFrame) -> DataFrame:
    """(folder_id, name, last, times) from a log of scans."""
    return events.groupBy("folder_id").agg(F.max_by("name", "ts").alias("name"), F.max("ts").alias("last"), F.count("*").alias("times"))
