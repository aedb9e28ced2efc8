"""Writers: exports of results and of the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.distances import percent

#: Column order of the CSV export.
CSV_COLUMNS = (
    "group", "role", "name", "path", "size", "modifiedTime", "md5Checksum", "mimeType",
    "width", "height", "similarityPct", "matchType", "id", "webViewLink",
)
VERSION = "1"


def export_rows(rows: DataFrame, bits: int = 144) -> DataFrame:
    """The fifteen export fields from ranked rows with ``dist``, ``match_type`` and ``is_keep``."""
    return rows.select(
        F.col("group_id").alias("group"), F.when(F.col("is_keep"), "KEEP").otherwise("DUPLICATE").alias("role"), "id", "name", "path", "size",
        F.col("modified_time").alias("modifiedTime"), F.col("created_time").alias("createdTime"), F.col("md5").alias("md5Checksum"), F.col("mime_type").alias("mimeType"),
        "width", "height", percent(F.col("dist"), bits).alias("similarityPct"), F.col("match_type").alias("matchType"), F.col("web_view_link").alias("webViewLink"),
    )


def csv_lines(items: DataFrame) -> DataFrame:
    """One line for each item: a field is quoted only if it has a comma, a quote or a line end; null is empty."""

    def field(name: str):
        s = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return items.select(F.concat_ws(",", *map(field, CSV_COLUMNS)).alias("line"))


def write_csv(items: DataFrame, path: str) -> None:
    items.select(*CSV_COLUMNS).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(items: DataFrame, path: str) -> None:
    """Items as JSON lines, beside a one-row envelope with the totals."""
    items.write.json(f"{path}/items")
    envelope(items).write.json(f"{path}/envelope")


def envelope(items: DataFrame) -> DataFrame:
    return items.agg(F.count_distinct("group").alias("totalGroups"), F.count("*").alias("totalFiles")).select(F.lit(VERSION).alias("version"), F.current_timestamp().alias("exportedAt"), "totalGroups", "totalFiles")


def export_cache(cache: DataFrame, path: str) -> None:
    cache.write.json(path)
