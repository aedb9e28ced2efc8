"""Small key-value state: settings, scan history, resume snapshots, change tokens.

State is a table of (key, value, ts), values as JSON; a write appends and a
read takes the latest row of a key, so a lost writer never leaves half a state.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string, ts double"
#: Fixed value: life of a resume snapshot in seconds.
RESUME_SECONDS = 24 * 3600
RESUME_KEY, TOKEN_KEY = "resume", "changes-token"


class StateTable:
    """Key-value rows under a path that all executors and drivers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def put(self, key: str, value, now: float | None = None) -> None:
        row = [(key, json.dumps(value), time.time() if now is None else now)]
        self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def latest(self, key: str) -> tuple[object, float] | None:
        """(value, time) of the last write; null values count as deleted."""
        row = self.rows().filter(F.col("key") == key).agg(F.max(F.struct("ts", "value")).alias("m")).first()["m"]
        if row is None or (value := json.loads(row["value"])) is None:
            return None
        return value, row["ts"]

    def get(self, key: str, default=None):
        found = self.latest(key)
        return default if found is None else found[0]

    def delete(self, key: str, now: float | None = None) -> None:
        self.put(key, None, now)

    # --- what is kept here ---

    def save_resume(self, folders: list, exclusions: list, found: int, options: dict, now: float | None = None) -> None:
        self.put(RESUME_KEY, {"folders": folders, "exclusions": exclusions, "found": found, "options": options}, now)

    def load_resume(self, now: float | None = None):
        """The snapshot, unless it is older than a day."""
        found = self.latest(RESUME_KEY)
        now = time.time() if now is None else now
        return found[0] if found and now - found[1] <= RESUME_SECONDS else None

    def token(self) -> int | None:
        return self.get(TOKEN_KEY)

    def set_token(self, token: int, now: float | None = None) -> None:
        """Called once the changes up to the token have been written."""
        self.put(TOKEN_KEY, token, now)


def remaining_seconds(pct: Column, elapsed: Column) -> Column:
    """Time left at the pace so far; null before any progress."""
    return F.when((pct > 0) & (pct < 100), elapsed * (100 - pct) / pct).when(pct >= 100, F.lit(0.0))
