"""Shared column expressions of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(bare, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, SPACES)))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """With doc_id, tells rows apart; rows equal in both have equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a column: one pass that ships a number for each task."""
    return df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0]


def power_of_two(n: float, least: int) -> int:
    k = least
    while k < n:
        k *= 2
    return k
