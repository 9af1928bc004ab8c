"""URL tables: (row_id LONG, url STRING, phishing INT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_urls_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = False) -> DataFrame:
    """CSV with header and columns ``url`` and ``phishing``.

    Values may be quoted, with doubled quotes inside. ``multi_line`` allows line breaks in
    quoted values; it is off by default because a file then cannot be split among tasks.
    """
    raw = spark.read.csv(path, header=True, encoding=encoding, quote='"', escape='"', multiLine=multi_line)
    return _shape(raw)


def read_urls_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _shape(spark.read.parquet(path))


COPIES_AT_ONCE = 10_000  # equal rows that one task numbers at a time


def _shape(raw: DataFrame) -> DataFrame:
    url, label = F.col("url").cast("string").alias("url"), F.col("phishing").cast("string").try_cast("int").alias("phishing")
    if "row_id" in raw.columns:
        return raw.select(F.col("row_id").cast("long").alias("row_id"), url, label)
    return with_content_keys(raw.select(url, label))


def with_content_keys(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``rows`` behind a key that depends on their contents only: a 64-bit hash of the row and its number among equal ones.

    Equal rows can't be told apart, so they are counted and written out again with numbers, some thousand a task; which
    files, splits or order the rows came in plays no part. Two different rows share a key with a chance of about
    n^2 / 2^65 (3 in 10,000 for a hundred million rows).
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))
    parts = counted.withColumn("_from", F.explode(starts)).repartition(*columns, "_from")
    last = F.least(F.col("_n"), F.col("_from") + COPIES_AT_ONCE) - 1
    numbered = parts.withColumn("_copy", F.explode(F.sequence(F.col("_from"), last)))
    return numbered.select(F.xxhash64(*columns, "_copy").alias(key), *columns)
