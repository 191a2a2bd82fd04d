"""Captured files, one document each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, content`` of every file below a folder whose name fits the pattern."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``feed_id, xml`` of captured feeds; the id is the path."""
    return read_documents(spark, folder, "*.{xml,rss,atom}").toDF("feed_id", "xml")


def read_thread_files(spark: SparkSession, folder: str) -> DataFrame:
    """``post_id, raw`` of captured threads stored as ``<post id>.json``."""
    name = F.element_at(F.split("path", "/"), -1)
    return read_documents(spark, folder, "*.json").select(
        F.regexp_replace(name, r"\.json$", "").alias("post_id"), F.col("content").alias("raw")
    )
