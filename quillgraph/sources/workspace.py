"""Scanning source trees and logs through Spark's readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import ignored, scanned_language, stable_id
from quillgraph.schema import TELEMETRY


def scan(spark: SparkSession, root: str, max_bytes: int = 1 << 20) -> DataFrame:
    """Source and configuration files below ``root``: rel_path, language, size, time, hash, content; by rel_path.

    Contents of files over ``max_bytes`` are null, and so are their hashes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*(?=/)", "", root).strip("/") + "/"
    rel = F.substring_index("path", base, -1)
    rows = raw.withColumn("rel_path", rel).withColumn("language", scanned_language(F.col("rel_path"))).where("language is not null")
    small = F.col("length") <= max_bytes
    return rows.select(
        stable_id(F.lit(root), F.col("rel_path")).alias("file_id"),
        "rel_path",
        "language",
        F.col("length").alias("size_bytes"),
        F.unix_millis("modificationTime").alias("mtime_unix_ms"),
        F.when(small, F.substring(F.sha2("content", 256), 1, 16)).alias("content_hash"),
        F.when(small, F.col("content").cast("string")).alias("content"),
    ).orderBy("rel_path")


def bounded_scan(spark: SparkSession, root: str, ignore: list[str] | None = None, max_files: int = 10_000, max_depth: int = 32, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """The first ``max_files`` source and configuration files by path (rel_path, language, size_bytes), and one row of what was met.

    ``ignore`` has the lines of an ignore file.  Files that are ignored, of no known
    language, deeper than ``max_depth`` folders or larger than ``max_bytes`` are left out;
    a file too large, or more files than are taken, is told as the stop reason.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*(?=/)", "", root).strip("/") + "/"
    rel = F.substring_index("path", base, -1)
    rows = raw.select(rel.alias("rel_path"), scanned_language(rel).alias("language"), F.col("length").alias("size_bytes"))
    why = (
        F.when(ignored(F.col("rel_path"), ignore or []), "ignored")
        .when(F.col("language").isNull(), "other")
        .when(F.size(F.split("rel_path", "/")) - 1 > max_depth, "too_deep")
        .when(F.col("size_bytes") > max_bytes, "too_large")
    )
    told = rows.withColumn("why", why)
    count = lambda name: F.count_if(F.col("why") == name)
    good = F.count_if(F.col("why").isNull())
    stop = F.when(count("too_large") > 0, "file_too_large").when(good > max_files, "file_limit")
    report = told.agg(F.count("*").alias("visited"), F.least(good, F.lit(max_files)).alias("indexed"), *[count(x).alias(x) for x in ("ignored", "other", "too_deep", "too_large")], stop.alias("stop_reason"))
    return told.where("why is null").drop("why").orderBy("rel_path").limit(max_files), report


def scan_report(files: DataFrame) -> DataFrame:
    """One row: files, bytes, files too large to read."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("content").isNull()).alias("too_large"))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines of the fixed schema; malformed ones are left out."""
    return spark.read.schema(TELEMETRY).option("mode", "DROPMALFORMED").json(path).where("kind is not null")


def append_telemetry(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
