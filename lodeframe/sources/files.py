"""Scans of binary files and of tables that hold texts."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Files without a byte: Spark's scan makes no split of them, but its file index (on the driver) has their names."""
    scan = _scan(spark, path)
    names = [(re.sub("^file:/+", "file:/", unquote(x)),) for x in scan.inputFiles()]
    gone = spark.createDataFrame(names, "path string").join(scan.select("path"), "path", "left_anti")
    return gone.select("path", F.lit(0).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_at"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times only; ``content`` is pruned, so no file is opened."""
    return _named(_scan(spark, path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")))


def read_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Files with their content and digest, empty ones too. The size is checked by the scan, before a file is read."""
    small = _scan(spark, path).where(F.col("length") <= max_bytes)
    rows = small.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    empty = _empty_files(spark, path).withColumn("content", F.lit(b""))
    return _named(rows.unionByName(empty)).withColumn("sha256", F.sha2("content", 256))


def oversized(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    return file_listing(spark, path).where(F.col("size_bytes") > max_bytes).withColumn("error", F.lit("FILE_TOO_LARGE"))


def text_files(table: DataFrame, *, id_col: str, text_col: str, extension: str = ".txt") -> DataFrame:
    """Rows of a table as files: path, name, extension, content, size and digest."""
    named = table.select(F.concat(F.col(id_col).cast("string"), F.lit(extension)).alias("path"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    sized = named.withColumns({"size_bytes": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "modified_at": F.lit(None).cast("timestamp")})
    return _named(sized)


def _named(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.withColumns({"name": name, "extension": F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))})
