"""Which uploaded files are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewash.functions.text import file_extension

# Accepted extensions and the largest accepted size in bytes.
EXTENSIONS = ("xlsx", "xls", "csv")
MAX_BYTES = 16 * 1024 * 1024


def is_accepted(name: Column, length: Column | None = None) -> Column:
    accepted = F.coalesce(file_extension(name).isin(*EXTENSIONS), F.lit(False))
    return accepted if length is None else accepted & (length <= MAX_BYTES)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, length and acceptance of every file below a folder, without reading contents."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length", "modificationTime")
    )
    name = F.substring_index("path", "/", -1)
    return files.withColumn("name", name).withColumn("accepted", is_accepted(F.col("name"), F.col("length")))
