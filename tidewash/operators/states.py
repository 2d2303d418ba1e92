"""Profiles that grow with their table: mergeable states of the files counted so far.

Rows and nulls add up, distinct values merge as HyperLogLog sketches. A state covers the files
that were new when it was made and is never written again, so a profile of a grown table reads
its new files only. Files are taken to stay as they were; a file that is gone is an error, as
what it added cannot be taken back.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewash.functions.columns import clean_value
from tidewash.operators.profile import null_percentage

#: Sketches of 2^LG_K registers: the error of a distinct count is about 1.04 / sqrt(2^LG_K), 0.8 % here, of one standard deviation.
LG_K = 14


def files_of(df: DataFrame) -> list[str]:
    """The files of a scan, as the column of their paths writes them."""
    return sorted({re.sub(r"^([\w+.-]+:)///", r"\1/", name) for name in df.inputFiles()})


def _hash(df: DataFrame, name: str) -> Column:
    value, kind = clean_value(df, name), df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0).cast(kind)
    return F.when(value.isNotNull(), F.xxhash64(value))


def add_states(df: DataFrame, folder: str) -> list[str]:
    """Counts the files of the scan ``df`` that ``folder`` does not know, in one pass; returns them."""
    files = files_of(df)
    try:
        states = df.sparkSession.read.parquet(folder)
        columns = [r["column_name"] for r in states.select("pos", "column_name").distinct().orderBy("pos").collect()]
        known = {r[0] for r in states.filter("pos = 0").select(F.explode("files")).collect()}
    except AnalysisException:
        columns, known = df.columns, set()
    if columns != df.columns:
        raise ValueError(f"the table had the columns {columns}, and now {df.columns}")
    if gone := known - set(files):
        raise ValueError(f"files that were counted are gone: {sorted(gone)[:3]}")
    new = [name for name in files if name not in known]
    if not new:
        return []
    rows = df if not known else df.filter(df.metadataColumn("_metadata")["file_path"].isin(new))
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(clean_value(df, c)).alias(f"present{i}") for i, c in enumerate(df.columns)],
        *[F.hll_sketch_agg(_hash(df, c), F.lit(LG_K)).alias(f"sketch{i}") for i, c in enumerate(df.columns)],
    )
    listed = F.array(*[F.lit(name) for name in new])
    entries = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("rows").alias("row_count"),
            F.col(f"present{i}").alias("present"), F.col(f"sketch{i}").alias("sketch"), (listed if i == 0 else F.array().cast("array<string>")).alias("files"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    facts.select(F.inline(F.array(*entries))).write.parquet(f"{folder}/state={uuid.uuid4().hex}")
    return new


def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, nulls and estimated distinct values of every column, over all files counted so far."""
    merged = spark.read.parquet(folder).groupBy("pos").agg(
        F.first("column_name").alias("column_name"), F.first("data_type").alias("data_type"), F.sum("row_count").alias("row_count"),
        (F.sum("row_count") - F.sum("present")).alias("null_count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_values_count"),
    )
    return merged.withColumn("null_percentage", null_percentage(F.col("null_count"), F.col("row_count")))
