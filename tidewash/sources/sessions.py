"""Session records: one JSON document per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SESSION_SCHEMA = """
    session_id string, name string, original_filename string, file_id string, file_type string,
    sheets array<string>, row_count bigint, col_count bigint,
    columns array<struct<name:string,type:string,null_count:bigint,sample_values:array<string>>>,
    preview array<map<string,string>>, goal string,
    column_actions map<string,struct<action:string,reason:string,transformation:string>>,
    chat_history array<struct<role:string,content:string>>,
    charts array<struct<chart_type:string,title:string,x_axis:string,y_axis:string,description:string>>,
    cleaned_filename string, sheet_name string, pdf_filename string, created_at string,
    bg_result struct<download_url:string,
        stats:struct<initial_rows:bigint,initial_cols:bigint,final_rows:bigint,final_cols:bigint,
            dropped_columns:array<string>,transformations_applied:array<string>>,
        charts:array<map<string,string>>,preview:array<map<string,string>>>
"""
LISTED = ("session_id", "name", "original_filename", "goal", "created_at")
# A private character marks the end of a time, so that a fraction of zero is taken off times only.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'\ue000'"
TIME_FORMATS = {"timestampFormat": _TIME, "timestampNTZFormat": _TIME}
_BROKEN = "_broken"
STORE_BUCKETS = 256


def read_sessions(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """All readable session records below a folder; unreadable ones are skipped.

    ``one_per_file`` reads indented documents; records kept one per line scan
    faster, as a large file can then be split.
    """
    records = (
        spark.read.schema(f"{SESSION_SCHEMA}, {_BROKEN} string")
        .option("multiLine", one_per_file)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    # Spark refuses to read the broken-record column alone, as a plain count would,
    # so the test also looks at a data column; its length is never negative.
    any_id = F.length(F.coalesce("session_id", F.lit(""))) >= 0
    return records.filter(F.col(_BROKEN).isNull() & any_id).drop(_BROKEN)


def list_sessions(sessions: DataFrame) -> DataFrame:
    """The listed fields, newest first; records without a date come last."""
    return sessions.select(*LISTED).orderBy(F.desc(F.coalesce("created_at", F.lit(""))), "session_id")


def find_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("session_id") == session_id)


def write_store(sessions: DataFrame, path: str, buckets: int = STORE_BUCKETS) -> None:
    """Session records laid out by a hash of their id, so that a lookup opens one folder of ``buckets``.

    The number of folders is part of their names, so readers need not know it.
    """
    laid = sessions.withColumn("bucket", _bucket(F.col("session_id"), F.lit(buckets))).withColumn("buckets", F.lit(buckets))
    laid.repartition("bucket").sortWithinPartitions("bucket", "session_id").write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All records of a store."""
    return _stored(spark, path).drop("buckets", "bucket")


def find_in_store(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The record of one session, from the folder of its hash alone; none if there is no such session."""
    own = F.col("bucket") == _bucket(F.lit(session_id), F.col("buckets"))
    return find_session(_stored(spark, path).filter(own), session_id).drop("buckets", "bucket")


def _bucket(session_id: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), buckets).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SESSION_SCHEMA}, buckets int, bucket int").parquet(path)


def json_record(*columns: Column | str) -> Column:
    """Columns as one JSON text: nulls kept, timestamps in ISO form, with their microseconds if there are any."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false", **TIME_FORMATS})
    return F.regexp_replace(text, "(\\.000000)?\ue000\"", "\"")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Session records as JSON lines."""
    sessions.write.mode("overwrite").option("ignoreNullFields", False).json(path)
