"""What the corpus operators share: written stages, prefix sums and whole rows kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewash.session import shared_folder

#: A table of known size is written in files of up to about so many rows.
ROWS_A_FILE = 1 << 16


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: a lost executor costs the tasks it had not finished, and what is
    derived from the table twice is the same both times.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most ``rows`` rows, in no more partitions than that number fills.

    Each file that is written to a local or mounted folder starts several processes beside the
    executor, and until such a process runs its own program it counts with all the executor's memory.
    """
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no column of the input can clash with an own one."""
    return F.struct(*[F.col(f"`{name.replace('`', '``')}`") for name in df.columns])


def running_starts(df: DataFrame, key: str, size: str, start: str, block: int = 4096) -> DataFrame:
    """``df`` (one row per ``key``, keys dense from 0) with the sum of ``size`` over all smaller keys.

    Two levels: sums inside blocks of ``block`` keys in parallel, then over the block totals,
    so a single task sees one row per block only.
    """
    group = (F.col(key) / block).cast("long")
    rows = df.withColumn("_group", group)
    inside = Window.partitionBy("_group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    totals = rows.groupBy("_group").agg(F.sum(size).alias("_total"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (
        rows.join(totals, "_group")
        .withColumn(start, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_group", "_inside", "_before")
    )
