"""Opt-in operators for what the advice texts promise: mode, codes, date parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewash.functions.columns import clean_value, col
from tidewash.session import shared_folder

BROADCAST_ROWS = 100_000     # code tables up to this many rows
BROADCAST_BYTES = 32 << 20   # and this many bytes of values are sent to all tasks
HOT_SHARE = 1_000            # a value with more than this fraction of the rows is hot
HOT_BYTES = 4_096            # longer hot values stay in the shuffle; 1,000 of these are 4 MB


def column_mode(df: DataFrame, name: str):
    """The most frequent non-null value, the smallest on a tie.

    Tallied by value and reduced to one row, so no task holds all values.
    """
    value = clean_value(df, name)
    tallies = df.select(value.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    row = tallies.agg(F.min(F.struct((-F.col("n")).alias("inverse"), F.col("v"))).alias("best")).first()
    return row["best"]["v"] if row["best"] is not None else None


def impute_mode(df: DataFrame, name: str) -> DataFrame:
    mode = column_mode(df, name)
    if mode is None:
        return df
    return df.withColumn(name, F.coalesce(clean_value(df, name), F.lit(mode).cast(df.schema[name].dataType)))


def label_codes(df: DataFrame, name: str, small: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The distinct non-null values with their row counts `n` and dense codes 0, 1, ... in value order.

    Many values are sorted into ranges, one per task, and kept in the shared
    folder so that the ranges stay as they are. Each range is numbered on its
    own and the sizes of the ranges before it are added. Values are distinct by
    then, so a frequent value makes no range large. Also returns whether the table
    is small in rows and bytes.
    """
    present = df.select(clean_value(df, name).alias("value")).filter(F.col("value").isNotNull())
    distinct = present.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    size = distinct.agg(F.count(F.lit(1)).alias("rows"), F.sum(_bytes(F.col("value"))).alias("bytes")).first()
    if size["rows"] <= small and (size["bytes"] or 0) <= BROADCAST_BYTES:
        code = F.row_number().over(Window.orderBy("value")) - 1
        return distinct.select("value", "n", code.cast("bigint").alias("code")), True
    spark = df.sparkSession
    folder = shared_folder(spark, "label-codes")
    distinct.repartitionByRange("value").withColumn("range", F.spark_partition_id()).write.parquet(folder)
    ranged = spark.read.parquet(folder)
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    offsets = [0]
    for r in range(max(sizes)):
        offsets.append(offsets[-1] + sizes.get(r, 0))
    offset = F.get(F.array(*[F.lit(o).cast("bigint") for o in offsets]), F.col("range"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("value"))
    return ranged.select("value", "n", (offset + rank - 1).alias("code")), False


def _bytes(value: Column) -> Column:
    return F.octet_length(value.cast("string")).cast("bigint")


def label_encode(df: DataFrame, name: str, out: str | None = None, small: int = BROADCAST_ROWS) -> DataFrame:
    """Adds the code of each value; null stays null.

    A small code table, counted first, is broadcast. A large one is joined by
    shuffle without its hot values: those with more than 1/HOT_SHARE of the rows
    are at most HOT_SHARE values, which are broadcast unless they are very long
    texts. Hot and null rows take no part in the shuffle.
    """
    out = out or f"{name}_code"
    codes, few = label_codes(df, name, small)
    value = clean_value(df, name)
    if few:
        table = codes.select(F.col("value").alias("_value"), F.col("code").alias(out))
        return df.join(F.broadcast(table), value == F.col("_value"), "left").drop("_value")
    rows = codes.agg(F.sum("n")).first()[0]
    hot = codes.filter((F.col("n") * HOT_SHARE > rows) & (_bytes(F.col("value")) <= HOT_BYTES)).select(F.col("value").alias("_hot"), F.col("code").alias("_hot_code"))
    marked = df.join(F.broadcast(hot), value == F.col("_hot"), "left")
    looked_up = F.col("_hot").isNull() & value.isNotNull()
    settled = marked.filter(~looked_up).withColumn(out, F.col("_hot_code"))
    cold = codes.select(F.col("value").alias("_value"), F.col("code").alias(out))
    joined = marked.filter(looked_up).join(cold, value == F.col("_value"), "left")
    kept = [*df.columns, out]
    return settled.select(*kept).unionByName(joined.select(*kept))


def date_parts(df: DataFrame, name: str, reference: Column | None = None) -> DataFrame:
    """Adds year, month, day and, with a reference date, the days up to it."""
    value = col(name)
    out = (
        df.withColumn(f"{name}_year", F.year(value))
        .withColumn(f"{name}_month", F.month(value))
        .withColumn(f"{name}_day", F.dayofmonth(value))
    )
    if reference is not None:
        out = out.withColumn(f"{name}_tenure_days", F.datediff(reference, value))
    return out
