"""Column profiles: counts, distinct values, first samples and previews."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewash.functions.columns import (
    clean_value, col, is_temporal, literal_rows, pandas_type_name,
    row_order, value_text,
)
from tidewash.functions.parsing import timestamp_micros

UPLOAD_SAMPLES = 3
SUMMARY_SAMPLES = 1
UPLOAD_PREVIEW = 5
CLEAN_PREVIEW = 10
HEAD_ROWS = 32          # rows looked at before a column is searched on its own
LONG_TEXT = 64          # longer texts are compared by their SHA-256


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("col_count"),
    )


def null_percentage(nulls: Column, rows: Column) -> Column:
    """Share of nulls in percent with one decimal, half to even; 0.0 for no rows."""
    return F.when(rows > 0, F.bround(F.try_divide(nulls * F.lit(100.0), rows), 1)).otherwise(F.lit(0.0))


def column_types(df: DataFrame, names: str = "spark") -> DataFrame:
    """Position, name and type name of every column, from the schema alone."""
    shown = [
        f.dataType.simpleString() if names == "spark" else pandas_type_name(f.dataType)
        for f in df.schema.fields
    ]
    rows = [(i, c, t) for i, (c, t) in enumerate(zip(df.columns, shown))]
    return literal_rows(df, rows, ["pos", "column_name", "data_type"], ["int", "string", "string"])


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its nulls, in one scan and without moving values."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(clean_value(df, c)).alias(f"present{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(c).alias("column_name"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"present{i}")).alias("null_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*entries))).withColumn(
        "null_percentage", null_percentage(F.col("null_count"), F.col("row_count"))
    )


def column_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, nulls and distinct values of every column.

    All columns are counted in one shuffle: each row becomes one (column, value)
    pair per column, equal pairs are merged before they move, and the pairs
    spread over all tasks whatever column or value they belong to.
    """
    if approximate:
        return _approximate_counts(df)
    entries = [_pair(df, i, c) for i, c in enumerate(df.columns)]
    lanes = ["whole", "real", "text"]
    is_null = reduce(lambda a, b: a & b, [F.col(x).isNull() for x in lanes])
    counted = (
        df.select(F.inline(F.array(*entries)))
        .groupBy("pos", *lanes)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("pos")
        .agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(is_null, F.col("n"))), F.lit(0)).alias("null_count"),
            F.count_if(~is_null).alias("unique_values_count"),
        )
    )
    # The left side has one row per column of the schema.
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (
        column_types(df)
        .join(counted, "pos", "left")
        .select("pos", "column_name", "data_type", zero("row_count"), zero("null_count"), zero("unique_values_count"))
        .withColumn("null_percentage", null_percentage(F.col("null_count"), F.col("row_count")))
    )


def _pair(df: DataFrame, pos: int, name: str) -> Column:
    """(column position, value) with the value in the lane of its kind, unchanged."""
    dtype, value = df.schema[name].dataType, clean_value(df, name)
    whole = real = text = None
    if isinstance(dtype, T.IntegralType):
        whole = value
    elif isinstance(dtype, T.BooleanType):
        whole = value.cast("int")
    elif isinstance(dtype, T.DateType):
        whole = F.unix_date(value)
    elif isinstance(dtype, T.TimestampType):
        whole = F.unix_micros(value)
    elif is_temporal(dtype):
        whole = timestamp_micros(value)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        real = value
    elif isinstance(dtype, T.StringType):
        text = _comparable(value)
    elif isinstance(dtype, T.BinaryType):
        text = _comparable(F.hex(value))
    else:
        text = _comparable(value.cast("string"))
    lane = lambda v, t: (F.lit(None) if v is None else v).cast(t)
    return F.struct(
        F.lit(pos).alias("pos"),
        lane(whole, "bigint").alias("whole"),
        lane(real, "double").alias("real"),
        lane(text, "string").alias("text"),
    )


def _comparable(text: Column) -> Column:
    """Short texts as they are; of a long text only the digest is moved."""
    digest = F.concat(F.lit("#"), F.sha2(text, 256))
    return F.when(F.length(text) > LONG_TEXT, digest).otherwise(text)


def _approximate_counts(df: DataFrame) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(clean_value(df, c)).alias(f"present{i}") for i, c in enumerate(df.columns)],
        *[F.approx_count_distinct(clean_value(df, c)).alias(f"unique{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"present{i}")).alias("null_count"),
            F.col(f"unique{i}").alias("unique_values_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*entries))).withColumn(
        "null_percentage", null_percentage(F.col("null_count"), F.col("row_count"))
    )


# -- first rows ---------------------------------------------------------------

def head_rows(df: DataFrame, n: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first n rows in order, all columns.

    With a key the n smallest keys are found first, reading that column only;
    the bound then prunes the scan that reads the other columns. Without one the
    first files of a scan are enough.
    """
    if order_by is None:
        df = first_files(df, n)
        return df.withColumn("_row_order", row_order(df)).orderBy("_row_order").limit(n).drop("_row_order")
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    lead = col(names[0])
    bound = df.select(lead.alias("key")).orderBy("key").limit(n).agg(F.max("key")).first()[0]
    if bound is not None and not is_temporal(df.schema[names[0]].dataType):
        df = df.filter(lead.isNull() | (lead <= F.lit(bound)))
    return df.orderBy(*[col(x) for x in names]).limit(n)


def first_files(df: DataFrame, n: int) -> DataFrame:
    """``df`` as far as the first of its files that hold n rows; other files are not opened.

    Files are chosen by their paths, which Spark compares before it reads. What is no plain scan
    of files stays as it is.
    """
    try:
        path = df.metadataColumn("_metadata")["file_path"]
        df.select(path).schema
    except AnalysisException:
        return df
    # The listing writes an empty host (file:///), the column does not (file:/).
    files, taken = sorted({re.sub(r"^([\w+.-]+:)///", r"\1/", name) for name in df.inputFiles()}), 1
    while taken < len(files):
        some = df.filter(path <= F.lit(files[taken - 1]))
        if some.limit(n).count() >= n:
            return some
        taken *= 4
    return df


def first_samples(df: DataFrame, k: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """(pos, sample_values): the first k non-null values of every column, as text.

    Most columns show k values within the first rows; only the counts of those come to the
    driver. All columns that do not are searched together in one pass, whose rank limit leaves
    k rows a column before the shuffle.
    """
    names = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(len(df.columns) - 1))).alias("pos"))
    texts = [value_text(clean_value(df, c), df.schema[c].dataType) for c in df.columns]
    head = head_rows(df, HEAD_ROWS, order_by)
    counts = head.agg(F.count(F.lit(1)), *[F.count(t) for t in texts]).first()
    sparse = [i for i in range(len(texts)) if counts[i + 1] < k] if counts[0] == HEAD_ROWS else []
    parts = [(head, [i for i in range(len(texts)) if i not in sparse]), (df, sparse)]
    found = reduce(DataFrame.unionByName, [_first_cells(rows, texts, of, k, order_by) for rows, of in parts if of])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    values = found.groupBy("pos").agg(listed.alias("values"))
    return names.join(F.broadcast(values), "pos", "left").select("pos", F.coalesce("values", F.array().cast("array<string>")).alias("sample_values"))


def _first_cells(df: DataFrame, texts: Sequence[Column], of: Sequence[int], k: int, order_by) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), texts[i].alias("text")) for i in of])
    present = df.select(row_order(df, order_by).alias("row"), F.inline(cells)).filter(F.col("text").isNotNull())
    place = F.row_number().over(Window.partitionBy("pos").orderBy("row"))
    return present.withColumn("place", place).filter(F.col("place") <= k).select("pos", "place", "text")


def preview(df: DataFrame, n: int = UPLOAD_PREVIEW, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first n rows as text, nulls as empty text."""
    first = head_rows(df, n, order_by)
    return first.select(
        *[F.coalesce(value_text(clean_value(df, c), df.schema[c].dataType), F.lit("")).alias(c) for c in df.columns]
    )


# -- profiles -----------------------------------------------------------------

def upload_profile(
    df: DataFrame, order_by: str | Sequence[str] | None = None, samples: int = UPLOAD_SAMPLES, names: str = "spark"
) -> DataFrame:
    """Name, type, nulls and first samples, one row per column."""
    return (
        null_counts(df)
        .join(F.broadcast(first_samples(df, samples, order_by)), "pos")
        .select("pos", F.col("column_name").alias("name"), _type_name(df, names).alias("type"), "null_count", "sample_values")
    )


def schema_summary(
    df: DataFrame, order_by: str | Sequence[str] | None = None, samples: int = SUMMARY_SAMPLES,
    names: str = "spark", approximate: bool = False,
) -> DataFrame:
    """The compact summary of a table: type, null share, distinct values and samples."""
    return (
        column_counts(df, approximate)
        .join(F.broadcast(first_samples(df, samples, order_by)), "pos")
        .select(
            "pos", "column_name", _type_name(df, names).alias("data_type"),
            "null_percentage", "unique_values_count", "sample_values",
        )
    )


def _type_name(df: DataFrame, names: str) -> Column:
    """The type name by position; pandas names depend on the nulls that were counted."""
    types = [f.dataType for f in df.schema.fields]
    pick = lambda labels: F.get(F.array(*[F.lit(x) for x in labels]), F.col("pos"))
    if names == "spark":
        return pick([t.simpleString() for t in types])
    return (
        F.when((F.col("null_count") == F.col("row_count")) & (F.col("row_count") > 0), pick([pandas_type_name(t, 1, 1) for t in types]))
        .when(F.col("null_count") > 0, pick([pandas_type_name(t, 1) for t in types]))
        .otherwise(pick([pandas_type_name(t) for t in types]))
    )
