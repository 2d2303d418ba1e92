"""Small column helpers: null rules, type tests and text forms of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    """A column by its literal name, also when it holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans count as numeric."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def nan_to_null(value: Column, dtype: T.DataType) -> Column:
    """NaN means missing; Spark's aggregates would treat it as a value."""
    return F.nanvl(value, F.lit(None)) if is_float(dtype) else value


def clean_value(df: DataFrame, name: str) -> Column:
    return nan_to_null(col(name), df.schema[name].dataType)


def pandas_type_name(dtype: T.DataType, null_count: int = 0, row_count: int | None = None) -> str:
    """The type name a pandas user would see for the same column."""
    if row_count is not None and row_count > 0 and null_count == row_count:
        return "datetime64[ns]" if is_temporal(dtype) else "float64"
    if isinstance(dtype, T.BooleanType):
        return "object" if null_count else "bool"
    if isinstance(dtype, T.IntegralType):
        return "float64" if null_count else "int64"
    if isinstance(dtype, (T.FractionalType,)):
        return "float64"
    if is_temporal(dtype):
        return "datetime64[ns]"
    return "object"


def value_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a value as Python's ``str`` prints it.

    Spark prints 1.0E7, true and .5 seconds where Python prints 10000000.0,
    True and .500000, so floats, booleans and timestamps are spelled out here.
    """
    if isinstance(dtype, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = value.cast("string")
        return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
    if isinstance(dtype, T.DateType):
        return F.concat(value.cast("string"), F.lit(" 00:00:00"))
    if is_float(dtype):
        return _float_text(value.cast("double"))
    return value.cast("string")


def _float_text(value: Column) -> Column:
    text = value.cast("string")
    # 1.2345E7 -> sign "", digits "12345", exponent 7
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"[-.]", "")
    length = F.greatest(exponent + 1, F.length(digits))
    padded = F.rpad(digits, length, "0")
    fraction = F.substr(padded, exponent + 2)
    plain = F.concat(
        sign,
        F.substr(padded, F.lit(1), exponent + 1),
        F.lit("."),
        F.when(fraction == "", F.lit("0")).otherwise(fraction),
    )
    shift = F.lpad(F.abs(exponent).cast("string"), 2, "0")
    longer = F.when(F.length(shift) < F.length(F.abs(exponent).cast("string")), F.abs(exponent).cast("string"))
    power = F.coalesce(longer, shift)
    scientific = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        power,
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(F.isnan(value), F.lit("nan"))
        .when(text == "Infinity", F.lit("inf"))
        .when(text == "-Infinity", F.lit("-inf"))
        .when(~text.contains("E"), text)
        .when(exponent.between(0, 15), plain)
        .when(exponent.between(-4, -1), small)
        .otherwise(scientific)
    )


def row_order(df: DataFrame, order_by: str | Sequence[str] | None = None) -> Column:
    """One orderable column that says which row comes first.

    ``order_by`` names the key columns. Without it the file position is used
    (path, block, row within the scan), which follows the lines of each file;
    frames that do not come straight from files fall back to scan order.
    """
    if order_by is not None:
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        return F.struct(*[col(n) for n in names])
    scan_order = F.monotonically_increasing_id().alias("row")
    position = [F.input_file_name().alias("file"), F.input_file_block_start().alias("block")]
    try:
        df.select(*position)
    except AnalysisException:  # more than one source
        position = []
    return F.struct(*position, scan_order)


def literal_rows(df: DataFrame, rows: Sequence[tuple], names: Sequence[str], types: Sequence[str]) -> DataFrame:
    """A small frame from driver values, one row per column of some table."""
    spark = df.sparkSession
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows
    ]
    if not structs:
        schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*structs)))
