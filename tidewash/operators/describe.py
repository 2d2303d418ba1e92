"""Descriptive statistics of a table, as the report shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewash.functions.columns import clean_value, col, is_numeric, is_temporal, value_text
from tidewash.functions.parsing import micros_to_timestamp, timestamp_micros
from tidewash.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)
REPORT_COLUMNS = 6
PLACES = 2


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, spread and quartiles of the number and time columns.

    One row per statistic; numbers rounded to two places, half to even. Time
    columns are shown as text. A table with neither kind gets count, unique,
    top and freq of its columns instead.
    """
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    times = [f.name for f in df.schema.fields if is_temporal(f.dataType)]
    if not numbers and not times:
        return describe_objects(df)
    order = [c for c in df.columns if c in numbers or c in times]
    values = {
        c: timestamp_micros(col(c)).cast("double") if c in times else clean_value(df, c).cast("double")
        for c in order
    }
    basics = []
    for i, c in enumerate(order):
        v = values[c]
        basics += [
            F.count(v).alias(f"count{i}"), _mean(df, c, v).alias(f"mean{i}"), F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"), F.stddev_samp(v).alias(f"std{i}"),
        ]
    row = df.agg(*basics).first()
    counts = {c: row[f"count{i}"] for i, c in enumerate(order)}
    quartiles = exact_quantiles(df, values, QUARTILES, counts)
    stats = {}
    for i, c in enumerate(order):
        q = quartiles[c]
        stats[c] = {
            "count": float(counts[c]), "mean": row[f"mean{i}"], "std": None if c in times else row[f"std{i}"],
            "min": row[f"min{i}"], "25%": q[0], "50%": q[1], "75%": q[2], "max": row[f"max{i}"],
        }
    labels = ["count", "mean", "min", "25%", "50%", "75%", "max", "std"] if times else \
        ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    rows = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(s).alias("statistic"),
            *[_cell(stats[c][s], s, c in times).alias(c) for c in order],
        )
        for i, s in enumerate(labels)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _mean(df: DataFrame, name: str, value: Column) -> Column:
    """Microseconds since 1970 need exact sums; a sum of doubles would lose some of them."""
    if is_temporal(df.schema[name].dataType):
        return F.floor(F.avg(timestamp_micros(col(name)).cast("decimal(20,0)"))).cast("double")
    return F.avg(value)


def _cell(value: float | None, statistic: str, is_time: bool) -> Column:
    if not is_time:
        return F.bround(F.lit(value).cast("double"), PLACES)
    if value is None:
        return F.lit(None).cast("string")
    if statistic == "count":
        return F.lit(str(int(value)))
    return value_text(micros_to_timestamp(F.lit(value).cast("bigint")), T.TimestampNTZType())


def describe_objects(df: DataFrame) -> DataFrame:
    """Count, unique, top and freq of every column, one row per column.

    Values are tallied for all columns in one shuffle; the most frequent value
    is the largest tally, the smallest text on a tie.
    """
    entries = [
        F.struct(F.lit(i).alias("pos"), value_text(clean_value(df, c), df.schema[c].dataType).alias("value"))
        for i, c in enumerate(df.columns)
    ]
    names = F.array(*[F.lit(c) for c in df.columns])
    tallies = (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("pos", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        tallies.groupBy("pos")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("n")).alias("inverse"), F.col("value"))).alias("best"),
        )
        .select(
            "pos",
            F.get(names, F.col("pos")).alias("column_name"),
            "count",
            "unique",
            F.col("best.value").alias("top"),
            (-F.col("best.inverse")).alias("freq"),
        )
    )


def describe_report(df: DataFrame) -> DataFrame:
    """The report's table of a frame: at most the columns that its page shows are computed.

    Statistics as rows. A frame without numbers or times gets count, unique, top and freq
    of each column, as texts.
    """
    shown = [c for c in df.columns][: REPORT_COLUMNS - 1]
    measured = [c for c in df.columns if is_numeric(df.schema[c].dataType) or is_temporal(df.schema[c].dataType)]
    if measured:
        return narrow_report(describe(df.select(*[col(c) for c in measured[: REPORT_COLUMNS - 1]])))
    rows = describe_objects(df.select(*[col(c) for c in shown]))

    def cell(statistic: str, i: int) -> Column:
        value = F.max(F.when(F.col("pos") == i, F.col(statistic).cast("string")))
        return F.coalesce(value, F.lit("0")) if statistic in ("count", "unique") else value

    table = F.array(*[
        F.struct(F.lit(k).alias("pos"), F.lit(s).alias("statistic"), *[cell(s, i).alias(c) for i, c in enumerate(shown)])
        for k, s in enumerate(("count", "unique", "top", "freq"))
    ])
    return rows.agg(table.alias("report")).select(F.inline("report"))


def narrow_report(described: DataFrame) -> DataFrame:
    """The statistic label and the first five columns, as wide as the report page."""
    keep = [c for c in described.columns if c != "pos"][:REPORT_COLUMNS]
    return described.select("pos", *[col(c) for c in keep])
