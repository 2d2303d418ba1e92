"""Signals about columns that the cleaning advice mentions. Thresholds are arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidewash.functions.columns import clean_value, col, literal_rows
from tidewash.functions.parsing import number_or_null, parse_any_date
from tidewash.operators.profile import column_counts


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_signals(
    df: DataFrame,
    identifier_share: float = 0.95,
    parse_share: float = 0.95,
    category_limit: int = 50,
    missing_percentage: float = 30.0,
) -> DataFrame:
    """One row per column: empty, identifier-like, date-like, categorical, number as text, much missing."""
    counts = column_counts(df)
    texts = _texts(df)
    share = F.try_divide(F.col("unique_values_count"), F.col("row_count") - F.col("null_count"))
    idable = F.col("data_type").isin("string", "tinyint", "smallint", "int", "bigint")
    present = F.col("row_count") - F.col("null_count")
    rates = text_parse_rates(df, texts)
    joined = counts.join(rates, "pos", "left")
    flag = lambda test: F.coalesce(test, F.lit(False))
    return joined.select(
        "pos",
        "column_name",
        (present == 0).alias("is_empty"),
        flag(idable & (share >= identifier_share)).alias("is_identifier"),
        flag(F.col("date_rate") >= parse_share).alias("is_date_text"),
        flag((F.col("data_type") == "string") & (F.col("unique_values_count") <= category_limit) & (present > 0)).alias("is_categorical"),
        flag(F.col("number_rate") >= parse_share).alias("is_number_text"),
        (F.col("null_percentage") >= missing_percentage).alias("is_mostly_missing"),
    )


def text_parse_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the non-null texts of each column that read as a date, and as a number."""
    columns = _texts(df) if columns is None else list(columns)
    place = {c: i for i, c in enumerate(df.columns)}
    if not columns:
        return literal_rows(df, [], ["pos", "date_rate", "number_rate"], ["int", "double", "double"])
    row = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count(parse_any_date(col(c))).alias(f"d{i}") for i, c in enumerate(columns)],
        *[F.count(number_or_null(col(c))).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    rate = lambda kind, i: F.try_divide(F.col(f"{kind}{i}"), F.col(f"n{i}"))
    entries = [
        F.struct(F.lit(place[c]).alias("pos"), rate("d", i).alias("date_rate"), rate("m", i).alias("number_rate"))
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*entries)))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Columns that equal an earlier column in every row: `column`, `duplicate_of`.

    One scan gives each column a fingerprint over its rows; columns of one type
    with equal fingerprints are then compared row by row, exactly. Equality is
    transitive, so each column is compared with the first of its kind only.
    """
    row_id = F.monotonically_increasing_id()
    prints = df.select(row_id.alias("_row"), *[clean_value(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    hashable = [i for i, f in enumerate(df.schema.fields) if not isinstance(f.dataType, T.MapType)]
    row = prints.agg(*[F.bit_xor(F.xxhash64("_row", f"c{i}")).alias(f"h{i}") for i in hashable]).first()
    found: list[tuple[str, str]] = []
    open_groups: dict[tuple, list[str]] = {}
    for i in hashable:
        field = df.schema.fields[i]
        open_groups.setdefault((field.dataType.simpleString(), row[f"h{i}"]), []).append(field.name)
    groups = [g for g in open_groups.values() if len(g) > 1]
    while groups:
        same = lambda a, b: F.bool_and(clean_value(df, a).eqNullSafe(clean_value(df, b)))
        tests = [(g[0], c) for g in groups for c in g[1:]]
        row = df.agg(*[same(a, b).alias(f"t{i}") for i, (a, b) in enumerate(tests)]).first()
        equal = {t for i, t in enumerate(tests) if row[f"t{i}"] is not False}
        found += sorted(equal)
        # A fingerprint can only collide; what is left is compared among itself.
        groups = [[c for c in g[1:] if (g[0], c) not in equal] for g in groups]
        groups = [g for g in groups if len(g) > 1]
    rows = [(c, a) for a, c in found]
    return literal_rows(df, rows, ["column_name", "duplicate_of"], ["string", "string"])
