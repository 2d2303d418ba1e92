"""Profiles, previews and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewash.operators import describe as D, detectors, profile as P, states
from tidewash.session import shared_folder
from workload.registry import query, table

# The given tables hold no nulls, so both sides make the same gaps.
EVENT_GAPS = """
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts, user_id,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type,
           CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
           props FROM events"""
EVENT_GAPS_SQL = EVENT_GAPS.replace("CAST('NaN' AS DOUBLE)", "NULL")


def event_gaps(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(k % 13 != 0, F.col("ts")).alias("ts"),
        "user_id",
        F.when(k % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(k % 7 == 0, None).when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        "props",
    )


ORDER_GAPS_SQL = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
           CASE WHEN o_orderkey < 40 OR o_orderkey % 8 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority FROM orders"""


def order_gaps(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when((k >= 40) & (k % 8 != 0), F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


def _union(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


@query("shape", "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS col_count FROM lineitem")
def shape(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query(
    "null_counts",
    f"WITH t AS ({EVENT_GAPS_SQL})\n" + _union([
        f"""SELECT CAST({i} AS INTEGER) AS pos, '{c}' AS column_name, count(*) AS row_count,
            count(*) - count({c}) AS null_count,
            round_even(100.0 * (count(*) - count({c})) / count(*), 1) AS null_percentage FROM t"""
        for i, c in enumerate(_EVENT_COLUMNS)
    ]),
)
def null_counts(spark, sf):
    return P.null_counts(event_gaps(spark, sf))


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("distinct_counts", _union([
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS unique_values_count FROM lineitem"
    for c in _LINE_COLUMNS
]))
def distinct_counts(spark, sf):
    return P.column_counts(table(spark, sf, "lineitem")).select("column_name", "row_count", "unique_values_count")


@query("distinct_counts_of_texts", _union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values_count FROM documents"
    for c in ["doc_id", "text", "lang", "source", "n_chars"]
]))
def distinct_counts_of_texts(spark, sf):
    return P.column_counts(table(spark, sf, "documents")).select("column_name", "unique_values_count")


def _samples(c: str, key: str, k: int) -> str:
    return f"""(SELECT coalesce(string_agg(v, '|' ORDER BY key), '') FROM
        (SELECT CAST({c} AS VARCHAR) AS v, {key} AS key FROM t WHERE {c} IS NOT NULL ORDER BY {key} LIMIT {k}))"""


@query(
    "upload_profile",
    f"WITH t AS ({ORDER_GAPS_SQL})\n" + _union([
        f"""SELECT CAST({i} AS INTEGER) AS pos, '{c}' AS name, '{t}' AS type, count(*) - count({c}) AS null_count,
            {_samples(c, "o_orderkey", 3)} AS samples FROM t"""
        for i, (c, t) in enumerate([
            ("o_orderkey", "int64"), ("o_custkey", "float64"), ("o_orderstatus", "object"),
            ("o_totalprice", "float64"), ("o_orderdate", "datetime64[ns]"), ("o_orderpriority", "object"),
        ])
    ]),
)
def upload_profile(spark, sf):
    profile = P.upload_profile(order_gaps(spark, sf), order_by="o_orderkey", names="pandas")
    return profile.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query(
    "schema_summary",
    f"WITH t AS ({ORDER_GAPS_SQL})\n" + _union([
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type,
            round_even(100.0 * (count(*) - count({c})) / count(*), 1) AS null_percentage,
            count(DISTINCT {c}) AS unique_values_count, {_samples(c, "o_orderkey", 1)} AS samples FROM t"""
        for c, t in [
            ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
        ]
    ]),
)
def schema_summary(spark, sf):
    summary = P.schema_summary(order_gaps(spark, sf), order_by="o_orderkey")
    return summary.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values", "pos")


@query("profile_states", """
    WITH t AS (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name)
    SELECT column_name, (SELECT count(*) FROM events) AS row_count, CAST(0 AS BIGINT) AS null_count, TRUE AS near FROM t""")
def profile_states(spark, sf):
    """Mergeable states of the table's files; the estimated distinct values are near the counted ones."""
    events, folder = table(spark, sf, "events"), shared_folder(spark, "states")
    states.add_states(events, folder)
    states.add_states(events, folder)  # nothing is new
    exact = P.column_counts(events).select("column_name", F.col("unique_values_count").alias("exact"))
    near = F.abs(F.col("unique_values_count") - F.col("exact")) <= 0.05 * F.col("exact") + 0.5
    return states.merged_counts(spark, folder).join(F.broadcast(exact), "column_name").select("column_name", "row_count", "null_count", near.alias("near"))


def _preview_sql(source: str, columns: list[str], key: str, n: int) -> str:
    shown = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in columns)
    return f"WITH t AS ({source}), p AS (SELECT * FROM t ORDER BY {key} LIMIT {n}) SELECT {shown} FROM p"


@query("preview_of_upload", _preview_sql(
    ORDER_GAPS_SQL, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "o_orderkey", 5))
def preview_of_upload(spark, sf):
    return P.preview(order_gaps(spark, sf), P.UPLOAD_PREVIEW, order_by="o_orderkey")


@query("preview_of_cleaned", _preview_sql(
    "SELECT * FROM customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey", 10))
def preview_of_cleaned(spark, sf):
    return P.preview(table(spark, sf, "customer"), P.CLEAN_PREVIEW, order_by="c_custkey")


def _describe_sql(source: str, columns: list[str]) -> str:
    stats = {
        "count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
        "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)", "max": "max({c})",
    }
    return f"WITH t AS ({source})\n" + _union([
        f"SELECT CAST({i} AS INTEGER) AS pos, '{name}' AS statistic, "
        + ", ".join(f"round_even(CAST({e.format(c=c)} AS DOUBLE), 2) AS {c}" for c in columns) + " FROM t"
        for i, (name, e) in enumerate(stats.items())
    ])


_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("describe_numbers", _describe_sql("SELECT * FROM lineitem", _LINE_NUMBERS))
def describe_numbers(spark, sf):
    return D.describe(table(spark, sf, "lineitem").select(*_LINE_NUMBERS))


@query("describe_report_width", _describe_sql("SELECT * FROM lineitem", _LINE_NUMBERS[:5]))
def describe_report_width(spark, sf):
    return D.describe_report(table(spark, sf, "lineitem").select(*_LINE_NUMBERS))


_PART_TEXTS = ["p_name", "p_brand", "p_type"]


def _part_cells(pos: int, statistic: str, cell) -> str:
    return f"SELECT CAST({pos} AS INTEGER) AS pos, '{statistic}' AS statistic, " + ", ".join(f"{cell(c)} AS {c}" for c in _PART_TEXTS)


@query("describe_report_objects", "\nUNION ALL ".join([
    _part_cells(0, "count", lambda c: f"(SELECT CAST(count({c}) AS VARCHAR) FROM part)"),
    _part_cells(1, "unique", lambda c: f"(SELECT CAST(count(DISTINCT {c}) AS VARCHAR) FROM part)"),
    _part_cells(2, "top", lambda c: f"(SELECT {c} FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"),
    _part_cells(3, "freq", lambda c: f"(SELECT CAST(max(n) AS VARCHAR) FROM (SELECT count(*) AS n FROM part GROUP BY {c}))"),
]))
def describe_report_objects(spark, sf):
    return D.describe_report(table(spark, sf, "part").select(*_PART_TEXTS))


def _time_cells(c: str) -> list[str]:
    at = lambda us: f"strftime(make_timestamp(CAST({us} AS BIGINT)), '%Y-%m-%d %H:%M:%S')"
    q = lambda p: at(f"floor(quantile_cont(CAST(epoch_us({c}) AS DOUBLE), {p}))")
    return [f"CAST(count({c}) AS VARCHAR)", at(f"floor(avg(epoch({c}))) * 1000000"), at(f"epoch_us(min({c}))"),
            q(0.25), q(0.5), q(0.75), at(f"epoch_us(max({c}))"), "NULL"]


@query("describe_times", _union([
    f"""SELECT CAST({i} AS INTEGER) AS pos, '{s}' AS statistic, round_even(CAST({e} AS DOUBLE), 2) AS o_totalprice,
        {t} AS o_orderdate FROM orders"""
    for i, (s, e, t) in enumerate(zip(
        ["count", "mean", "min", "25%", "50%", "75%", "max", "std"],
        ["count(o_totalprice)", "avg(o_totalprice)", "min(o_totalprice)", "quantile_cont(o_totalprice, 0.25)",
         "quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75)", "max(o_totalprice)", "stddev_samp(o_totalprice)"],
        _time_cells("o_orderdate"),
    ))
]))
def describe_times(spark, sf):
    described = D.describe(table(spark, sf, "orders").select("o_totalprice", "o_orderdate"))
    return described.withColumn("o_orderdate", F.when(F.col("statistic") == "count", F.col("o_orderdate")).otherwise(F.substring("o_orderdate", 1, 19)))


_PART_TEXTS = ["p_name", "p_brand", "p_type"]


@query("describe_objects", _union([
    f"""SELECT * FROM (SELECT CAST({i} AS INTEGER) AS pos, '{c}' AS column_name, CAST(sum(count(*)) OVER () AS BIGINT) AS "count",
        count(*) OVER () AS "unique", {c} AS top, count(*) AS freq FROM part GROUP BY {c} ORDER BY freq DESC, top LIMIT 1)"""
    for i, c in enumerate(_PART_TEXTS)
]))
def describe_objects(spark, sf):
    return D.describe(table(spark, sf, "part").select(*_PART_TEXTS))


@query("column_signals", """
    WITH t AS (SELECT o_orderkey, CAST(NULL AS DOUBLE) AS nothing, CAST(o_totalprice AS VARCHAR) AS price_text,
                 strftime(o_orderdate, '%m/%d/%Y') AS date_text, o_orderstatus,
                 CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS half FROM orders),
    c AS (SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS n, count(DISTINCT o_orderkey) AS d, count(*) AS r FROM t
      UNION ALL SELECT 'nothing', count(nothing), 0, count(*) FROM t
      UNION ALL SELECT 'price_text', count(price_text), count(DISTINCT price_text), count(*) FROM t
      UNION ALL SELECT 'date_text', count(date_text), count(DISTINCT date_text), count(*) FROM t
      UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(DISTINCT o_orderstatus), count(*) FROM t
      UNION ALL SELECT 'half', count(half), count(DISTINCT half), count(*) FROM t)
    SELECT column_name, n = 0 AS is_empty,
           column_name <> 'nothing' AND coalesce(d * 1.0 / nullif(n, 0) >= 0.95, false) AS is_identifier,
           column_name = 'date_text' AS is_date_text,
           column_name IN ('price_text', 'date_text', 'o_orderstatus') AND d <= 50 AS is_categorical,
           column_name = 'price_text' AS is_number_text,
           100.0 * (r - n) / r >= 30 AS is_mostly_missing FROM c""")
def column_signals(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.lit(None).cast("double").alias("nothing"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_text"),
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("half"),
    )
    return detectors.column_signals(orders).drop("pos")


_PARSE_TEXTS_SQL = """
    SELECT CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN 'on ' || o_clerk END AS dates,
      CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN '1e' || (o_orderkey % 7) WHEN 2 THEN o_orderstatus || '1' WHEN 3 THEN ' ' || o_custkey || ' ' END AS numbers,
      o_orderstatus AS words FROM (SELECT *, o_orderpriority AS o_clerk FROM orders)"""


@query("text_parse_rates", f"""
    WITH t AS ({_PARSE_TEXTS_SQL}), v AS (SELECT unnest(['dates', 'numbers', 'words']) AS column_name, unnest([dates, numbers, words]) AS v FROM t)
    SELECT column_name, CASE WHEN column_name <> 'numbers' THEN count(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'))) / count(v) END AS date_rate,
      count(TRY_CAST(trim(v) AS DOUBLE)) / count(v) AS number_rate FROM v GROUP BY column_name""")
def text_parse_rates(spark, sf):
    """Texts of which some read as dates or numbers, some do not and some are missing."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    dates = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "MM/dd/yyyy")).when(k % 4 == 2, F.concat(F.lit("on "), "o_orderpriority"))
    numbers = (
        F.when(k % 5 == 0, F.col("o_totalprice").cast("string")).when(k % 5 == 1, F.concat(F.lit("1e"), (k % 7).cast("string")))
        .when(k % 5 == 2, F.concat("o_orderstatus", F.lit("1"))).when(k % 5 == 3, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")))
    )
    texts = table(spark, sf, "orders").select(dates.alias("dates"), numbers.alias("numbers"), F.col("o_orderstatus").alias("words"))
    names = F.array(*[F.lit(c) for c in texts.columns])
    name = F.get(names, F.col("pos"))
    return detectors.text_parse_rates(texts).select(name.alias("column_name"), F.when(name != "numbers", F.col("date_rate")).alias("date_rate"), "number_rate")


@query("duplicate_columns", """
    WITH t AS (SELECT l_orderkey, l_quantity, l_quantity AS copied,
                 CASE WHEN l_orderkey = 1 THEN l_quantity + 1 ELSE l_quantity END AS nearly, l_tax FROM lineitem)
    SELECT * FROM (
      SELECT 'copied' AS column_name, 'l_quantity' AS duplicate_of WHERE (SELECT bool_and(copied IS NOT DISTINCT FROM l_quantity) FROM t)
      UNION ALL SELECT 'nearly', 'l_quantity' WHERE (SELECT bool_and(nearly IS NOT DISTINCT FROM l_quantity) FROM t)
      UNION ALL SELECT 'l_tax', 'l_quantity' WHERE (SELECT bool_and(l_tax IS NOT DISTINCT FROM l_quantity) FROM t))""")
def duplicate_columns(spark, sf):
    k, q = F.col("l_orderkey"), F.col("l_quantity")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", q.alias("copied"), F.when(k == 1, q + 1).otherwise(q).alias("nearly"), "l_tax"
    )
    return detectors.duplicate_columns(lines)
