"""Chart data on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewash.operators import charts as H
from workload.profile import ORDER_GAPS_SQL, order_gaps
from workload.registry import query, table


def _counts_sql(x: str, source: str, k: int) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY value DESC, label) - 1 AS BIGINT) AS pos, label, value FROM
      (SELECT CAST({x} AS VARCHAR) AS label, count(*) AS value FROM {source} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY value DESC, label LIMIT {k})"""


@query("value_counts_histogram", _counts_sql("p_size", "part", 10))
def value_counts_histogram(spark, sf):
    return H.value_counts(table(spark, sf, "part"), "p_size", H.PAGE_LIMITS["histogram"])


@query("value_counts_bar", _counts_sql("o_totalprice", f"({ORDER_GAPS_SQL})", 15))
def value_counts_bar(spark, sf):
    return H.value_counts(order_gaps(spark, sf), "o_totalprice", H.PAGE_LIMITS["bar"])


@query("pie_shares", f"SELECT *, round_even(value * 100.0 / sum(value) OVER (), 1) AS share FROM ({_counts_sql('p_type', 'part', 6)})")
def pie_shares(spark, sf):
    return H.pie_shares(table(spark, sf, "part"), "p_type")


_NO_TEXT = "CAST(NULL AS VARCHAR) AS x_text, CAST(NULL AS VARCHAR) AS y_text"


@query("scatter_points", f"""
    SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, CAST(o_custkey AS VARCHAR) AS label,
      CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, {_NO_TEXT}
    FROM ({ORDER_GAPS_SQL}) WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY o_orderkey LIMIT 100""")
def scatter_points(spark, sf):
    return H.scatter_points(order_gaps(spark, sf), "o_custkey", "o_totalprice", order_by="o_orderkey")


@query("scatter_points_of_report", f"""
    SELECT CAST(o_custkey AS VARCHAR) AS label, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, {_NO_TEXT}
    FROM ({ORDER_GAPS_SQL}) WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def scatter_points_of_report(spark, sf):
    return H.scatter_points(order_gaps(spark, sf), "o_custkey", "o_totalprice", order_by="o_orderkey", limit=None)


@query("line_points", f"""
    SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS label, CAST(NULL AS DOUBLE) AS x,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS x_text, o_totalprice AS y, CAST(NULL AS VARCHAR) AS y_text
    FROM ({ORDER_GAPS_SQL}) WHERE o_totalprice IS NOT NULL ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def line_points(spark, sf):
    return H.line_points(order_gaps(spark, sf), "o_orderdate", "o_totalprice", order_by="o_orderkey")


@query("line_points_of_report", f"""
    SELECT CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS pos, CAST(o_custkey AS VARCHAR) AS label,
      CAST(o_custkey AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS x_text, o_totalprice AS y, CAST(NULL AS VARCHAR) AS y_text
    FROM ({ORDER_GAPS_SQL}) WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def line_points_of_report(spark, sf):
    return H.line_points(order_gaps(spark, sf), "o_custkey", "o_totalprice", order_by="o_orderkey", limit=None)


@query("bar_means", """
    SELECT CAST(row_number() OVER (ORDER BY l_quantity) - 1 AS BIGINT) AS pos, CAST(l_quantity AS VARCHAR) AS label,
      round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY l_quantity ORDER BY l_quantity LIMIT 15""")
def bar_means(spark, sf):
    return H.bar_means(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("value", F.round("value", 4))


@query("bar_raw", """
    SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS pos, c_name AS label, CAST(NULL AS DOUBLE) AS x,
      c_name AS x_text, c_acctbal AS y, CAST(NULL AS VARCHAR) AS y_text FROM customer ORDER BY c_custkey LIMIT 15""")
def bar_raw(spark, sf):
    return H.bar_raw(table(spark, sf, "customer"), "c_name", "c_acctbal", order_by="c_custkey")


_SPECS = [
    H.ChartSpec("histogram", "Status", "o_orderstatus"),
    H.ChartSpec("pie", "Priority", "o_orderpriority"),
    H.ChartSpec("bar", "Price by priority", "o_orderpriority", "o_totalprice"),
    H.ChartSpec("bar", "Price by customer", "o_custkey", "o_totalprice"),
    H.ChartSpec("bar", "Priorities", "o_orderpriority"),
    H.ChartSpec("scatter", "Points", "o_custkey", "o_totalprice"),
    H.ChartSpec("bar", "No mean", "o_orderstatus", "o_orderpriority"),
    H.ChartSpec("line", "No column", "ghost", "o_totalprice"),
    H.ChartSpec("scatter", "No y", "o_custkey", "ghost"),
]


def _counted(i: int, kind: str, title: str, x: str, k: int) -> str:
    return f"""SELECT CAST({i} AS INTEGER) AS chart_id, '{kind}' AS chart_type, '{title}' AS title, pos, label, CAST(value AS DOUBLE) AS value,
      CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM ({_counts_sql(x, 't', k)})"""


def _pairs(i: int, kind: str, title: str, k: int) -> str:
    return f"""(SELECT {i}, '{kind}', '{title}', CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT), CAST(o_custkey AS VARCHAR),
      o_totalprice, CAST(o_custkey AS DOUBLE), o_totalprice FROM t WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY o_orderkey LIMIT {k})"""


def _means(i: int, title: str, k: int) -> str:
    return f"""(SELECT {i}, 'bar', '{title}', CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT), o_orderpriority,
      round(avg(o_totalprice), 4), NULL, NULL FROM t GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT {k})"""


@query("render_charts", f"WITH t AS ({ORDER_GAPS_SQL})\n" + "\nUNION ALL ".join([
    _counted(0, "histogram", "Status", "o_orderstatus", 10),
    _counted(1, "pie", "Priority", "o_orderpriority", 6),
    _means(2, "Price by priority (Average)", 15),
    _pairs(3, "bar", "Price by customer", 15),
    _counted(4, "bar", "Priorities", "o_orderpriority", 15),
    _pairs(5, "scatter", "Points", 100),
    "SELECT 8, 'scatter', 'No y', NULL, NULL, NULL, NULL, NULL",
]))
def render_charts(spark, sf):
    rendered = H.render_charts(order_gaps(spark, sf), _SPECS, order_by="o_orderkey")
    return rendered.withColumn("value", F.round("value", 4)).drop("x_text", "y_text")


@query("render_report_charts", f"WITH t AS ({ORDER_GAPS_SQL})\n" + "\nUNION ALL ".join([
    _counted(0, "histogram", "Status", "o_orderstatus", 10),
    _counted(1, "pie", "Priority", "o_orderpriority", 6),
    _means(2, "Price by priority", 12),
    """(SELECT 3, 'bar', 'Price by customer', CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT), CAST(o_custkey AS VARCHAR),
      round(avg(o_totalprice), 4), NULL, NULL FROM t WHERE o_custkey IS NOT NULL GROUP BY o_custkey ORDER BY o_custkey LIMIT 12)""",
    _counted(4, "bar", "Priorities", "o_orderpriority", 10),
    """SELECT 5, 'scatter', 'Points', NULL, CAST(o_custkey AS VARCHAR), o_totalprice, CAST(o_custkey AS DOUBLE), o_totalprice
      FROM t WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""",
    _counted(8, "scatter", "No y", "o_custkey", 10),
    """SELECT 9, 'line', 'Prices', row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1, CAST(o_custkey AS VARCHAR), o_totalprice,
      CAST(o_custkey AS DOUBLE), o_totalprice FROM t WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""",
]))
def render_report_charts(spark, sf):
    specs = [*_SPECS, H.ChartSpec("line", "Prices", "o_custkey", "o_totalprice")]
    rendered = H.render_charts(order_gaps(spark, sf), specs, order_by="o_orderkey", report=True)
    return rendered.withColumn("value", F.round("value", 4)).drop("x_text", "y_text")


@query("usable_chart_specs", """
    SELECT doc_id AS dataset, source AS x_axis, 'bar' AS chart_type FROM documents WHERE doc_id % 3 <> 0""")
def usable_chart_specs(spark, sf):
    docs = table(spark, sf, "documents")
    specs = docs.select(
        F.col("doc_id").alias("dataset"),
        F.when(F.col("doc_id") % 3 == 0, "ghost").otherwise(F.col("source")).alias("x_axis"),
        F.lit("bar").alias("chart_type"),
    )
    columns = docs.select(F.col("doc_id").alias("dataset"), F.explode(F.array("lang", "source")).alias("column"))
    return H.usable_specs(specs, columns)


_SUGGESTIONS = [
    H.ChartSpec("histogram", "Ons", "on", None, "counts"),
    H.ChartSpec("bar", "In by the", "the", "in", "means"),
    H.ChartSpec("pie", "Nothing", "no such word", None, "shares"),
]


@query("suggest_charts", """
    WITH w AS (SELECT doc_id AS dataset, unnest(string_split(text, ' ')) AS word, split_part(text, ' ', 1) AS first FROM documents),
    d AS (SELECT dataset, any_value(first) AS first, bool_or(word = 'on') AS has_on, bool_or(word = 'in') AS has_in, bool_or(word = 'the') AS has_the FROM w GROUP BY dataset)
    SELECT dataset, 'histogram' AS chart_type, 'Ons' AS title, 'on' AS x_axis, CAST(NULL AS VARCHAR) AS y_axis, 'counts' AS description FROM d WHERE has_on
    UNION ALL SELECT dataset, 'bar', 'In by the', CASE WHEN has_the THEN 'the' ELSE first END, 'in', 'means' FROM d WHERE has_in""")
def suggest_charts(spark, sf):
    """Words of documents as columns of tables, with suggestions for some of them."""
    columns = table(spark, sf, "documents").select(
        F.col("doc_id").alias("dataset"), F.posexplode(F.split("text", " ")).alias("pos", "column")
    )
    return H.suggest_for_tables(columns, _SUGGESTIONS)
