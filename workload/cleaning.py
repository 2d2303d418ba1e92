"""Cleaning: routing, imputation, dates, numbers, reports on a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewash.operators import encode, recommend as R
from tidewash.operators.charts import bar_means
from tidewash.plans import actions as A, cleaning as C
from workload.profile import ORDER_GAPS_SQL, order_gaps
from workload.registry import query, table


def _do(action, transformation=None, reason=""):
    return {"action": action, "reason": reason, "transformation": transformation}


@query("clean_orders", f"""
    WITH t AS ({ORDER_GAPS_SQL}),
    m AS (SELECT median(o_totalprice) AS price FROM t),
    c AS (SELECT coalesce(o_orderstatus, 'Unknown') AS status, coalesce(o_totalprice, price) AS price FROM t, m)
    SELECT row_number() OVER (ORDER BY status) - 1 AS pos, status AS label, round(avg(price), 4) AS value
    FROM c GROUP BY status ORDER BY status LIMIT 15""")
def clean_orders(spark, sf):
    """Rules on the column names, fit, apply, then the mean price per status."""
    orders = order_gaps(spark, sf)
    actions = R.actions_of(R.recommend_for(orders, "predict order value"))
    cleaned = C.apply(orders, C.fit(orders, actions, order_by="o_orderkey"))
    return bar_means(cleaned, "o_orderstatus", "o_totalprice").withColumn("value", F.round("value", 4))


@query("impute_median", """
    WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
                 CASE WHEN l_partkey % 5 <> 0 THEN l_suppkey END AS l_suppkey, l_tax,
                 CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM lineitem),
    m AS (SELECT median(l_quantity) AS q, median(l_suppkey) AS s FROM t)
    SELECT l_orderkey, l_linenumber, coalesce(l_quantity, q) AS l_quantity, coalesce(CAST(l_suppkey AS DOUBLE), s) AS l_suppkey,
           l_tax, l_extendedprice FROM t, m""")
def impute_median(spark, sf):
    k = F.col("l_orderkey")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(k % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_suppkey")).alias("l_suppkey"),
        "l_tax",
        F.when(k % 4 == 0, None).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
    )
    actions = {c: _do("keep") for c in ("l_orderkey", "l_quantity", "l_suppkey", "l_tax", "absent")}
    return C.clean(lines, actions).data


@query("impute_unknown", """
    SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS in_credit,
           c_acctbal > 100 AS rich, CAST(NULL AS DOUBLE) AS nothing FROM customer""")
def impute_unknown(spark, sf):
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer").select(
        "c_custkey", "c_name",
        F.when(k % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(k % 4 != 0, F.col("c_acctbal") > 0).alias("in_credit"),
        (F.col("c_acctbal") > 100).alias("rich"),
        F.lit(None).cast("string").alias("nothing"),
        "c_nationkey",
    )
    actions = {c: _do("keep") for c in customers.columns}
    actions["c_mktsegment"] = _do("transform", "Custom transform")
    actions["c_nationkey"] = _do("drop")
    return C.clean(customers, actions).data


@query("parse_dates", """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 6 = 1 OR o_orderkey % 6 = 2 THEN NULL ELSE o_orderdate END AS one_layout,
           CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderdate END AS each_alone,
           make_timestamp(o_orderkey * 1000 + 7) AS nanos,
           o_orderdate FROM orders""")
def parse_dates(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    iso, us = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy")
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 6 == 1, "not a date").when(k % 6 == 2, us).otherwise(iso).alias("one_layout"),
        F.when((k == 0) | (k % 6 == 1), F.lit("n/a yet")).when(k % 6 == 2, us).otherwise(iso).alias("each_alone"),
        (k * 1000000 + 7999).alias("nanos"),
        "o_orderdate",
    ).withColumn("each_alone", F.when(k == 0, F.concat(F.lit(" "), iso)).otherwise(F.col("each_alone")))
    actions = {c: _do("transform", "Convert to datetime object") for c in orders.columns[1:]}
    return C.clean(orders, actions, order_by="o_orderkey").data


_NUMBER_TEXT_SQL = """
    SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN '1,000' WHEN 2 THEN p_size || 'd'
        WHEN 3 THEN p_size || 'e2' WHEN 4 THEN '+' || p_size WHEN 5 THEN 'True' WHEN 6 THEN '' WHEN 7 THEN 'NaN'
        ELSE CAST(p_retailprice AS VARCHAR) END AS mixed,
      CAST(p_size AS VARCHAR) AS whole,
      CASE WHEN p_partkey % 5 = 0 THEN 'missing' ELSE CAST(p_retailprice AS VARCHAR) END AS filled, p_size FROM part"""


def _number_texts(spark, sf):
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    m = k % 9
    mixed = (
        F.when(m == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(m == 1, "1,000").when(m == 2, F.concat(size, F.lit("d")))
        .when(m == 3, F.concat(size, F.lit("e2"))).when(m == 4, F.concat(F.lit("+"), size)).when(m == 5, "True")
        .when(m == 6, "").when(m == 7, "NaN").otherwise(price)
    )
    return table(spark, sf, "part").select(
        "p_partkey", mixed.alias("mixed"), size.alias("whole"), F.when(k % 5 == 0, "missing").otherwise(price).alias("filled"), "p_size"
    )


@query("coerce_numbers", f"""
    WITH t AS ({_NUMBER_TEXT_SQL}), n AS (SELECT p_partkey, try_cast(trim(CASE WHEN mixed IN ('NaN') THEN '' ELSE mixed END) AS DOUBLE) AS mixed,
        CAST(whole AS BIGINT) AS whole, try_cast(filled AS DOUBLE) AS filled, CAST(p_size AS BIGINT) AS p_size FROM t),
    m AS (SELECT median(filled) AS f FROM n)
    SELECT p_partkey, CASE WHEN p_partkey % 9 = 5 THEN NULL ELSE mixed END AS mixed, whole, coalesce(filled, f) AS filled, p_size FROM n, m""")
def coerce_numbers(spark, sf):
    parts = _number_texts(spark, sf)
    actions = {
        "mixed": _do("transform", "to numeric"),
        "whole": _do("transform", "Cast to a NUMBER"),
        "filled": _do("transform", "convert to float, fill missing"),
        "p_size": _do("transform", "point value"),
    }
    return C.clean(parts, actions).data


@query("route_transformations", """
    WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents),
    t AS (SELECT word AS text, count(*) AS uses FROM w GROUP BY word),
    a AS (SELECT *, CASE WHEN uses % 3 = 0 THEN 'drop' WHEN uses % 3 = 1 THEN 'transform' ELSE 'keep' END AS action, lower(text) AS l FROM t)
    SELECT text, action, CASE WHEN action = 'drop' THEN 'drop' WHEN action = 'keep' THEN 'impute'
        WHEN contains(l, 'date') OR contains(l, 'time') THEN 'date'
        WHEN contains(l, 'numeric') OR contains(l, 'number') OR contains(l, 'float') OR contains(l, 'int') THEN
          CASE WHEN contains(l, 'impute') OR contains(l, 'fill') OR contains(l, 'missing') THEN 'number_median' ELSE 'number' END
        ELSE 'impute' END AS op,
      'Transformed ''x'': ' || CASE WHEN text = '' THEN 'imputed missing values' ELSE text END AS message FROM a""")
def route_transformations(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("text"))
    texts = words.groupBy("text").agg(F.count(F.lit(1)).alias("uses"))
    action = F.when(F.col("uses") % 3 == 0, "drop").when(F.col("uses") % 3 == 1, "transform").otherwise("keep")
    return texts.withColumn("action", action).select(
        "text", "action",
        C.route_column(F.col("action"), F.col("text")).alias("op"),
        C.log_message(F.lit("x"), F.col("text")).alias("message"),
    )


_RUN_ACTIONS = {
    "o_orderkey": _do("drop"),
    "o_custkey": _do("transform", "Impute missing values using column median"),
    "o_orderstatus": _do("transform"),
    "o_totalprice": _do("keep"),
    "o_orderdate": _do("transform", "Convert to datetime object"),
    "ghost": _do("drop"),
}


@query("clean_stats", f"""
    WITH t AS ({ORDER_GAPS_SQL})
    SELECT count(*) AS initial_rows, CAST(6 AS BIGINT) AS initial_cols, count(*) AS final_rows, CAST(5 AS BIGINT) AS final_cols,
      'o_orderkey' AS dropped_columns,
      'Transformed ''o_custkey'': Impute missing values using column median|Transformed ''o_orderstatus'': imputed missing values|Transformed ''o_orderdate'': Convert to datetime object'
        AS transformations_applied FROM t""")
def clean_stats(spark, sf):
    stats = C.clean(order_gaps(spark, sf), _RUN_ACTIONS).stats
    return (
        stats.withColumn("dropped_columns", F.array_join("dropped_columns", "|"))
        .withColumn("transformations_applied", F.array_join("transformations_applied", "|"))
    )


@query("transformation_log", """
    SELECT CAST(1 AS INTEGER) AS pos, 'o_custkey' AS "column", 'median' AS op,
      'Transformed ''o_custkey'': Impute missing values using column median' AS message WHERE EXISTS (SELECT * FROM orders)
    UNION ALL SELECT 2, 'o_orderstatus', 'unknown', 'Transformed ''o_orderstatus'': imputed' WHERE EXISTS (SELECT * FROM orders)
    UNION ALL SELECT 4, 'o_orderdate', 'date', 'Transformed ''o_orderdate'': Convert to datetime object' WHERE EXISTS (SELECT * FROM orders)""")
def transformation_log(spark, sf):
    return C.clean(order_gaps(spark, sf), _RUN_ACTIONS, log="background").log


@query("before_after", """
    SELECT 'Total Rows' AS dimension, count(*) AS original, count(*) AS cleaned FROM orders
    UNION ALL SELECT 'Total Features / Columns', CAST(6 AS BIGINT), CAST(5 AS BIGINT)""")
def before_after(spark, sf):
    orders = order_gaps(spark, sf)
    return C.before_after(orders, C.fit(orders, _RUN_ACTIONS))


@query("failed_column", """
    SELECT vec_id, array_to_string([round(x, 3) > 0 for x in embedding], ',') AS signs, CASE WHEN vec_id % 9 = 0 THEN m ELSE CAST(label AS DOUBLE) END AS label,
      'Failed to transform ''embedding'': array<float> columns are not cleaned' AS message
    FROM embeddings, (SELECT median(label) AS m FROM embeddings WHERE vec_id % 9 <> 0)""")
def failed_column(spark, sf):
    """A column that cannot be cleaned stays as it is and is reported; the others are cleaned."""
    vectors = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 9 != 0, F.col("label")))
    result = C.clean(vectors, {"embedding": _do("transform", "scale"), "label": _do("keep")})
    signs = F.array_join(F.transform("embedding", lambda x: (F.round(x, 3) > 0).cast("string")), ",")
    return result.data.select("vec_id", signs.alias("signs"), "label", F.lit(result.plan.messages[0]).alias("message"))


@query("match_actions", """
    SELECT doc_id AS dataset, CAST(n AS BIGINT) AS version, word AS "column" FROM
      (SELECT doc_id, unnest(string_split(lang || ' ' || source || ' ghost', ' ')) AS word, n_chars AS n FROM documents)
    WHERE word <> 'ghost'""")
def match_actions(spark, sf):
    docs = table(spark, sf, "documents")
    wanted = docs.select(
        F.col("doc_id").alias("dataset"), F.col("n_chars").alias("version"),
        F.explode(F.array("lang", "source", F.lit("ghost"))).alias("column"),
    )
    columns = docs.select(F.col("doc_id").alias("dataset"), F.explode(F.array("lang", "source", F.lit("text"))).alias("column"))
    return A.match_actions(wanted, columns)


@query("rules_table", """
    SELECT conv_id AS dataset, turn AS pos, upper(CASE turn % 3 WHEN 0 THEN 'keep' WHEN 1 THEN role ELSE 'transform' END) AS action,
      CASE WHEN turn % 5 = 0 THEN '' ELSE text END || CASE WHEN turn % 3 = 2 THEN ' (Transformation: ' || role || ')' ELSE '' END AS explanation
    FROM conversations""")
def rules_table(spark, sf):
    t = F.col("turn")
    actions = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("dataset"), t.alias("pos"),
        F.when(t % 3 == 1, F.col("role")).when(t % 3 == 2, "transform").alias("action"),
        F.when(t % 5 != 0, F.col("text")).alias("reason"),
        F.when(t % 3 == 2, F.col("role")).when(t % 3 == 1, "").alias("transformation"),
    )
    return A.rules_table(actions, keep=("dataset", "pos"))


@query("impute_mode", """
    WITH t AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS event_type FROM events),
    m AS (SELECT event_type AS v FROM t WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT event_id, coalesce(event_type, v) AS event_type FROM t, m""")
def impute_mode(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("event_type")
    )
    return encode.impute_mode(events, "event_type")


@query("label_encode", """
    SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code,
           dense_rank() OVER (ORDER BY o_totalprice) - 1 AS price_code FROM orders""")
def label_encode(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    coded = encode.label_encode(orders, "o_orderpriority", "code")
    return encode.label_encode(coded, "o_totalprice", "price_code", small=100).drop("o_totalprice")


@query("date_parts", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
      CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
      CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2005-01-01') AS INTEGER) AS o_orderdate_tenure_days FROM orders""")
def date_parts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return encode.date_parts(orders, "o_orderdate", F.to_date(F.lit("2005-01-01"))).drop("o_orderdate")
