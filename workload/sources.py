"""Scans and sinks. Files are written to the shared folder of the session and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewash.plans import cleaning as C
from tidewash.session import shared_folder
from tidewash.sources import generator, headers, listing, publish, sessions as S, tables as T
from workload.profile import ORDER_GAPS_SQL, order_gaps
from workload.registry import query, table


@query("csv_scan", f"""
    WITH t AS ({ORDER_GAPS_SQL})
    SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, o_totalprice,
      CASE WHEN o_orderkey % 10 = 1 THEN 'say "hi",' || chr(10) ELSE '' END || o_orderpriority AS quoted, o_orderkey % 2 = 0 AS even, CAST(NULL AS DOUBLE) AS nothing FROM t""")
def csv_scan(spark, sf):
    k = F.col("o_orderkey")
    folder = shared_folder(spark, "csv-scan")
    order_gaps(spark, sf).select(
        "o_orderkey",
        F.coalesce(F.col("o_custkey").cast("string"), F.lit("N/A")).alias("o_custkey"),
        F.coalesce("o_orderstatus", F.lit("null")).alias("o_orderstatus"),
        F.coalesce(F.col("o_totalprice").cast("string"), F.lit("")).alias("o_totalprice"),
        F.concat(F.when(k % 10 == 1, F.lit('say "hi",\n')).otherwise(F.lit("")), F.col("o_orderpriority")).alias("quoted"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("even"),
        F.lit("NaN").alias("nothing"),
    ).write.option("header", True).option("escape", '"').csv(folder)
    return T.read_csv(spark, folder)


@query("clean_sink", f"""
    WITH t AS ({ORDER_GAPS_SQL}), m AS (SELECT median(o_custkey) AS c FROM t)
    SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), c) AS o_custkey, coalesce(o_orderstatus, 'Unknown') AS o_orderstatus, o_totalprice, o_orderdate FROM t, m""")
def clean_sink(spark, sf):
    actions = {
        "o_custkey": {"action": "keep"}, "o_orderstatus": {"action": "keep"},
        "o_orderdate": {"action": "keep"}, "o_orderpriority": {"action": "drop"},
    }
    folder = shared_folder(spark, "cleaned")
    T.write_cleaned(C.clean(order_gaps(spark, sf), actions).data, folder)
    return spark.read.parquet(folder)


@query("published_orders", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def published_orders(spark, sf):
    """A table that is published, and published again from its own rows."""
    path = shared_folder(spark, "published")
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    publish.publish(orders, path)
    publish.publish(publish.read_published(spark, path).withColumn("o_totalprice", F.col("o_totalprice") * 2), path)
    return publish.read_published(spark, path)


# A third of the orders gets a fraction of a second.
_FRACTIONS_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 123450 MICROSECOND ELSE o_orderdate END"


def _with_fractions():
    return F.when(F.col("o_orderkey") % 3 == 0, F.expr("o_orderdate + INTERVAL '0.12345' SECOND")).otherwise(F.col("o_orderdate"))


@query("clean_sink_csv", f"""
    SELECT o_orderkey, coalesce(o_orderstatus, 'Unknown') AS o_orderstatus,
      strftime({_FRACTIONS_SQL}, '%Y-%m-%d %H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN '.12345' ELSE '' END AS o_orderdate
    FROM ({ORDER_GAPS_SQL})""")
def clean_sink_csv(spark, sf):
    orders = order_gaps(spark, sf).select("o_orderkey", "o_orderstatus", _with_fractions().alias("o_orderdate"))
    folder = shared_folder(spark, "cleaned-csv")
    actions = {c: {"action": "keep"} for c in orders.columns}
    T.write_cleaned(C.clean(orders, actions).data, folder, "csv")
    return T.read_csv(spark, folder)


def _session_folder(spark, sf) -> str:
    """One session record per conversation with all its turns, as JSON lines."""
    folder = shared_folder(spark, "sessions")
    said = F.struct("turn", "role", F.col("text").alias("content"))
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said"))
    first = turns.withColumn("role", F.col("said")[0]["role"]).withColumn("text", F.col("said")[0]["content"])
    k = F.col("conv_id")
    S.write_sessions(
        first.select(
            F.concat(F.lit("s"), k.cast("string")).alias("session_id"),
            F.concat("role", F.lit(".csv")).alias("name"),
            F.concat("role", F.lit(".csv")).alias("original_filename"),
            F.col("text").alias("goal"),
            F.transform("said", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("chat_history"),
            F.struct(F.concat(F.lit("/api/download/"), k.cast("string")).alias("download_url")).alias("bg_result"),
            F.when(k % 9 != 0, F.format_string("2024-01-%02dT10:00:00", k % 28 + 1)).alias("created_at"),
        ),
        folder,
    )
    return folder


@query("session_listing", """
    SELECT 's' || conv_id AS session_id, role || '.csv' AS name, role || '.csv' AS original_filename, text AS goal,
      CASE WHEN conv_id % 9 <> 0 THEN printf('2024-01-%02dT10:00:00', conv_id % 28 + 1) END AS created_at FROM conversations WHERE turn = 0""")
def session_listing(spark, sf):
    return S.list_sessions(S.read_sessions(spark, _session_folder(spark, sf), one_per_file=False))


@query("session_lookup", """
    SELECT 's' || conv_id AS session_id, arg_min(text, turn) AS goal, arg_min(role, turn) AS first_role,
      string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, '/api/download/' || conv_id AS download_url
    FROM conversations WHERE conv_id = 7 GROUP BY conv_id""")
def session_lookup(spark, sf):
    store = shared_folder(spark, "session-store")
    S.write_store(S.read_sessions(spark, _session_folder(spark, sf), one_per_file=False), store, buckets=16)
    found = S.find_in_store(spark, store, "s7")
    told = F.transform("chat_history", lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
    return found.select(
        "session_id", "goal", F.get("chat_history", F.lit(0))["role"].alias("first_role"),
        F.array_join(told, "\n").alias("history"), F.col("bg_result.download_url").alias("download_url"),
    )


@query("json_records", f"""
    SELECT o_orderkey, '{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END
      || ',"o_orderdate":"' || strftime({_FRACTIONS_SQL}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN '.123450' ELSE '' END
      || '","keys":[' || o_orderkey || ',' || o_custkey || ']}}' AS record FROM orders""")
def json_records(spark, sf):
    orders = table(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus")
    record = S.json_record("o_orderkey", status, _with_fractions().alias("o_orderdate"), F.array("o_orderkey", "o_custkey").alias("keys"))
    return orders.select("o_orderkey", record.alias("record"))


@query("header_trim", "SELECT n_nationkey, n_name, n_regionkey, c AS customers FROM nation JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def header_trim(spark, sf):
    customers = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias(" customers\t"))
    nations = table(spark, sf, "nation").withColumnRenamed("n_name", "  n_name ")
    joined = nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey")).drop("c_nationkey")
    return headers.trim_headers(joined)


@query("file_admission", """
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.b.CSV' WHEN 1 THEN 'table.xlsx' WHEN 2 THEN 'csv' WHEN 3 THEN 'notes.txt' ELSE 'old.Xls' END AS name,
      page_id % 5 IN (0, 1, 4) AND length(html) * 2000 <= 16777216 AS accepted FROM pages""")
def file_admission(spark, sf):
    k = F.col("page_id")
    name = F.when(k % 5 == 0, "a.b.CSV").when(k % 5 == 1, "table.xlsx").when(k % 5 == 2, "csv").when(k % 5 == 3, "notes.txt").otherwise("old.Xls")
    pages = table(spark, sf, "pages").select("page_id", name.alias("name"), (F.length("html") * 2000).alias("length"))
    return pages.select("page_id", "name", listing.is_accepted(F.col("name"), F.col("length")).alias("accepted"))


@query("dirty_rows", """
    SELECT count(*) AS row_count, count(*) AS ids, count(*) AS in_range, count(*) AS copies, CAST(0 AS BIGINT) AS not_empty, count(*) AS dates FROM customer""")
def dirty_rows(spark, sf):
    """One generated row per customer; what must hold for every row is counted."""
    dirty = generator.dirty_rows(table(spark, sf, "customer"), "c_custkey")
    fee = F.col("Monthly_Subscription_Fee")
    in_range = fee.between(20, 120) & F.coalesce(F.col("Age").between(18, 69), F.lit(True)) & F.col("Churned_Status").isin(0, 1)
    return dirty.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("User_ID_Hash").rlike(r"^USR_\d{6,}$")).alias("ids"),
        F.count_if(in_range).alias("in_range"),
        F.count_if(fee == F.col("Duplicated_Fee")).alias("copies"),
        F.count("Null_Column_All_Empty").alias("not_empty"),
        F.count_if(F.col("Registration_Date").rlike(r"^2025-\d\d-\d\d$")).alias("dates"),
    )
