"""Streams over the given tables, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewash.plans import cleaning as C
from tidewash.session import shared_folder
from tidewash.streaming import streams as S
from workload.edits import _COLUMNS, _LIST_EDITS
from workload.registry import query, table

BATCHES = 4


def _stream(spark, sf, name, folder, key):
    """A table as a stream of several batches, dealt out by a key's hash, so that later rows come early, too."""
    rows = table(spark, sf, name)
    rows.repartition(BATCHES, key).write.parquet(f"{folder}/{name}")
    return S.read_stream(spark, f"{folder}/{name}", "*.parquet", rows.schema, files_per_batch=1)


@query("clean_stream", """
    WITH m AS (SELECT median(o_totalprice) AS p FROM orders)
    SELECT o_orderkey, CAST(o_custkey AS DOUBLE) + CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END AS o_custkey,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderkey % 7 = 0 THEN p ELSE o_totalprice END AS o_totalprice FROM orders, m""")
def clean_stream(spark, sf):
    """A plan fitted on a table without gaps, applied in several batches to rows with gaps and decimals."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderdate")
    later = orders.select(
        "o_orderkey", F.concat("o_custkey", F.when(k % 3 == 0, ".5").otherwise("")).alias("o_custkey"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
    )
    folder = shared_folder(spark, "clean-stream")
    later.repartition(4, "o_orderkey").write.parquet(f"{folder}/later")
    actions = {
        "o_custkey": {"action": "transform", "transformation": "convert to number"}, "o_orderstatus": {"action": "keep"},
        "o_totalprice": {"action": "keep"}, "o_orderdate": {"action": "drop"},
    }
    plan = C.fit(orders, actions, later_rows=True)
    stream = S.read_stream(spark, f"{folder}/later", "*.parquet", later.schema, files_per_batch=1)
    S.run_to_files(S.clean_stream(stream, plan), f"{folder}/rows", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/rows")


@query("edit_stream", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id, "column" ORDER BY turn DESC) AS n FROM ({_LIST_EDITS}))
    SELECT session_id, "column", action, reason, transformation, turn FROM r WHERE n = 1""")
def edit_stream(spark, sf):
    t = F.col("turn")
    ask = (
        F.when(t % 5 == 0, "Please DROP ").when(t % 5 == 1, "retain ").when(t % 5 == 2, "Encode ")
        .when(t % 5 == 3, "explain why not ").otherwise("drop and keep ")
    )
    names = F.array(*[F.lit(n) for n in ("user_id", "Age", "gender", "registration_date", "fees")])
    folder = shared_folder(spark, "edit-stream")
    messages = _stream(spark, sf, "conversations", folder, "turn").select(
        F.col("conv_id").alias("session_id"), "turn",
        F.concat(ask, F.get(names, ((F.col("conv_id") + t) % 5).cast("int")), F.lit(" "), F.col("text")).alias("text"),
    )
    fold = S.edits_fold(_COLUMNS)
    S.fold_to_table(messages, fold, f"{folder}/rows", f"{folder}/progress", compact_every=2)
    return S.latest_of(spark, f"{folder}/rows", fold)


_JOB_EVENTS_SQL = """SELECT user_id % 50 AS session_id, event_id AS seq, CASE WHEN event_type IN ('signup', 'error') THEN 'set' ELSE 'update' END AS kind,
    event_type AS status, CASE WHEN event_type = 'error' THEN props END AS error, CASE WHEN event_type = 'signup' THEN props END AS result, CAST(event_id % 100 AS INTEGER) AS progress, props AS progress_msg FROM events"""


@query("job_states", f"""
    WITH e AS ({_JOB_EVENTS_SQL}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM e WHERE kind = 'set') WHERE n = 1),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM e WHERE kind = 'update') WHERE n = 1),
    s AS (SELECT DISTINCT 's' || (user_id % 70) AS session_id, user_id % 70 AS k FROM events)
    SELECT s.session_id, coalesce(b.status, 'idle') AS status, b.result, b.error,
      CASE WHEN b.seq IS NULL THEN 0 WHEN u.seq > b.seq THEN u.progress ELSE b.progress END AS progress,
      CASE WHEN b.seq IS NULL THEN '' WHEN u.seq > b.seq THEN u.progress_msg ELSE b.progress_msg END AS progress_msg
    FROM s LEFT JOIN b ON b.session_id = s.k LEFT JOIN u ON u.session_id = s.k""")
def job_states(spark, sf):
    """Sessions of which some have no job are asked for; events of one session come in several batches."""
    session = lambda n: F.concat(F.lit("s"), (F.col("user_id") % n).cast("string")).alias("session_id")
    kind = F.when(F.col("event_type").isin("signup", "error"), "set").otherwise("update")
    folder = shared_folder(spark, "job-states")
    events = _stream(spark, sf, "events", folder, "event_id").select(
        session(50), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.when(F.col("event_type") == "signup", F.col("props")).alias("result"),
        (F.col("event_id") % 100).cast("int").alias("progress"), F.col("props").alias("progress_msg"),
    )
    fold = S.jobs_fold("ts")
    S.fold_to_table(events, fold, f"{folder}/rows", f"{folder}/progress", compact_every=2)
    asked = table(spark, sf, "events").select(session(70)).distinct()
    return S.state_of(S.latest_of(spark, f"{folder}/rows", fold), asked)
