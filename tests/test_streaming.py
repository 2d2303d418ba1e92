"""Streams give what the batch operators give, whatever the arrival order."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewash.operators.edits import edit_requests
from tidewash.plans.actions import fold_edits
from tidewash.plans.cleaning import apply, fit
from tidewash.session import shared_folder
from tidewash.streaming import streams as S

COLUMNS = ["Age", "Fee", "Gender"]


def write_parts(spark, df, parts):
    """One file per filter, so each becomes a micro-batch of its own."""
    folder = shared_folder(spark, "input")
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.parquet(f"{folder}/part{i}")
    return folder


def stream_of(spark, folder, schema):
    return (
        spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    )


def test_clean_stream(spark):
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"), F.lit("x").alias("s"))
    folder = write_parts(spark, df, ["id < 100", "id >= 100"])
    plan = fit(df, {"v": {"action": "keep"}, "s": {"action": "drop"}})
    out = shared_folder(spark, "out")
    S.run_to_files(S.clean_stream(stream_of(spark, folder, df.schema), plan), f"{out}/rows", f"{out}/progress")
    assert sorted(map(tuple, spark.read.parquet(f"{out}/rows").collect())) == sorted(map(tuple, apply(df, plan).collect()))


def test_edit_stream_with_late_turns(spark):
    rows = [("s", t, f"{'drop' if t % 2 else 'keep'} {COLUMNS[t % 3]}") for t in range(12)] + [("r", 0, "impute age")]
    df = spark.createDataFrame(rows, "session_id string, turn int, text string")
    folder = write_parts(spark, df, ["turn >= 6", "turn between 3 and 5", "turn < 3"])
    out = shared_folder(spark, "out")
    fold = S.edits_fold(COLUMNS)
    S.fold_to_table(stream_of(spark, folder, df.schema), fold, f"{out}/rows", f"{out}/progress")
    got = {(r.session_id, r.column, r.action, r.turn) for r in S.latest_of(spark, f"{out}/rows", fold).collect()}
    want = {(r.session_id, r.column, r.action) for r in fold_edits(None, edit_requests(df, COLUMNS)).collect()}
    assert {g[:3] for g in got} == want
    assert ("s", "Gender", "drop", 11) in got and ("r", "Age", "transform", 0) in got


def test_job_states_follow_the_events(spark):
    events = [
        ("a", 1, "update", None, None, 5, "lost"), ("a", 2, "set", "processing", None, 10, "read"), ("a", 3, "update", None, None, 30, "clean"),
        ("b", 4, "set", "processing", None, 10, "read"), ("b", 5, "update", None, None, 55, "types"), ("b", 6, "set", "error", "boom", 0, ""),
        ("c", 7, "update", None, None, 99, "never set"),
    ]
    state = {}
    for session, _, kind, status, error, progress, message in events:
        if kind == "set":
            state[session] = (status, error, progress, message)
        elif session in state:
            state[session] = (*state[session][:2], progress, message)
    names = "session_id string, seq int, kind string, status string, error string, progress int, progress_msg string"
    df = spark.createDataFrame(events, names).withColumn("result", F.when(F.col("kind") == "set", F.concat(F.lit("r"), F.col("seq"))))
    folder = write_parts(spark, df, ["seq >= 5", "seq < 5"])
    out = shared_folder(spark, "out")
    S.fold_to_table(stream_of(spark, folder, df.schema), S.jobs_fold(), f"{out}/rows", f"{out}/progress")
    asked = spark.createDataFrame([(s,) for s in "abcd"], "session_id string")
    for states in (S.job_states(df), S.latest_of(spark, f"{out}/rows", S.jobs_fold())):
        got = {r.session_id: (r.status, r.error, r.progress, r.progress_msg) for r in S.state_of(states, asked).collect()}
        assert got == {"a": state["a"], "b": state["b"], "c": ("idle", None, 0, ""), "d": ("idle", None, 0, "")}
        results = {r.session_id: r.result for r in S.state_of(states, asked).collect()}
        assert results == {"a": "r2", "b": "r6", "c": None, "d": None}


def many_batches(spark, n):
    """One event a session and day; the last session goes on all the time."""
    rows = [(f"s{k}", k, "set", datetime(2024, 1, 1) + timedelta(days=k)) for k in range(n)]
    rows += [("on", 1000 + k, "set" if k == 0 else "update", datetime(2024, 1, 1) + timedelta(days=k)) for k in range(n)]
    df = spark.createDataFrame(rows, "session_id string, seq int, kind string, at timestamp").select(
        "*", F.lit("run").alias("status"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"),
        (F.col("seq") % 100).alias("progress"), F.lit("m").alias("progress_msg"),
    )
    return df, write_parts(spark, df, [F.dayofmonth("at") == k + 1 for k in range(n)])


def test_folders_are_bounded_and_keys_expire(spark):
    df, folder = many_batches(spark, 11)
    out = shared_folder(spark, "out")
    fold = S.jobs_fold("at")
    query = S.fold_to_table(stream_of(spark, folder, df.schema), fold, f"{out}/rows", f"{out}/progress", keep="4 days", compact_every=3)
    assert sum(len(p["stateOperators"]) for p in query.recentProgress) == 0 and len(query.recentProgress) >= 11
    folders = S.FoldedFolders(spark, f"{out}/rows")
    base, batches = folders.current()
    assert base == 8 and batches == [9, 10]
    held = folders.read()
    assert held.count() < 2 * 11 - 8 and len(folders._numbers("batch")) + len(folders._numbers("base")) <= 2 * 3 + 2
    got = {r.session_id: r.progress for r in S.latest_of(spark, f"{out}/rows", fold, "4 days").collect()}
    assert got == {"on": 10, **{f"s{k}": k for k in range(6, 11)}}
    everything = {r.session_id for r in S.latest_of(spark, f"{out}/rows", fold).collect()}
    assert set(got) < everything < {"on", *(f"s{k}" for k in range(11))}


def test_repeated_batch_and_broken_compaction(spark):
    df, folder = many_batches(spark, 4)
    out = shared_folder(spark, "out")
    fold = S.jobs_fold("at")
    S.fold_to_table(stream_of(spark, folder, df.schema), fold, f"{out}/rows", f"{out}/progress", compact_every=100)
    expected = sorted(map(tuple, S.job_states(df).collect()))
    assert sorted(map(tuple, S.latest_of(spark, f"{out}/rows", fold).collect())) == expected
    folders = S.FoldedFolders(spark, f"{out}/rows")
    fold.merge(folders.read()).limit(1).write.parquet(folders.base(2))
    folders.fs.delete(folders.fs_path(folders.base(2) + "/_SUCCESS"), False)  # a writer that was lost
    fold.merge(fold.rows(df)).write.mode("overwrite").parquet(folders.batch(3))  # more than the batch had, folded once more
    assert sorted(map(tuple, S.latest_of(spark, f"{out}/rows", fold).collect())) == expected
    with pytest.raises(ValueError, match="name its column"):
        S.fold_to_table(stream_of(spark, folder, df.schema), S.jobs_fold(), f"{out}/x", f"{out}/y", keep="1 day")


def test_edits_expire_by_their_messages(spark):
    rows = [("old", 0, "drop Age", datetime(2024, 1, 1)), ("new", 0, "drop Fee", datetime(2024, 3, 1)), ("new", 1, "keep Age", datetime(2024, 3, 2))]
    df = spark.createDataFrame(rows, "session_id string, turn int, text string, at timestamp")
    folder, out = write_parts(spark, df, ["turn = 0", "turn = 1"]), shared_folder(spark, "out")
    fold = S.edits_fold(COLUMNS, time="at")
    S.fold_to_table(stream_of(spark, folder, df.schema), fold, f"{out}/rows", f"{out}/progress", keep="30 days", compact_every=1)
    assert {(r.session_id, r.column) for r in S.latest_of(spark, f"{out}/rows", fold).collect()} == {("new", "Fee"), ("new", "Age")}
