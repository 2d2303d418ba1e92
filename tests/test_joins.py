"""Joins with a hot key, and mentions in long sessions, against plain Python."""

import pytest
from pyspark.sql import functions as F

from tidewash.operators import joins
from tidewash.operators.edits import edit_requests, mentioned_columns
from tidewash.plans.actions import resolve_names


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows, equal ones, belong to one key and lie in one partition; some have no key."""
    rows = [("hot", "same") for _ in range(3000)] + [(f"k{i % 500}", f"v{i}") for i in range(5500)] + [(None, "none")] * 500
    return spark.createDataFrame(rows, "key string, value string").coalesce(1)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_spread_join_is_a_join(spark, facts, how, hot_rows):
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("gone", 4), (None, 5)], "key string, n int")
    got = joins.spread_join(facts, table, ["key"], how, hot_rows=hot_rows)
    expected = facts.join(table, "key", how)
    assert sorted(map(str, map(tuple, got.select(*expected.columns).collect()))) == sorted(map(str, map(tuple, expected.collect())))
    tested = joins.spread_join(facts, table, ["key"], condition=F.col("n") > 1, hot_rows=hot_rows)
    assert tested.count() == 3000 + 11


def test_equal_rows_of_a_hot_key_spread_over_all_slots(spark, facts):
    slots = joins.hot_slots(facts, ["key"], 100)
    assert [tuple(r) for r in slots.collect()] == [("hot", 30)]
    table = spark.createDataFrame([("hot", 1)], "key string, n int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.spread_join(facts, table, ["key"], hot_rows=100)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 3000 and len(sizes) >= 7 and max(sizes) < 1200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mentions_of_sessions_with_tables_of_their_own(spark):
    names = {"a": ["Age", "age group", "Fee"], "b": ["Größe", "x"], "c": []}
    texts = ["drop AGE GROUP and fee", "keep größe", "hello age", "remove x", "encode nothing", None]
    messages = [(s, t, text) for s in (*names, None) for t, text in enumerate(texts)] + [("a", 100 + k, "drop age") for k in range(300)]
    frame = spark.createDataFrame(messages, "session_id string, turn int, text string")
    columns = spark.createDataFrame([(s, i, c) for s, cs in names.items() for i, c in enumerate(cs)], "session_id string, pos int, column string")
    got = sorted((r.session_id, r.turn, r.column, r.action) for r in edit_requests(frame, columns).collect())
    expected = []
    for session, columns_of in names.items():
        own = frame.filter(F.col("session_id") == session).withColumn("found", mentioned_columns(F.col("text"), columns_of))
        single = {(r.turn, r.column): r.action for r in edit_requests(own.drop("found"), columns_of).collect()} if columns_of else {}
        expected += [(session, turn, column, action) for (turn, column), action in single.items()]
    assert got == sorted(expected) and len(got) > 300
    edits = spark.createDataFrame([("a", 0, "AGE"), ("a", 1, "none"), (None, 2, "Fee")] + [("a", 3, "fee")] * 50, "session_id string, turn int, column string")
    spelled = [(r.session_id, r.turn, r.column) for r in resolve_names(edits, columns).collect()]
    assert sorted(spelled, key=str) == sorted([("a", 0, "Age"), ("a", 1, "none"), (None, 2, "Fee")] + [("a", 3, "Fee")] * 50, key=str)
