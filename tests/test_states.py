"""Profiles of grown tables, published versions and stored answers."""

import pytest
from pyspark.sql import functions as F

from tidewash.operators import profile as P, states
from tidewash.operators.recommend import ask_model
from tidewash.sources import publish


def counts_of(df):
    return {r.column_name: (r.row_count, r.null_count, r.null_percentage) for r in df.collect()}


def test_a_profile_reads_new_files_only(spark, tmp_path):
    def part(k, rows):
        frame = spark.range(k * 5000, k * 5000 + rows, 1, 3).select(
            "id", (F.col("id") % 7 / 2).alias("d"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 4000)).alias("s"),
            F.timestamp_micros(F.col("id") * 10**9).alias("at"), F.lit(None).cast("double").alias("none"),
        )
        frame.write.parquet(str(tmp_path / "table" / f"day={k}"))

    folder, data = str(tmp_path / "states"), str(tmp_path / "table")
    scan = lambda: spark.read.option("basePath", data).parquet(data).drop("day")
    part(0, 9000)
    assert len(states.add_states(scan(), folder)) == 3 and states.add_states(scan(), folder) == []
    old = sorted((tmp_path / "table" / "day=0").glob("part-*"))
    part(1, 4000)
    grown = scan()
    grown.count()
    kept = [(f, f.read_bytes()) for f in old]
    for f in old:  # the counted files can not be read now
        f.write_bytes(b"x")
    assert len(states.add_states(grown, folder)) == 3
    for f, content in kept:
        f.write_bytes(content)
    found, exact = states.merged_counts(spark, folder), P.column_counts(scan())
    assert counts_of(found) == counts_of(exact)
    sure = {r.column_name: r.unique_values_count for r in exact.collect()}
    for r in found.collect():
        assert abs(r.unique_values_count - sure[r.column_name]) <= 4 * 1.04 / 2 ** (states.LG_K / 2) * sure[r.column_name] + 0.5
    with pytest.raises(ValueError, match="columns"):
        states.add_states(scan().drop("s"), folder)
    for f in old[:1]:
        f.unlink()
    with pytest.raises(ValueError, match="gone"):
        states.add_states(scan(), folder)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failing_write_leaves_the_former_version(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, path)
    numbers = lambda: sorted(int(r.id) for r in publish.read_published(spark, path).collect())
    publish.publish(spark.range(5), path, fmt)
    held = publish.read_published(spark, path)
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, path, fmt)
    assert numbers() == [0, 1, 2, 3, 4] and len(publish.Published(spark, path)._names("versions")) == 1
    publish.publish(publish.read_published(spark, path).select((F.col("id").cast("bigint") + 1).alias("id")), path, fmt)  # reads what it replaces
    assert numbers() == [1, 2, 3, 4, 5] and held.count() == 5  # an earlier reader goes on
    for k in range(3):
        publish.publish(spark.range(k), path, fmt)
    assert numbers() == [0, 1]
    folder = publish.Published(spark, path)
    assert len(folder._names("versions")) == len(folder.manifests()) == publish.KEPT_VERSIONS
    folder.fs.mkdirs(folder.fs_path(folder.version("of a lost writer")))
    assert numbers() == [0, 1]
    with pytest.raises(ValueError):
        publish.publish(spark.range(1), path, kept=0)


def test_no_prompt_is_asked_twice(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        return [None if t is None else f"{t}!" for t in texts]

    rows = [(i, f"p{i % 10}") for i in range(200)] + [(900, None), (901, None), (902, "")]
    prompts = spark.createDataFrame(rows, "k int, prompt string").repartition(4)
    expected = sorted((k, p, None if p is None else f"{p}!") for k, p in rows)
    order = lambda df: sorted(map(tuple, df.select("k", "prompt", "answer").collect()))
    store = str(tmp_path / "answers")
    assert order(ask_model(prompts, model)) == expected and asked.value == 203
    asked.value = 0
    assert order(ask_model(prompts, model, store=store, rounds=3)) == expected and asked.value == 12
    more = prompts.unionByName(spark.createDataFrame([(1000, "new")], "k int, prompt string"))
    assert order(ask_model(more, model, store=store)) == sorted([*expected, (1000, "new", "new!")]) and asked.value == 13

    def failing(texts):
        if "q7" in texts:
            raise RuntimeError("no answer")
        return model(texts)

    others = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "k int, prompt string").repartition(1)
    with pytest.raises(Exception, match="no answer"):
        ask_model(others, failing, store=store, rounds=20)
    before = asked.value
    assert order(ask_model(others, model, store=store)) == [(i, f"q{i}", f"q{i}!") for i in range(20)]
    assert asked.value - 13 == 20 and before > 13  # what was answered before the failure was kept
