import pytest
from pyspark.sql import functions as F

from tidewash.operators import charts as H


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("pos").collect()]


@pytest.fixture(scope="module")
def df(spark):
    data = [(i, f"k{i % 14:02d}", f"m{i % 15:02d}", None if i % 10 == 0 else float(i), "one" if i % 3 else None) for i in range(300)]
    return spark.createDataFrame(data, "i int, few string, many string, y double, s string").repartition(5)


def test_value_counts_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert rows(H.value_counts(df, "v", 2), "label", "value") == [("a", 2), ("b", 2)]
    assert rows(H.pie_shares(df, "v", 3), "label", "share") == [("a", 40.0), ("b", 40.0), ("c", 20.0)]
    assert rows(H.value_counts(spark.createDataFrame([(True,), (True,), (False,)], "v boolean"), "v", 9), "label", "value") == [("True", 2), ("False", 1)]


def test_few_or_many(df):
    assert H.few_valued(df, ["few", "many", "s", "y"]) == {"few", "s"} and H.few_valued(df, []) == set()


def test_bar_branches(df):
    title, means = H.chart_data(df, H.ChartSpec("bar", "T", "few", "y"), "i")
    assert title == "T (Average)" and means.count() == 14
    assert H.chart_data(df, H.ChartSpec("bar", "T", "few", "y"), "i", mode="background")[0] == "T (Avg)"
    title, raw = H.chart_data(df, H.ChartSpec("bar", "T", "many", "y"), "i")
    got = rows(raw, "label", "y")
    assert title == "T" and len(got) == 15 and got[0] == ("m01", 1.0) and got[9] == ("m11", 11.0)
    assert H.chart_data(df, H.ChartSpec("bar", "T", "many", "y"), "i", report=True)[1].count() == 12
    expected = sum(x for x in range(300) if x % 14 == 0 and x % 10) / len([x for x in range(300) if x % 14 == 0 and x % 10])
    assert rows(means, "label", "value")[0] == ("k00", pytest.approx(expected))


def test_points(df):
    assert rows(H.scatter_points(df, "few", "y", "i", limit=2), "label", "x", "x_text", "y") == [("k01", None, "k01", 1.0), ("k02", None, "k02", 2.0)]
    line = rows(H.line_points(df, "y", "i", "i"), "x", "y")
    assert len(line) == 50 and line[0] == (1.0, 1.0)
    assert H.scatter_points(df, "y", "i", "i", limit=None).count() == 270


def test_render_skips(df):
    specs = [
        H.ChartSpec("histogram", "A", "few"), H.ChartSpec("bar", "B", "ghost"), H.ChartSpec("scatter", "C", "y"),
        H.ChartSpec("bar", "D", "few", "s"), H.ChartSpec("bar", "E", "s", "ghost"), H.ChartSpec("radar", "F", "s"),
    ]
    assert {r.title for r in H.render_charts(df, specs, "i").select("title").distinct().collect()} == {"A", "C", "E", "F"}
    empty = [(r.title, r.pos, r.label) for r in H.render_charts(df, specs, "i").collect() if r.title in "CF"]
    assert sorted(empty) == [("C", None, None), ("F", None, None)]
    report = {r.title for r in H.render_charts(df, specs, "i", report=True).select("title").distinct().collect()}
    assert report == {"A", "C", "E", "F"}
    assert H.render_charts(df, [H.ChartSpec("bar", "B", "ghost")]) is None


def test_counts_and_means_take_one_pass(spark, tmp_path):
    data = [(i, float(i % 7) - 3.0, i % 5, f"k{i % 9}", None if i % 4 == 0 else i / 3, i % 2 == 0) for i in range(400)] + [(401, -0.0, None, "", None, None)]
    spark.createDataFrame(data, "i int, d double, n int, s string, y double, b boolean").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("t", F.to_timestamp_ntz(F.concat(F.lit("2024-0"), F.col("n") + 1, F.lit("-01")))).withColumn("m", F.col("d").cast("decimal(9,2)"))
    specs = [H.ChartSpec(kind, f"{kind} {x} {y}", x, y) for kind, y in (("histogram", None), ("pie", None), ("bar", None), ("bar", "y")) for x in ("d", "n", "s", "b", "t", "m")]
    for report in (False, True):
        got = H.render_charts(df, specs, "i", report).orderBy("chart_id", "pos").collect()
        for number, spec in enumerate(specs):
            title, alone = H.chart_data(df, spec, "i", report)
            expected = [(title, r.pos, r.label, pytest.approx(r.value)) for r in alone.orderBy("pos").collect()]
            assert [(r.title, r.pos, r.label, r.value) for r in got if r.chart_id == number] == expected
    items = [H._item(df, k, s, {"d", "n", "s", "b", "t"}, False, "direct") for k, s in enumerate(specs) if s.x_axis != "m"]
    assert {i.shows for i in items} == {H.COUNTS, H.MEANS}
    plan = H.grouped_charts(df, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_charts_that_fail_at_run_time(df):
    broken = df.withColumn("bad", F.when(F.col("i") == 250, F.raise_error(F.lit("no such value"))).otherwise(F.col("few")))
    broken = broken.withColumn("worse", F.when(F.col("i") == 250, F.raise_error(F.lit("no number"))).cast("double"))
    specs = [
        H.ChartSpec("histogram", "A", "few"), H.ChartSpec("pie", "B", "bad"), H.ChartSpec("bar", "C", "few", "worse"), H.ChartSpec("bar", "D", "bad", "y"),
        H.ChartSpec("scatter", "E", "few", "y"), H.ChartSpec("scatter", "F", "bad", "y"), H.ChartSpec("bar", "G", "few", "y"), H.ChartSpec("line", "H", "y", "worse"),
    ]
    for report, expected in ((False, {"A", "E", "G (Average)"}), (True, {"A", "E", "G"})):
        got = H.render_charts(broken, specs, "i", report)
        assert {r.title for r in got.collect()} == expected
        good = [s for s in specs if s.title in "AEG"]
        rows_of = lambda frame: sorted(tuple(r)[1:] for r in frame.collect())
        assert str(rows_of(got)) == str(rows_of(H.render_charts(df, good, "i", report)))


def test_suggestions():
    names = lambda columns: [(s.chart_type, s.x_axis, s.y_axis) for s in H.suggest_charts(columns)]
    assert names(["Gender", "Age"]) == [("histogram", "Age", None), ("pie", "Gender", None)]
    assert names(["First", "Monthly_Subscription_Fee"]) == [("bar", "First", "Monthly_Subscription_Fee")]
    assert names(["Monthly_Subscription_Fee", "Churned_Status"]) == [("bar", "Churned_Status", "Monthly_Subscription_Fee")]


def test_hot_value_counts(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    assert rows(H.value_counts(df, "v", 1), "label", "value") == [("-1", 6667)]


def test_suggestions_over_many_tables(spark):
    tables = {"a": ["Gender", "Age", "Age"], "b": ["First", "Monthly_Subscription_Fee"], "c": ["Monthly_Subscription_Fee", "Churned_Status"], "d": ["x"]}
    columns = spark.createDataFrame([(d, i, c) for d, cs in tables.items() for i, c in enumerate(cs)], "dataset string, pos int, column string")
    got = {(r.dataset, r.chart_type, r.x_axis, r.y_axis, r.title) for r in H.suggest_for_tables(columns).collect()}
    assert got == {(d, s.chart_type, s.x_axis, s.y_axis, s.title) for d, cs in tables.items() for s in H.suggest_charts(cs)}


def test_suggestions_sort_few_rows(spark):
    """The first name is sought among rows that were cut and merged; positions may begin anywhere, or be none."""
    specs = [H.ChartSpec("bar", "B", "x", "y"), H.ChartSpec("pie", "P", "x"), H.ChartSpec("line", "L", "z", "y")]
    tables = {1: ["n", *["w"] * 50, "y", "y"], 2: ["x", "y"], 3: ["w"], None: ["q", "y"], 5: ["y", "x", "x"], 6: ["late", "w", "y"], 7: ["below", "y"]}
    start = {6: 40, 7: -3}
    rows = [(t, start.get(t, 0) + k, name) for t, names in tables.items() for k, name in enumerate(names)] + [(8, None, "y"), (8, None, "w"), (9, 0, None), (9, 1, "y")]
    columns = spark.createDataFrame(rows, "dataset int, pos int, column string").repartition(5)
    found = H.suggest_for_tables(columns, specs)
    expected = {(t, s.title, s.x_axis if s.x_axis in names else names[0]) for t, names in tables.items() for s in specs if (s.y_axis or s.x_axis) in names}
    expected |= {(t, title, None) for t in (8, 9) for title in "BL"}
    got = [(r.dataset, r.title, r.x_axis) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    at = lambda text: next(k for k, line in enumerate(plan) if text in line)
    assert at("partial_min_by") < at("HashAggregate(keys=[dataset") and "Filter" in "".join(plan[at("partial_min_by"):])
