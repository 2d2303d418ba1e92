"""Cleaning semantics on small cases worked out by hand."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewash.functions.parsing import guess_date_format, number_or_null
from tidewash.operators.recommend import actions_of, recommend_for
from tidewash.plans import cleaning as C
from tidewash.plans.cleaning import apply, clean, fit, route
from tidewash.sources.generator import dirty_table


def do(action, transformation=None):
    return {"action": action, "reason": "", "transformation": transformation}


def column(spark, values, dtype, action, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    plan = fit(df, {"v": action}, order_by="i", **more)
    out = apply(df, plan).orderBy("i")
    return [r["v"] for r in out.collect()], dict(out.dtypes)["v"], plan


@pytest.mark.parametrize("values, dtype, expected, out_type", [
    ([1, 2, 4, 5, None], "int", [1.0, 2.0, 4.0, 5.0, 3.0], "double"),
    ([1, 2, 3, 4, None], "bigint", [1.0, 2.0, 3.0, 4.0, 2.5], "double"),
    ([1.0, float("nan"), None, 3.0], "double", [1.0, 2.0, 2.0, 3.0], "double"),
    ([1, 2, 3], "int", [1, 2, 3], "int"),
    ([None, None], "double", [None, None], "double"),
    ([None, None], "string", [None, None], "double"),
    (["a", None], "string", ["a", "Unknown"], "string"),
    ([True, None], "boolean", ["True", "Unknown"], "string"),
    ([True, False], "boolean", [True, False], "boolean"),
    ([dt.datetime(2021, 1, 1), None], "timestamp_ntz", [dt.datetime(2021, 1, 1), None], "timestamp_ntz"),
])
@pytest.mark.parametrize("action", [do("keep"), do("transform"), do(None), do("strange"), do("transform", "Custom transform")])
def test_impute(spark, values, dtype, expected, out_type, action):
    assert column(spark, values, dtype, action)[:2] == (expected, out_type)


D = lambda *a: dt.datetime(*a)


@pytest.mark.parametrize("values, expected", [
    (["2021-01-01", "02/03/2021", "2021-03-01"], [D(2021, 1, 1), None, D(2021, 3, 1)]),
    (["02/03/2021", "13/02/2021"], [D(2021, 2, 3), None]),
    (["13/02/2021", "02/03/2021"], [D(2021, 2, 13), D(2021, 3, 2)]),
    (["2021-13-01", "2021-02-30"], [None, None]),
    (["2021-01-01", "2021-01-02 10:00:00"], [D(2021, 1, 1), None]),
    (["2021-01-01 10:00:00", "2021-01-02"], [D(2021, 1, 1, 10), None]),
    (["abc", "2021-01-01", "02/03/2021", "2021-01-01 10:00", "12"], [None, D(2021, 1, 1), D(2021, 2, 3), D(2021, 1, 1, 10), None]),
    ([None, "5 Jan 2021", "06 feb 2021"], [None, D(2021, 1, 5), D(2021, 2, 6)]),
    (["1600-01-01", "2021-01-01", "9999-01-01"], [None, D(2021, 1, 1), None]),
    (["2021-01-01T10:00:00.5", "2021-01-01T10:00:00"], [D(2021, 1, 1, 10, 0, 0, 500000), None]),
])
def test_dates(spark, values, expected):
    got, dtype, _ = column(spark, values, "string", do("transform", "Parse the DATE"))
    assert got == expected and dtype == "timestamp_ntz"


@pytest.mark.parametrize("values", [
    ["2021-01-05", "2021-1-6", "2021/01/07", "07.01.2021"], ["1/2/2021", "02/13/2021", "13/02/2021"],
    ["2021-03-14 02:30:00", "2021-11-07 1:5:00"], ["March 3, 2021", "april 14, 2021", "Apr 1, 2021"],
    ["20210105", "20211231", "20211301"], ["13-02-2021", "01-02-2021"], ["2021", "1999", "x"], ["2021-05", "2021-5"],
])
def test_dates_like_pandas(spark, values):
    expected = [None if pd.isna(v) else v.to_pydatetime() for v in pd.to_datetime(pd.Series(values), errors="coerce")]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert column(spark, values, "string", do("transform", "date"))[0] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


FORMATS = [
    "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d.%m.%Y", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d-%b-%Y", "%Y", "%Y-%m", "%m/%d/%Y %H:%M:%S",
    "%m/%d/%y", "%Y-%m-%d %I:%M %p", "%Y%m%dT%H:%M:%S",
]


@pytest.mark.filterwarnings("ignore")
def test_random_dates_like_pandas(spark):
    """Columns of one layout with foreign, blank, padded and lower-case values mixed in."""
    rng = random.Random(11)
    when = lambda: dt.datetime(1900, 1, 1) + dt.timedelta(seconds=rng.randint(0, 200 * 365 * 86400))
    for layout in FORMATS:
        values = [when().strftime(layout) for _ in range(5)]
        values += [when().strftime(rng.choice(FORMATS)), "abc", None, "", values[0] + " ", values[1].lower()]
        expected = [None if pd.isna(v) else v.to_pydatetime() for v in pd.to_datetime(pd.Series(values), errors="coerce")]
        assert column(spark, values, "string", do("transform", "date"))[0] == expected, layout


def test_random_numbers_like_pandas(spark):
    rng = random.Random(12)
    values = sorted({"".join(rng.choice("0123456789+-.e infx\t") for _ in range(rng.randint(0, 6))) for _ in range(5000)})
    # pandas gives up on a zero with a huge exponent and is a digit off for large ones
    values = [v for v in values if not any(c in v.lower() for c in ("e2", "e3", "e4", "e5", "e6", "e7", "e8", "e9"))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(number_or_null(F.col("v"))).collect()]
    for v, g in zip(values, got):
        want = pd.to_numeric(pd.Series([v, "zz"]), errors="coerce").iloc[0]
        assert (g is None) == pd.isna(want), v
        assert g is None or g == pytest.approx(want, rel=1e-15), v


def test_dates_of_other_types(spark):
    date = do("transform", "to datetime")
    assert column(spark, [20210101, None], "bigint", date)[0] == [D(1970, 1, 1, 0, 0, 0, 20210), None]
    assert column(spark, [-1], "bigint", date)[0] == [D(1969, 12, 31, 23, 59, 59, 999999)]
    assert column(spark, [1.5e18, 1e30], "double", date)[0] == [D(2017, 7, 14, 2, 40), None]
    assert column(spark, [True, None], "boolean", date)[0] == [None, None]
    assert column(spark, [dt.date(2021, 1, 1)], "date", date)[0] == [D(2021, 1, 1)]


NUMBERS = [" 12 ", "1e3", "+7", "1,000", "1d", "5f", "True", "", "NaN", "inf", "-Infinity", "0x1A", "1_000", ".5", "5.", "1e", "--1", "1e400", "\t5\n"]


def test_numbers_like_pandas(spark):
    expected = [None if pd.isna(v) else v for v in pd.to_numeric(pd.Series(NUMBERS), errors="coerce")]
    assert column(spark, NUMBERS, "string", do("transform", "numeric"))[:2] == (expected, "double")


@pytest.mark.parametrize("values, text, expected, out_type", [
    (["1", " 2", "+3"], "to number", [1, 2, 3], "bigint"),
    (["1", "x", "4"], "number", [1.0, None, 4.0], "double"),
    (["1", "x", "4"], "number, fill gaps", [1.0, 2.5, 4.0], "double"),
    (["1", "2"], "integer impute", [1, 2], "bigint"),
    (["9223372036854775808", "1"], "float", [9223372036854775808.0, 1.0], "double"),
    (["x", None], "numeric missing", [None, None], "double"),
])
def test_coerce(spark, values, text, expected, out_type):
    assert column(spark, values, "string", do("transform", text))[:2] == (expected, out_type)


def test_coerce_other_types(spark):
    number = do("transform", "number")
    assert column(spark, [True, False], "boolean", number)[:2] == ([True, False], "boolean")
    assert column(spark, [True, None], "boolean", number)[:2] == ([1.0, None], "double")
    assert column(spark, [3, 4], "int", number)[:2] == ([3, 4], "bigint")
    assert column(spark, [dt.datetime(1970, 1, 1, 0, 0, 1)], "timestamp_ntz", number)[:2] == ([10**9], "bigint")


@pytest.mark.parametrize("text, op", [
    ("sentiment", "date"), ("into buckets", "number"), ("Custom transform", "impute"), (None, "impute"), ("", "impute"),
    ("maintain and FILL", "number_median"), ("sometimes", "date"), ("Impute missing with mode and label encode", "impute"),
])
def test_routing(spark, text, op):
    assert route("transform", text) == op
    assert route("drop", text) == "drop"
    row = spark.createDataFrame([("transform", text)], "a string, t string").select(C.route_column(F.col("a"), F.col("t"))).first()
    assert row[0] == op


def test_unknown_names_headers_and_untouched_columns(spark):
    df = spark.createDataFrame([(1, None, None)], "` id ` int, other string, v string")
    plan = fit(df, {"ghost": do("drop"), "id": do("drop"), "v": do("keep")})
    out = apply(df, plan)
    assert out.columns == ["other", "v"] and out.first() == (None, None)
    with pytest.raises(ValueError):
        fit(spark.createDataFrame([(1, 2)], "a int, `a ` int"), {})


def test_failed_column_is_reported_and_kept(spark):
    df = spark.createDataFrame([(1, [1]), (None, [2])], "a int, l array<int>")
    for log, count in (("direct", 2), ("background", 1)):
        result = clean(df, {"l": do("transform", "x"), "a": do("transform")}, log=log)
        assert len(result.plan.messages) == count
        assert sorted(r["l"] for r in result.data.collect()) == [[1], [2]]
    assert clean(df, {"a": do("transform")}, log="background").plan.messages == ["Transformed 'a': imputed"]


def test_plan_ignores_dropped_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    path = spark.conf.get("spark.checkpoint.dir") + "/pruned"
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    cleaned = apply(stored, fit(stored, {"b": do("drop"), "c": do("keep")}))
    plan = cleaned._sc._jvm.PythonSQLUtils.explainString(cleaned._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "ReadSchema: struct<a:int,c:double>" in plan


def test_null_counts_spare_a_look(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0), (None, 7.0)], "a double, b double")
    plan = fit(df, {"a": do("keep"), "b": do("keep")}, null_counts={"a": 1, "b": 1})
    assert [s.fill for s in plan.steps] == [2.0, 6.0]


def test_end_to_end_sample(spark):
    pdf = pd.DataFrame({
        "User_ID": [1, 2, 3], "Age": [25.0, 34.0, None], "Gender": ["Male", "Female", "Male"],
        "Registration_Date": ["2021-01-01", "2021-02-01", "2021-03-01"], "Subscription_Fee": [50.0, 60.0, 70.0], "Churned": [0, 1, 0],
    })
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)],
                               "User_ID bigint, Age double, Gender string, Registration_Date string, Subscription_Fee double, Churned bigint")
    result = clean(df, actions_of(recommend_for(df, "churn")), order_by="User_ID")
    stats = result.stats.first()
    assert (stats.initial_rows, stats.initial_cols, stats.final_rows, stats.final_cols) == (3, 6, 3, 5)
    assert stats.dropped_columns == ["User_ID"] and len(stats.transformations_applied) == 3
    rows = result.data.collect()
    assert sorted(r.Age for r in rows) == [25.0, 29.5, 34.0]
    assert sorted(r.Registration_Date for r in rows) == [D(2021, 1, 1), D(2021, 2, 1), D(2021, 3, 1)]


def test_dirty_sample_and_metamorphic(spark):
    df = dirty_table(spark, 500)
    actions = actions_of(recommend_for(df, "churn"))
    result = clean(df, actions)
    assert result.plan.dropped == ["User_ID_Hash", "Customer_Profile_Name", "Duplicated_Fee", "System_Noise_Signal", "Null_Column_All_Empty"]
    cleaned = result.data
    assert cleaned.count() == 500
    again = clean(cleaned, {c: do("keep") for c in cleaned.columns})
    assert [s.op for s in again.plan.steps] == ["leave"] * len(cleaned.columns)
    row = cleaned.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cleaned.columns]).first()
    assert set(row) == {0}


def test_random_tables_like_pandas(spark):
    rng = random.Random(3)
    for _ in range(5):
        n = rng.randint(1, 40)
        a = [None if rng.random() < 0.3 else rng.uniform(-5, 5) for _ in range(n)]
        s = [None if rng.random() < 0.3 else rng.choice("xyz") for _ in range(n)]
        df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, s))], "i int, a double, s string")
        got = apply(df, fit(df, {"a": do("keep"), "s": do("keep")})).orderBy("i").collect()
        series = pd.Series(a, dtype=float)
        want = series.fillna(series.median())
        assert [r.a for r in got] == [None if pd.isna(v) else pytest.approx(v) for v in want]
        assert [r.s for r in got] == ([v or "Unknown" for v in s] if any(s) else [None] * n)


def test_guess_and_guard(spark):
    assert guess_date_format("2021-01-01").pattern == "yyyy-M-d"
    assert guess_date_format("nonsense") is None
    assert spark.range(1).select(number_or_null(F.lit("1e309"))).first()[0] is None
