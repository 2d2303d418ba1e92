import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tidewash.functions.columns import value_text
from tidewash.operators import describe as D, detectors, encode, profile as P


def by(df, key, *fields):
    return {r[key]: tuple(r[f] for f in fields) if len(fields) > 1 else r[fields[0]] for r in df.collect()}


def samples_of(df, k, order_by=None):
    return {df.columns[r.pos]: r.sample_values for r in P.first_samples(df, k, order_by).orderBy("pos").collect()}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, None if i % 4 == 0 else float("nan") if i % 4 == 1 else i / 2, "a" if i < 10 else None, i % 3 == 0,
             dt.datetime(2021, 1, 1 + i % 5), "long " * 40 + str(i % 2)) for i in range(16)]
    return spark.createDataFrame(rows, "k int, d double, s string, b boolean, t timestamp_ntz, x string").repartition(4)


def test_counts(small):
    got = by(P.column_counts(small), "column_name", "row_count", "null_count", "unique_values_count")
    assert got == {"k": (16, 0, 16), "d": (16, 8, 8), "s": (16, 6, 1), "b": (16, 0, 2), "t": (16, 0, 5), "x": (16, 0, 2)}
    close = by(P.column_counts(small, approximate=True), "column_name", "null_count", "unique_values_count")
    assert {c: v[1] for c, v in close.items()} == {c: v[2] for c, v in got.items()}


def test_null_percentage(spark, small):
    assert by(P.null_counts(small), "column_name", "null_percentage")["s"] == 37.5
    one = spark.createDataFrame([(None if i == 0 else i,) for i in range(16)], "a int")
    assert P.null_counts(one).first()["null_percentage"] == 6.2
    empty = spark.createDataFrame([], "a int, b string")
    assert by(P.null_counts(empty), "column_name", "null_percentage") == {"a": 0.0, "b": 0.0}
    summary = P.schema_summary(empty).collect()
    assert [(r.null_percentage, r.unique_values_count, r.sample_values) for r in summary] == [(0.0, 0, []), (0.0, 0, [])]


def test_types_like_pandas(small):
    assert by(P.upload_profile(small, "k", names="pandas"), "name", "type") == {
        "k": "int64", "d": "float64", "s": "object", "b": "bool", "t": "datetime64[ns]", "x": "object"}


@pytest.mark.parametrize("k", [0, 1, 3])
def test_samples(spark, k):
    rows = [(i, None if i < 60 else i, 1.5 if i % 2 else None, i > 3) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, late int, half double, flag boolean").repartition(5)
    found = samples_of(df, k, "k")
    assert found == {"k": ["0", "1", "2"][:k], "late": ["60", "61", "62"][:k], "half": ["1.5"] * k, "flag": ["False"] * k}


def test_samples_in_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n" + "\n".join(str(i) for i in range(500, 0, -1)))
    df = spark.read.option("header", True).csv(str(tmp_path))
    assert samples_of(df, 3) == {"v": ["500", "499", "498"]}
    assert [r.v for r in P.preview(df, 2).collect()] == ["500", "499"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_an_unkeyed_preview_opens_one_file(spark, tmp_path, fmt):
    names = [f"{k:03d} ü" for k in range(100)]
    for k, name in enumerate(names):
        rows = spark.range(k * 40, k * 40 + 40).coalesce(1)
        rows.write.format(fmt).save(str(tmp_path / name))
    df = spark.read.format(fmt).schema("id long").load([str(tmp_path / n) for n in reversed(names)])
    expected = [str(i) for i in range(60)]
    assert [r.id for r in P.preview(df, 60).collect()] == expected
    for name in names[4:]:  # no task can read these any more
        for file in (tmp_path / name).glob("part-*"):
            file.unlink()
    assert [r.id for r in P.preview(df, 5).collect()] == expected[:5]
    assert [r.id for r in P.preview(df, 60).collect()] == expected
    assert samples_of(df, 3) == {"id": expected[:3]}
    with pytest.raises(Exception, match="FILE|exist"):
        P.preview(df, 200).collect()


def test_samples_are_no_literals(spark, tmp_path):
    spark.range(40).select(F.repeat(F.lit("x"), 100_000).alias("t"), F.lit(None).cast("string").alias("n")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    profile = P.upload_profile(df)
    assert len(profile._jdf.queryExecution().analyzed().toString()) < 20_000
    assert [[len(v) for v in r.sample_values] for r in profile.orderBy("pos").collect()] == [[100_000] * 3, []]


def test_preview(spark):
    df = spark.createDataFrame([(2, None), (1, True), (3, False)], "k int, b boolean")
    assert [tuple(r) for r in P.preview(df, 2, "k").collect()] == [("1", "True"), ("2", "")]


def test_value_text_prints_like_python(spark):
    values = [1e7, 1.5e7, 123456789.125, 1e15, 1e16, 1.25e20, 0.001, 0.0001, 0.00012, 1e-5, -3.5e-7, -1e8, 0.0, 1e100, 12.5, 1e-100, float("inf"), -123.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(value_text(F.col("x"), T.DoubleType())).collect()] == [str(v) for v in values]


def test_describe_like_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(0, 5, 301), "b": rng.integers(0, 9, 301)})
    df = spark.createDataFrame(pdf)
    got = D.describe(df).orderBy("pos").toPandas().set_index("statistic")
    want = pdf.describe().round(2)
    assert list(got.index) == list(want.index)
    assert np.allclose(got[["a", "b"]].to_numpy(), want.to_numpy(), atol=0.011)


def test_describe_times_like_pandas(spark):
    stamps = pd.Series(pd.to_datetime(["2021-01-01 00:00:00", "2021-01-03 00:00:00", "2021-01-04 12:00:01", None]))
    df = spark.createDataFrame([(None if pd.isna(s) else s.to_pydatetime(), float(i)) for i, s in enumerate(stamps)], "t timestamp_ntz, n double")
    got = D.describe(df).orderBy("pos").toPandas().set_index("statistic")
    want = pd.DataFrame({"t": stamps, "n": range(4)}).describe()
    assert list(got.index) == list(want.index)
    for s in ("min", "25%", "50%", "75%", "max", "mean"):
        assert pd.Timestamp(got.loc[s, "t"]) == want.loc[s, "t"].floor("us"), s
    assert got.loc["std", "t"] is None and got.loc["count", "t"] == "3"


def test_describe_objects_and_width(spark):
    df = spark.createDataFrame([("x", True), ("y", True), ("x", None)], "s string, b boolean")
    assert by(D.describe(df), "column_name", "count", "unique", "top", "freq") == {"s": (3, 2, "x", 2), "b": (2, 1, "True", 2)}
    wide = spark.createDataFrame([tuple(float(i) for i in range(8))], ", ".join(f"c{i} double" for i in range(8)))
    assert D.narrow_report(D.describe(wide)).columns == ["pos", "statistic", "c0", "c1", "c2", "c3", "c4"]


def test_signals(spark):
    rows = [(float(i), f"h{i}", "2021-01-%02d" % (i % 28 + 1), str(i), "ab"[i % 2], None, None if i % 2 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "n double, h string, d string, t string, c string, e string, m double")
    got = {r.column_name: {k for k, v in r.asDict().items() if v is True} for r in detectors.column_signals(df).collect()}
    assert got == {
        "n": set(), "h": {"is_identifier"}, "d": {"is_date_text", "is_categorical"}, "t": {"is_identifier", "is_number_text"},
        "c": {"is_categorical"}, "e": {"is_empty", "is_mostly_missing"}, "m": {"is_mostly_missing"}}


def test_duplicate_columns(spark):
    rows = [(i, i, None if i == 3 else i, float(i), None if i == 3 else i, 100 - i) for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d double, e int, f int").repartition(4)
    assert by(detectors.duplicate_columns(df), "column_name", "duplicate_of") == {"b": "a", "e": "c"}
    assert detectors.duplicate_columns(df.select("a", "d")).count() == 0


@pytest.mark.parametrize("small", [3, 1000])
def test_label_codes(spark, small):
    values = [None] + ["hot"] * 500 + [f"v{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(6)
    codes = {v: i for i, v in enumerate(sorted({v for v in values if v}))}
    got = encode.label_encode(df, "value", "code", small=small).collect()
    assert len(got) == len(values) and all(r.code == (codes[r.value] if r.value else None) for r in got)


def test_mode_and_dates(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert encode.column_mode(df, "v") == "a"
    assert sorted(r.v for r in encode.impute_mode(df, "v").collect()) == ["a", "a", "a", "b", "b"]
    empty = spark.createDataFrame([(None,)], "v string")
    assert encode.impute_mode(empty, "v").first().v is None
    day = spark.createDataFrame([(dt.date(2021, 3, 4),)], "d date")
    assert tuple(encode.date_parts(day, "d", F.to_date(F.lit("2021-03-14"))).first())[1:] == (2021, 3, 4, 10)
