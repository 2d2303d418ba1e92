"""Exact quantiles: both ways give what numpy gives, also on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewash.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def _frames():
    rng = np.random.default_rng(5)
    n = 5003
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 1e6, n))
    two = np.where(rng.random(n) < 0.5, 1.0, 2.0)
    outlier = rng.random(n)
    outlier[0], outlier[1] = 1e300, -1e300
    return pd.DataFrame({
        "unique": rng.permutation(n).astype(float), "hot": hot, "two": two, "outlier": outlier,
        "same": np.full(n, 3.5), "gaps": np.where(rng.random(n) < 0.6, np.nan, rng.random(n)),
        "infinite": np.where(rng.random(n) < 0.2, np.inf, rng.random(n)),
    })


@pytest.mark.parametrize("direct_rows, inside_rows", [(10**6, 10**5), (10, 10**5), (10, 200), (10, 1)])
def test_against_numpy(spark, direct_rows, inside_rows):
    pdf = _frames()
    df = spark.createDataFrame(pdf).repartition(7)
    values = {c: F.nanvl(F.col(c), F.lit(None)) for c in pdf.columns}
    found = exact_quantiles(df, values, PROBS, direct_rows=direct_rows, inside_rows=inside_rows)
    for c in pdf.columns:
        ordered = np.sort(pdf[c].dropna().to_numpy())
        for p, q in zip(PROBS, found[c]):
            place = p * (len(ordered) - 1)
            low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            assert q == low if low == high else q == pytest.approx(low + (high - low) * (place % 1), rel=1e-12)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(None, 4.0)], "a double, b double")
    assert exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5]) == {"a": [None], "b": [4.0]}
    assert exact_quantiles(df, {}, [0.5]) == {}


def test_wrong_counts_are_noticed(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    with pytest.raises(ValueError):
        exact_quantiles(df, {"a": F.col("a")}, [1.0], counts={"a": 5000}, direct_rows=10, inside_rows=10)


def test_two_scans_whatever_the_data(spark):
    read = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(1)
    n = 20_000
    near = 1.0 + rng.integers(0, n, n) * 2.0**-52  # all in one cell, many apart by one bit
    both = np.concatenate([rng.choice([-1.0, 1.0], n // 2) * np.exp(rng.normal(0, 80, n // 2)), rng.integers(0, 9, n // 2)])

    def scan(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pdf = pd.DataFrame({"near": near, "both": rng.permutation(both), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 1, n))})
    source = spark.createDataFrame(pdf).repartition(5)
    df = source.mapInArrow(scan, source.schema)
    counts = dict.fromkeys(pdf.columns, n)
    for inside in (10**6, 50):
        read.value = 0
        found = exact_quantiles(df, {c: F.col(c) for c in pdf.columns}, PROBS, counts, direct_rows=10, inside_rows=inside)
        assert read.value == 2 * n
        direct = exact_quantiles(source, {c: F.col(c) for c in pdf.columns}, PROBS, counts, direct_rows=10**6)
        assert repr(found) == repr(direct)


def test_extreme_values(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.7976931348623157e308, float("nan"), 1.0, -1.0] * 9
    df = spark.createDataFrame([(v,) for v in values], "a double")
    ask = lambda direct, inside: repr(exact_quantiles(df, {"a": F.col("a")}, [k / 60 for k in range(61)], None, direct, inside)["a"])
    assert ask(10, 10**5).replace("-0.0,", "0.0,") == ask(10, 1).replace("-0.0,", "0.0,") == ask(10**6, 1).replace("-0.0,", "0.0,")


def test_both_ways_agree_to_the_last_bit(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"v": rng.normal(0, 1e3, 1001), "w": np.where(rng.random(1001) < 0.3, -np.inf, rng.random(1001))}))
    probabilities = [k / 96 for k in range(97)]
    values = {c: F.col(c) for c in df.columns}
    counts = dict.fromkeys(df.columns, 1001)
    direct = exact_quantiles(df, values, probabilities, counts, direct_rows=10**6)
    cornered = exact_quantiles(df, values, probabilities, counts, direct_rows=10, inside_rows=200)
    assert repr(direct) == repr(cornered)
