"""Whitening against exact integers and numpy's symmetric eigenvectors."""

import math

import numpy as np
import pytest

from tidewash.llm import moments, whitening
from tidewash.llm.registry import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, row string, vector int, whitened double"


def features(vectors):
    width = max((len(v) for v in vectors), default=0)
    return [[math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v] + [1_000_000] * (width - len(v)) for v in vectors]


def expected(vectors):
    """Per row: exact deviation and the whitened vector (signs free), with the explained shares."""
    x = features(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    kept = e > 1e-13 * max(e[0], 0)
    e, v = e[kept][:32], v[:, kept][:, :32]
    return n, deviation, centred @ v / np.sqrt(e), e / np.trace(cov)


def same_up_to_sign(a, b, tolerance):
    return all(min(np.abs(x - y).max(), np.abs(x + y).max()) < tolerance for x, y in zip(a.T, b.T))


@pytest.mark.parametrize("width", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["random", "falling", "poor", "equal pairs"])
def test_eigenvectors(width, kind):
    rng = np.random.default_rng(width)
    x = rng.standard_normal((200, width))
    if kind == "falling":
        x *= np.logspace(0, -6, width)
    if kind == "poor":
        x[:, width // 2 :] = 0
    a = x.T @ x / 200
    if kind == "equal pairs":
        q = np.linalg.qr(rng.standard_normal((width, width)))[0]
        a = q @ np.diag(np.arange(width) // 2 + 1.0) @ q.T
    values, vectors = whitening.eigen(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * scale
    assert np.abs(vectors.T @ vectors - np.eye(width)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * scale


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.concatenate([np.logspace(0, -9, 15), -np.logspace(0, -9, 15)])
    sign = whitening.polar_factor(q @ np.diag(values) @ q.T)
    assert np.abs(sign - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-5  # as well as 1e-9 can be told from 0
    assert np.abs(sign @ sign - np.eye(30)).max() < 1e-12


def test_registered_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_embedding_whitening"](spark, sf)
    assert got.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"),
    ]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = expected([r.embedding for r in rows])
    out = got.orderBy("vec_id", "component").collect()
    assert len(out) == n * 32 and {r.n for r in out} == {n}
    assert [r.deviation for r in out[::32]] == deviation
    ours = np.array([r.whitened for r in out]).reshape(n, 32)
    assert same_up_to_sign(ours, white, 1e-8)
    assert np.allclose([r.explained for r in out[:32]], explained, rtol=1e-10)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-10


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [rng.normal(0, 1, 6).astype(np.float32).tolist() for _ in range(60)] + [[0.5, -0.25], [], [0.0] * 6]
    rows = list(enumerate(good)) + [(None, good[0]), (3, good[1])]  # no id, repeated id
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("-inf")] + [0.0] * 5)]
    vectors = spark.createDataFrame([(i, v, "r", 1, 0.5) for i, v in rows + bad], SCHEMA)
    fitted = whitening.fit(vectors)
    out = whitening.whiten(vectors, fitted).collect()
    n, deviation, white, explained = expected([v for _, v in rows])
    assert fitted.n == n == len(out) and np.allclose(fitted.explained, explained, rtol=1e-10)
    assert sorted((str(r.row.vec_id), r.deviation) for r in out) == sorted((str(i), d) for (i, _), d in zip(rows, deviation))
    assert {(r.row.row, r.row.vector, r.row.whitened) for r in out} == {("r", 1, 0.5)}
    assert whitening.identity_error(vectors, fitted) < 1e-10


def test_no_variance_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    same = spark.createDataFrame([(i, [0.1, 0.7], "r", 1, 0.0) for i in range(5)], SCHEMA)
    for vectors, n in ((empty, 0), (same, 5), (spark.createDataFrame([(1, None, "r", 1, 0.0)], SCHEMA), 0)):
        fitted = whitening.fit(vectors)
        assert (fitted.n, fitted.explained) == (n, [])
        assert whitening.identity_error(vectors, fitted) == 0.0
        assert [r.whitened for r in whitening.whiten(vectors, fitted).collect()] == [[]] * n


def test_large_values_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40 + 2.0**20, 3.0]), (2, [2.0**52, -(2.0**52)]), (3, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<double>")
    out = {r.row.vec_id: r.deviation for r in whitening.whiten(vectors, whitening.fit(vectors)).collect()}
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    exact = [sum((4 * a - s) ** 2 for a, s in zip(row, map(sum, zip(*x)))) for row in x]
    assert out == {i: d if d < 2**63 else None for i, d in enumerate(exact)}


def test_moments_merge_like_one_table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (500, 7))
    frame = spark.createDataFrame([(row.tolist(),) for row in x], "vector array<double>").repartition(23)
    found = moments.moments(frame)
    assert found.n == 500 and np.allclose(found.mean, x.mean(axis=0), rtol=1e-14)
    assert np.allclose(found.covariance, np.cov(x.T, bias=True), atol=1e-9)
