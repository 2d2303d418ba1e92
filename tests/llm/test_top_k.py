"""Exact top-k against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewash.llm import top_k

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int"


def brute(rows, k, every):
    def features(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(64 * float(np.float32(x))) for x in v]

    kept = [(i, features(v)) for i, v in rows if i is not None and features(v) is not None]
    queries = {}
    for i, f in kept:
        if i % every == 0:
            queries[i] = min(queries.get(i, f), f)
    out = []
    for q, f in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(f, g)), i) for i, g in kept if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, dim, spread, block, shard", [(900, 8, 0.4, 17, 300), (500, 3, 0.02, 1000, 90), (12, 4, 1.0, 5, 100)])
def test_equals_brute_force(spark, n, dim, spread, block, shard):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread, dim)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, [1.0, None]), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim), (None, [1.0] * dim)]
    rows += [(5, rows[0][1]), (20, [0.5] * dim), (40, [0.25]), (60, [])]  # repeated ids, short vectors
    frame = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    got = top_k.top_k(frame, F.col("vec_id") % 20 == 0, 7, block, shard).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7, 20)


def test_blocks_keep_their_size(spark):
    ids = spark.range(300_000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE id * 100003 % 7000001 * 1000 + 1 END AS vec_id").distinct()
    edges = top_k.block_edges(ids, 1000)
    values = np.sort(ids.toPandas()["vec_id"].to_numpy())
    sizes = np.diff([0, *np.searchsorted(values, edges[1:-1], side="right"), len(values)])
    assert sizes.sum() == len(values) and sizes.max() <= 1100 and len(sizes) >= 270
    assert top_k.block_edges(ids.limit(900), 1000) == [None, None]


def test_empty_and_large_values(spark):
    assert top_k.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [3e7, 1.0])]
    frame = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in top_k.top_k(frame, F.col("vec_id") == 0, 3).collect()) == brute(rows, 3, 20)


def test_pruning_visits_few_leaves():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(c, 0.5, (500, 4)) for c in (-50, 0, 50, 100)]).round()
    found = top_k.search(rows, np.arange(2000), rows[1990:1991], np.array([1990]), np.array([-np.inf]), 5)
    scores = rows @ rows[1990]
    scores[1990] = -np.inf
    assert sorted(found[2], reverse=True) == sorted(scores, reverse=True)[:5]
