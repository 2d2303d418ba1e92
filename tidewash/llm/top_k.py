"""Exact top-k by integer inner product, with a ball tree in every shard.

The stated queries go through in blocks of bounded size; each block is broadcast to all
shards, so no pair of vectors is ever shuffled. A shard of a few thousand vectors is one
task: it builds a ball tree, drops subtrees whose upper bound q·c + |q|r is below a query's
k-th score so far, and visits the remaining leaves in falling order of their bound, each
visit raising the k-th score for the next. The first k-th scores come from a pilot of
vectors that all shards share. Bounds at the k-th score are kept, so ties are exact.

Defined results: vectors that are null or hold null or non-finite components, and rows
without vec_id, take no part; shorter vectors count as padded with zeros; a query never
meets rows of its own vec_id; other repeated rows are separate candidates, repeated queries
with one vec_id are one (that with the smallest vector); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewash.llm.shared import table, written
from tidewash.session import shared_folder

K = 20
SCALE = 64
QUERY_EVERY = 20
SHARD_ROWS = 8192
LEAF_ROWS = 256
#: Queries broadcast at a time: 64 components of 8 bytes make 8 MB.
BLOCK_QUERIES = 16_384
PILOT_ROWS = 1024
EXACT = float(2**53)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and integer features (as doubles) of the vectors that take part."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    features = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), features.alias("features")
    )


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """The vectors of a list column, padded with zeros to ``width`` or the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; doubles where they are exact, 64-bit integers beyond."""
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
    if most < EXACT:
        return left @ right.T
    return left.astype(np.int64) @ right.astype(np.int64).T


def ball_tree(rows: np.ndarray, leaf: int = LEAF_ROWS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None, list[np.ndarray]]]:
    """Levels from the root: (centers, radii, parent of each node, rows of each node); the last holds leaves."""
    levels = []
    nodes, parents = [np.arange(len(rows))], None
    while True:
        centers = np.array([rows[x].mean(axis=0) for x in nodes])
        radii = np.array([np.sqrt(((rows[x] - c) ** 2).sum(axis=1).max()) for x, c in zip(nodes, centers)])
        levels.append((centers, radii, parents, nodes))
        if max(map(len, nodes)) <= leaf:
            return levels
        below, from_ = [], []
        for k, x in enumerate(nodes):
            spread = rows[x]
            far = spread[((spread - centers[k]) ** 2).sum(axis=1).argmax()]
            other = spread[((spread - far) ** 2).sum(axis=1).argmax()]
            order = x[np.argsort(spread @ (other - far), kind="stable")]
            halves = [order[: len(order) // 2], order[len(order) // 2 :]] if len(order) > 1 else [order]
            below += halves
            from_ += [k] * len(halves)
        nodes, parents = below, np.array(from_)


def best_of(q: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best (score falling, then vec_id), queries ascending."""
    order = np.lexsort((vec_id, -score, q))
    first = np.concatenate([[True], q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    return order[rank < k]


def search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int = K):
    """(query number, vec_id, score) of each query's ``k`` best in this shard among those that reach ``floor``."""
    q, vec_id, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
    levels = ball_tree(rows)
    norms = np.sqrt((queries**2).sum(axis=1))
    kth = floor.astype(np.float64).copy()
    bound = np.full((len(queries), 1), np.inf)
    for centers, radii, parents, _ in levels:
        own = queries @ centers.T + norms[:, None] * radii
        own += np.abs(own) * 1e-9 + 1
        bound = np.minimum(own, bound if parents is None else bound[:, parents])
        bound[bound < kth[:, None]] = -np.inf
    leaves = levels[-1][3]
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(leaves)):  # each query's next best leaf
        leaf_of = order[:, turn]
        best = bound[np.arange(len(queries)), leaf_of]
        going = np.flatnonzero((best >= kth) & (best > -np.inf))
        if not len(going):
            break
        new = [(q, vec_id, score)]
        for leaf in np.unique(leaf_of[going]).tolist():
            asked = going[leaf_of[going] == leaf]
            members = leaves[leaf]
            found = products(queries[asked], rows[members])
            a, b = np.nonzero(found >= kth[asked][:, None])
            other = ids[members][b] != query_ids[asked][a]
            a, b = a[other], b[other]
            new.append((asked[a], ids[members][b], found[a, b]))
        q, vec_id, score = (np.concatenate(x) for x in zip(*new))
        kept = best_of(q, score, vec_id, k)
        q, vec_id, score = q[kept], vec_id[kept], score[kept]
        ends = np.flatnonzero(np.concatenate([q[1:] != q[:-1], [True]])) if len(q) else np.zeros(0, np.int64)
        full = np.diff(np.concatenate([[-1], ends])) == k
        kth[q[ends[full]]] = np.maximum(kth[q[ends[full]]], score[ends[full]])
    return q, vec_id, score


def block_edges(asked: DataFrame, block: int) -> list[float | None]:
    """Ends of ranges of vec_id that hold about ``block`` queries each, a tenth more at most; vec_id is unique there."""
    n = asked.count()
    if n <= block:
        return [None, None]
    cuts = asked.approxQuantile("vec_id", [j * block / n for j in range(1, math.ceil(n / block))], 0.04 * block / n)
    return [None, *sorted(set(cuts)), None]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK_QUERIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for every row of ``vectors`` that meets ``is_query``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("features").alias("features"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    # The pilot is a bounded sample; it only sets where the search begins.
    pilot = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT_ROWS).toArrow()
    pilot_ids, pilot_rows = pilot["vec_id"].to_numpy(), matrix(pilot["features"])

    def first_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch["vec_id"].to_numpy(), matrix(batch["features"], pilot_rows.shape[1])
            for at in range(0, len(ids), 1024):
                part = slice(at, at + 1024)
                found = products(asked[part], widened(pilot_rows, asked.shape[1])).astype(np.float64)
                found[ids[part][:, None] == pilot_ids[None, :]] = -np.inf
                kth = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] >= k else np.full(len(found), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].slice(at, 1024), batch["features"].slice(at, 1024), pa.array(kth)], ["vec_id", "features", "floor"]
                )

    asked = written(queries.mapInArrow(first_floor, "vec_id bigint, features array<double>, floor double"), "queries")
    edges = block_edges(asked, block)
    path = shared_folder(spark, "top-k")
    found_type = "query_id bigint, vec_id bigint, score bigint"
    dealt = rows.repartition(shards)
    for low, high in zip(edges, edges[1:]):
        part = asked
        if low is not None:
            part = part.where(F.col("vec_id") > low)
        if high is not None:
            part = part.where(F.col("vec_id") <= high)
        held = part.toArrow()  # one block of queries
        ids, features, floor = held["vec_id"].to_numpy(), matrix(held["features"]), held["floor"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, features, floor))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, query_rows, floors = sent.value
            shard = [(b["vec_id"].to_numpy(), matrix(b["features"])) for b in batches if b.num_rows]
            if not shard or not len(query_ids):
                return
            width = max(query_rows.shape[1], *(x.shape[1] for _, x in shard))
            rows_ = np.concatenate([widened(x, width) for _, x in shard])
            q, vec_id, score = search(rows_, np.concatenate([x for x, _ in shard]), widened(query_rows, width), query_ids, floors, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[q]), pa.array(vec_id), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"]
            )

        dealt.mapInArrow(run, found_type).write.mode("append").parquet(path)
        sent.unpersist()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(found_type).parquet(path).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS f
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.f, c.f), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
