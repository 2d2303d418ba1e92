"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters whole records into buckets by a seeded hash; a bucket is small enough for
the memory of a task however large the corpus is. Pass two takes each bucket as one array,
shuffles it with Spark's ``shuffle`` (a seeded Fisher-Yates) and writes it. The concatenated
buckets are one uniform order of the corpus; shard ``s`` of ``k`` is the ``s``-th of ``k``
equal cuts of that order, so counts differ by one at most and slots have no gaps.

Records move once. Only DataFrame functions are used. Defined results: nulls are ordinary
values, a null text has size 1; repeated rows are separate records; an empty table gives no
shards. All columns are carried, whatever their names; they must be orderable (no maps).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import running_starts, table, whole_row, written

SHARDS = 16
SEED = 20_011
#: Text bytes that a bucket holds on average; a task needs a few times as much.
BUCKET_BYTES = 16 << 20
#: A table of bucket starts has 16 bytes a row; up to so many rows it is broadcast.
MAX_BROADCAST_BUCKETS = 2_000_000


def record_size():
    """UTF-8 bytes of the text and one byte for its end."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def shuffled_buckets(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each record as ``row`` with its ``bucket`` and its place ``pos`` in it, written to the shared folder.

    The hash takes the record's place of origin in, so that copies of one row are dealt out
    too. Array and shuffle are made and written in one task, so a task that is run again
    replaces its whole output.
    """
    total = docs.agg(F.sum(record_size())).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.spark_partition_id())
    scattered = docs.select(order.alias("order"), whole_row(docs).alias("row")).select(
        F.pmod(F.shiftright("order", 8), F.lit(buckets)).alias("bucket"), F.struct("order", "row").alias("record")
    )
    gathered = scattered.repartition("bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("pos", "record"))
    return written(mixed.select("bucket", "pos", F.col("record.row").alias("row")), "buckets")


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each record as ``row`` with its ``shard`` and its ``slot`` there."""
    mixed = shuffled_buckets(docs, seed, bucket_bytes)
    sizes = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    totals = sizes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    n_buckets, n = totals[0], totals[1] or 1
    starts = running_starts(sizes, "bucket", "rows", "start").select("bucket", "start")
    if n_buckets <= MAX_BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    placed = mixed.join(starts, "bucket").withColumn("place", F.col("start") + F.col("pos"))
    shard = F.expr(f"place * {n_shards} div {n}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select("row", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def write_shards(placed: DataFrame, path: str, **layout: str) -> None:
    """One folder per shard. Buckets are contiguous in the order, so no records move again."""
    placed.select("row", "slot", "shard").write.partitionBy("shard").options(**layout).parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
