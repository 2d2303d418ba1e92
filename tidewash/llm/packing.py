"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are cut only where they exceed the capacity. The counts of each length (at most
``capacity`` rows) are all that the driver plans on: best fit decreasing over counts, where a
step puts many equal pieces into many equal gaps at once. A planned slot is a range of ranks
among the pieces of one length; a piece finds its slot by its rank within its length, through
a join with the plan, whose size depends on the capacity and not on the corpus.

Ranks need no task that sees a whole length: each length is dealt over many numbered parts,
pieces are ranked inside a part, and the counts of the earlier parts are added.

Defined results: a null or empty text is the end id alone; repeated rows and ids are packed
as separate pieces; an empty table gives no pieces. Extra columns are not carried.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewash.llm.shared import table, written
from tidewash.llm.tokens import default_tokenizer, encoder, id_type, slices

CAPACITY = 4096
END = 1
#: Pieces of one length that one task ranks, about, when all pieces have that length.
RANKED_TOGETHER = 50_000
MIN_PARTS = 64

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal int, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents, written: ids as little-endian integers, ``deal`` deals equal lengths out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = id_type(encode.vocabulary)
        dealt = 0
        for batch in slices(batches):
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode.encode_all(batch["text"].to_pylist(), end)):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part), dealt & 0xFFFFFF, part.astype(width).tobytes()))
                    dealt += 1
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(cut, PIECES), "pieces", compression="zstd")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots for all lengths: (length, first rank, number, first sequence, offset).

    The piece of rank ``first rank + i`` goes into sequence ``first sequence + i`` at ``offset``.
    Longest first; each goes into the smallest gap that holds it, else opens a sequence.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap -> runs of sequences (first, number)
    sizes: list[int] = []
    slots, sequences = [], 0

    def keep(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                full = capacity // length
                number = max(1, left // full)
                first, sequences = sequences, sequences + number
                keep(capacity, first, number)
                continue
            gap = sizes[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            used = min(number, left)
            slots.append((length, rank, used, first, capacity - gap))
            keep(gap, first + used, number - used)
            keep(gap - length, first, used)
            rank, left = rank + used, left - used
    return slots


def ranked(parts: DataFrame) -> DataFrame:
    """``parts`` with ``rank``, from 0 and without gaps within each length."""
    n = parts.count()
    width = max(MIN_PARTS, -(-n // RANKED_TOGETHER))
    dealt = parts.withColumn("part", F.col("deal") % width)
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32", "deal")
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (
        dealt.withColumn("within", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("within"))
        .drop("part", "within", "before")
    )


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (any frame with doc_id, piece, start, length, ids_crc32, deal) with sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(
        best_fit_plan(counts, capacity), "slot_length bigint, first_rank bigint, number bigint, first_sequence bigint, offset bigint"
    )
    fits = (
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("number"))
    )
    return (
        ranked(parts).join(F.broadcast(slots), fits)
        .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
        .drop("slot_length", "first_rank", "number", "first_sequence", "rank", "deal")
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, and the ids of its pieces in order of offset."""
    member = F.struct("offset", "ids", "doc_id", "piece", "length")
    return placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(member)).alias("members")).select(
        "sequence_id", F.expr("aggregate(members, 0L, (n, m) -> n + m.length)").alias("length"),
        F.expr("aggregate(members, X'', (b, m) -> concat(b, m.ids))").alias("ids"),
        F.expr("transform(members, m -> struct(m.doc_id, m.piece, m.offset))").alias("members"),
    )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of ``docs`` with their ids and places; ``sequences`` joins them."""
    return place(pieces(docs, tokenizer or default_tokenizer(), capacity, end), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
