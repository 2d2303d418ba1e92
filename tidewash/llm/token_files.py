"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are counted over the whole corpus and numbered by falling frequency, so the commonest
256 take one byte. A block codes each number in 1 to 4 bytes; the lengths stand apart, four
to a control byte, so a reader turns control bytes into lengths by one table lookup, gets all
places by a running sum and gathers the bytes with numpy.

Layout of a folder: ``ranks`` (rank, id, count) and ``blocks`` with one row per block (part,
block, n_docs, n_tokens, start_in_part, data), parts and blocks in ascending doc_id order. All
of a block's documents are in ``data``, little-endian:

    4 bytes "TKB1", uint32 documents, uint32 tokens, uint32 bytes of payload,
    uint8 per document: 1 if its doc_id is null, int64 per document: doc_id,
    uint32 per document: tokens, control bytes (2 bits a token, lowest first), payload

Blocks lie in Parquet files, so Spark's commit replaces the output of a task that is run
again, on any file system Spark can write. Defined results: a null or empty text is the end id
alone; null ids come first; repeated ids are separate documents; an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import running_starts, table, written
from tidewash.llm.tokens import default_tokenizer, encoder, id_type, slices
from tidewash.session import shared_folder

END = 2
BLOCK_TOKENS = 1 << 20
#: Tokens of a range of documents that one task sorts and codes, about.
PART_TOKENS = 16 << 20
MAGIC = b"TKB1"
#: Lengths of the four numbers of each control byte.
LENGTHS = np.array([[1 + (control >> shift & 3) for shift in (0, 2, 4, 6)] for control in range(256)], np.uint8)


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, payload) of unsigned 32-bit numbers."""
    numbers = numbers.astype("<u4", copy=False)
    n = len(numbers)
    lengths = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    kept = np.arange(4) < lengths[:, None]
    payload = numbers.view(np.uint8).reshape(n, 4)[kept]
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = lengths - 1
    quads = codes.reshape(-1, 4)
    return (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).tobytes(), payload.tobytes()


def decode_numbers(controls: np.ndarray, payload: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[controls].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    numbers = payload[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        numbers[longer] |= payload[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return numbers


def encode_block(doc_ids: list[int | None], sizes: list[int], numbers: np.ndarray) -> bytes:
    controls, payload = encode_numbers(numbers)
    return b"".join([
        MAGIC, struct.pack("<III", len(doc_ids), len(numbers), len(payload)),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), controls, payload,
    ])


def decode_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, tokens of each document, numbers of all)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n, size = struct.unpack_from("<III", data, 4)
    at = 16
    null = np.frombuffer(data, np.uint8, docs, at)
    ids = np.frombuffer(data, "<i8", docs, at + docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    controls = np.frombuffer(data, np.uint8, -(-n // 4), at)
    payload = np.frombuffer(data, np.uint8, size, at + len(controls))
    doc_ids = [None if gone else x for gone, x in zip(null.tolist(), ids.tolist())]
    return doc_ids, sizes, decode_numbers(controls, payload, n)


def token_table(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, n_tokens, tie (tells equal doc_ids apart) and ids of every document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = id_type(encode.vocabulary)
        tie = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            ids = encode.encode_all(batch["text"].to_pylist(), end)
            ties = pa.array(range(tie, tie + len(ids)), pa.int64())
            tie += len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(map(len, ids), pa.int64()), ties, pa.array([x.astype(width).tobytes() for x in ids], pa.binary())],
                ["doc_id", "n_tokens", "tie", "ids"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(run, "doc_id bigint, n_tokens bigint, tie bigint, ids binary"), "tokens", compression="zstd")


def ranks(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """rank, id, count: ids by falling count, then by id. As many rows as the vocabulary at most."""
    width = id_type(vocabulary)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in slices(batches):
            ids = np.frombuffer(b"".join(batch["ids"].to_pylist()), width)
            counts += np.bincount(ids, minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ordered = sorted(((r["id"], r["n"]) for r in counts), key=lambda x: (-x[1], x[0]))
    rows = [(rank, token, n) for rank, (token, n) in enumerate(ordered)]
    return tokens.sparkSession.createDataFrame(rows, "rank bigint, id bigint, count bigint")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Encodes all texts and writes ``path``/ranks and ``path``/blocks in ascending doc_id order."""
    tokenizer = tokenizer or default_tokenizer()
    known = encoder(tokenizer).vocabulary
    vocabulary, width = max(known, end + 1), id_type(known)
    tokens = token_table(docs, tokenizer, end)
    order = ranks(tokens, vocabulary)
    rank_of = np.zeros(vocabulary, np.uint32)
    for r in order.collect():
        rank_of[r["id"]] = r["rank"]
    order.coalesce(1).write.parquet(f"{path}/ranks")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, sizes, texts, block, before, held = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            data = encode_block(doc_ids, sizes, rank_of[np.frombuffer(b"".join(texts), width)])
            values = [part, block, len(doc_ids), held, before, data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "block", "n_docs", "n_tokens", "start_in_part", "data"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in slices(batches):
            for doc_id, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                doc_ids.append(doc_id)
                sizes.append(n)
                texts.append(ids)
                held += n
                if held >= BLOCK_TOKENS:
                    yield row()
                    doc_ids, sizes, texts, block, before, held = [], [], [], block + 1, before + held, 0
        if doc_ids:
            yield row()

    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // PART_TOKENS))
    sorted_tokens = tokens.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = sorted_tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        code, "part int, block int, n_docs bigint, n_tokens bigint, start_in_part bigint, data binary"
    )
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, and its ids (32-bit, little-endian)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = running_starts(sizes, "part", "n", "start").select("part", "start")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            doc_ids, n_tokens, numbers = decode_block(batch["data"][0].as_py())
            ids = by_rank[numbers]
            ends = np.cumsum(n_tokens, dtype=np.int64)
            begins = ends - n_tokens
            texts = [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
            columns = [
                pa.array(doc_ids, pa.int64()), pa.array(begins + batch["first"][0].as_py()), pa.array(n_tokens.astype(np.int64)),
                pa.array([zlib.crc32(x) for x in texts], pa.int64()),
                pa.array([x.tobytes() if keep_ids else None for x in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # One row per range of documents: 16 bytes for each PART_TOKENS tokens.
    placed = blocks.join(F.broadcast(starts), "part").select((F.col("start") + F.col("start_in_part")).alias("first"), "data")
    decoded = placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return decoded if keep_ids else decoded.drop("ids")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, keep_ids=False)
