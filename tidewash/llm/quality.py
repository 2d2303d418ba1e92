"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

Every word, and every shape of a word (case, marks at its ends, length, whether it repeats the
word before), has a bucket; every bucket a fixed sparse random index vector. A bucket's vector
is its index vector plus those of its neighbours, summed over all documents (random indexing: no
matrix is factorised): a task sums whole numbers in one table, and tasks add those up. A document is the mean of the vectors of its words and of
its shapes, over the whole text. A small network, trained with numpy on the driver, turns that
into a probability, calibrated by one temperature on labelled rows kept from the training.

The network learns from at most ``max_labelled`` labelled documents (those with the smallest hash
of their id; of rows with one id, one); scoring is one pass without a shuffle. A text over some
megabytes is gone through in portions; its neighbours across their edges are not counted.
Labels, lang, source and doc_id are no inputs of a score. Defined results: a null or empty
text has the zero vector and the score of that; a null doc_id counts as the empty text in
crc32; of several labels of one id the lowest counts; without both labels in the training rows
every score is the share of ones (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import table, whole_row
from tidewash.llm.tokens import SLICE_BYTES, slices
from tidewash.llm.word_hashes import NOT_BLANK, Words, mixed

MAX_LABELLED = 20_000
BUCKETS = 1 << 14
DIMENSIONS = 48
NONZERO = 4
WINDOW = 2
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
#: Labelled rows with this remainder are not for training; one in VALIDATION of the others calibrates.
HELD_OUT_OF = 5
VALIDATION = 5
SEED = 7
#: Tasks that add up the tables of all tasks; the driver adds up theirs, of 1 to 6 MB each.
MERGERS = 16
#: Texts whose neighbours are summed at a time.
TABLE_BYTES = 1 << 20
BLANK = re.compile(rb"[\t-\r ]")


@functools.cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def bucketed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, word bucket, shape bucket) of every word."""
    words = Words(texts, NOT_BLANK)
    chars, starts, sizes = words.chars, words.starts, words.sizes
    ends = starts + sizes - 1
    kind = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 stop or comma, 4 other mark, 5 non-ASCII
    for c in range(128):
        x = chr(c)
        kind[c] = 0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 3 if x in ".,;:!?" else 4
    inner = kind[chars[starts + np.minimum(1, sizes - 1)]]
    again = np.zeros(len(starts), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
    before_last = chars[starts + np.maximum(sizes - 2, 0)]
    shape = kind[chars[starts]].astype(np.uint64)
    for part, base in ((inner, 6), (kind[chars[ends]], 6), (kind[before_last], 6), (again, 2), (np.minimum(sizes // 4, 7), 8)):
        shape = shape * np.uint64(base) + part.astype(np.uint64)
    # Which mark ends a word tells more than that one does.
    mark = np.where(kind[chars[ends]] >= 3, chars[ends], 0).astype(np.uint64)
    shape = mixed((shape << np.uint64(8) | mark) + np.uint64(1) << np.uint64(20))
    low = np.uint64(BUCKETS // 2 - 1)
    return words.text, (words.hashes & low).astype(np.int64), (shape & low).astype(np.int64) + BUCKETS // 2


def neighbour_sums(texts: list[str | None], sums: np.ndarray) -> None:
    """Adds to each bucket's row the index vectors of the buckets up to WINDOW words away."""
    places, signs = index_vectors()
    text, word, shape = bucketed(texts)
    flat = sums.reshape(-1)
    for distance in range(1, min(WINDOW, max(len(text) - 1, 0)) + 1):
        near = text[distance:] == text[:-distance]
        for mine in (word, shape):
            for theirs in (word, shape):
                a, b = mine[distance:][near], theirs[:-distance][near]
                for x, y in ((a, b), (b, a)):
                    flat += np.bincount((x[:, None] * DIMENSIONS + places[y]).ravel(), weights=signs[y].ravel(), minlength=len(flat))


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        long = [k for k, text in enumerate(texts) if len(text or "") > SLICE_BYTES]
        if not long:
            return self._features(texts)
        out = self._features([None if len(text or "") > SLICE_BYTES else text for text in texts])
        for k in long:
            sums, n = np.zeros(out.shape[1] - 1), 0
            for portion, words_before in portions(texts[k].encode(), SLICE_BYTES):
                part = self._features([portion.decode()], words_before)[0]
                words = round(np.expm1(part[-1]))
                sums, n = sums + part[:-1] * words, n + words
            out[k] = [*(sums / max(n, 1)), np.log1p(n)]
        return out

    def _features(self, texts: list[str | None], skip: int = 0) -> np.ndarray:
        """Features of texts; the first ``skip`` words only stand before the others."""
        text, word, shape = (x[skip:] for x in bucketed(texts))
        n = np.bincount(text, minlength=len(texts)).astype(np.float64)[: len(texts)]
        pooled = []
        for buckets in (word, shape):
            sums = np.zeros((len(texts), self.vectors.shape[1]), np.float64)
            firsts = np.flatnonzero(np.diff(text, prepend=-1))
            if len(firsts):
                # One text at a time keeps the gathered vectors of a very long text in bounds.
                for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(text)]):
                    counts = np.bincount(buckets[a:b], minlength=1)
                    used = np.flatnonzero(counts)
                    sums[text[a]] = counts[used] @ self.vectors[used]
            pooled.append(sums / np.maximum(n, 1)[:, None])
        return np.hstack([*pooled, np.log1p(n)[:, None]])

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        hidden = np.maximum((features - self.mean) / self.spread @ w1 + b1, 0)
        return hidden @ w2 + b2[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -30, 30)))


def portions(raw: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A text cut at blanks about every ``size`` bytes; each portion but the first after the word before it (1, else 0)."""
    at, before = 0, b""
    while at < len(raw):
        blank = BLANK.search(raw, at + size)
        to = blank.start() if blank else len(raw)
        yield before + raw[at:to], 1 if before else 0
        words = raw[at:to].rstrip()
        before = words[max(words.rfind(x) for x in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")) + 1 :] or before
        at = to


def train_network(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the log loss, with small weight decay."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            w1, b1, w2, b2 = layers
            hidden = x[rows] @ w1 + b1
            active = np.maximum(hidden, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ w2 + b2[0], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (hidden > 0)
            gradients = [x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), active.T @ error + 1e-4 * w2, np.array([error.sum()])]
            step += 1
            rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    def loss(t: float) -> float:
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return min(np.geomspace(0.25, 8, 61).tolist(), key=loss) if len(y) else 1.0


def id_hash(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id, text, quality of the training documents; the ids are few enough to broadcast."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.where(id_hash(F.col("doc_id")) % HELD_OUT_OF != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = chosen.select(F.col("doc_id").alias("labelled"), "quality")
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("quality").alias("quality"))


def all_neighbours(docs: DataFrame) -> np.ndarray:
    """``neighbour_sums`` over all rows: one table a task, added up by MERGERS tasks and the driver."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIMENSIONS))
        for batch in slices(batches, 1 << 16, TABLE_BYTES):
            texts = batch["text"].to_pylist()
            for text in texts:
                if len(text or "") > SLICE_BYTES:
                    for portion, _ in portions(text.encode(), SLICE_BYTES):
                        neighbour_sums([portion.decode()], sums)
            neighbour_sums([text for text in texts if len(text or "") <= SLICE_BYTES], sums)
        yield packed(TaskContext.get().partitionId(), sums)

    def packed(part: int, sums: np.ndarray) -> pa.RecordBatch:
        """Whole numbers; most buckets of a small part are empty, so they are compressed before they move."""
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [zlib.compress(sums.astype("<i8").tobytes(), 1)]})

    def unpacked(held: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(held), "<i8").reshape(BUCKETS, DIMENSIONS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIMENSIONS))
        for batch in batches:
            for held in batch["sums"]:
                sums += unpacked(held.as_buffer())
        if sums.any():
            yield packed(0, sums)

    schema = "part int, sums binary"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tables, schema).repartition(MERGERS, F.pmod("part", F.lit(MERGERS)))
    total = np.zeros((BUCKETS, DIMENSIONS))
    for r in parts.mapInArrow(add, schema).collect():
        total += unpacked(r["sums"])
    return total


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    rows = training_rows(docs, labels, max_labelled)
    sums = all_neighbours(docs)
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMENSIONS))
    own[np.arange(BUCKETS)[:, None], places] = signs / np.sqrt(NONZERO)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = (own + sums / np.maximum(norm, 1e-9)).astype(np.float32)
    model = Model(vectors, np.zeros(1), np.ones(1), [], 1.0)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            features = model.features(batch["text"].to_pylist()).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["quality"].cast(pa.int32()), pa.array([x.tobytes() for x in features], pa.binary())], ["doc_id", "quality", "x"]
            )

    found = rows.mapInArrow(pooled, "doc_id bigint, quality int, x binary").collect()  # max_labelled rows of 400 bytes
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["quality"] for r in found], np.float64)
    if len(set(y.tolist())) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    x = np.array([np.frombuffer(r["x"], "<f4") for r in found], np.float64)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    scaled = (x - model.mean) / model.spread
    validation = np.arange(len(y)) % VALIDATION == 0
    if not 0 < y[~validation].mean() < 1:
        validation[:] = False
    model.layers = train_network(scaled[~validation], y[~validation])
    if validation.any():
        model.temperature = best_temperature(model.logits(x[validation]), y[validation])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of ``docs`` as ``row`` with its ``score``."""
    schema = docs.select(whole_row(docs).alias("row")).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row = batch["row"]
            texts = row.field("text").to_pylist() if isinstance(row, pa.StructArray) else [x["text"] for x in row.to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array(model.scores(texts))], ["row", "score"])

    return docs.select(whole_row(docs).alias("row")).mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged."""
    return scored(docs, fit(docs, labels, max_labelled)).where(F.col("score") >= threshold).select("row.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = id_hash(F.col("row.doc_id")) % HELD_OUT_OF == 0
    return scored(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
