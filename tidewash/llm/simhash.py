"""SimHash near-duplicates, with tables of distances to pivots.

Two fingerprints link at ``radius`` (3) or fewer differing bits. With the 64 bits cut into
``b`` blocks, linked fingerprints agree in ``b - 3`` whole blocks, so each choice of blocks
gives a key under which they meet; ``b`` grows with the corpus until keys are selective. The
distinct fingerprints of a key stand next to each other in a sorted partition. There the
distances of each to ``PIVOTS`` fixed reference fingerprints are computed once; by the
triangle inequality a pair that differs by more than the radius in any coordinate of that
table is discarded, and the survivors are verified on their bits.

Copies cost nothing: only distinct fingerprints are linked. A key that very many fingerprints
share is dealt on: with its other bits in four parts, linked fingerprints agree in one of them,
so none of their links is lost. A dense group gives a spanning forest of its links instead of all pairs, which has
the same components. Components come from alternating large and small stars, each round
written to the shared folder.

Defined results: a text without words has fingerprint zero and is linked like any other; a
null text is empty; repeated rows and ids share a fingerprint; the id of a component is its
smallest doc_id, nulls left out; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewash.llm.shared import packed, table, whole_row, written
from tidewash.llm.tokens import slices

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: A key with more distinct fingerprints is dealt on by parts of its other bits.
HOT_KEY = 4096
#: Groups up to this size give all their links, larger ones a forest.
SMALL_GROUP = 32
#: Blocks are added until a fingerprint meets this many others by chance, at most.
CHANCE_MEETINGS = 4.0
ROWS_AT_ONCE = 1 << 16


def pivots(number: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {k}".encode(), 0) for k in range(number)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text: a bit is set if over half the shingles' hashes set it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[tuple[bytes, ...]] = iter([tuple(words)])
    else:
        grams = zip(*(words[k:] for k in range(shingle)))
    n, counts = 0, np.zeros(64, np.int64)
    while True:
        some = [xxhash.xxh64_intdigest(b" ".join(gram), SEED) for gram in itertools.islice(grams, ROWS_AT_ONCE)]
        if not some:
            break
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, name: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """The id (``name``, of type ``kind``) and signed 64-bit fingerprint ``fp`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(text, shingle) for text in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch[name], pa.array(fps)], [name, "fp"])

    texts = docs.select(F.col(name).cast(kind).alias(name), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"{name} {kind}, fp bigint")


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks (signed) of all choices of ``b - radius`` of ``b`` blocks, for ``n`` distinct fingerprints."""
    for b in range(radius + 2, 17):
        ends = [64 * k // b for k in range(b + 1)]
        blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(ends, ends[1:])]
        masks = [sum(chosen) for chosen in itertools.combinations(blocks, b - radius)]
        if sum(n / 2.0 ** mask.bit_count() for mask in masks) <= CHANCE_MEETINGS:
            break
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def _forest(fps: np.ndarray, table_: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links (one, others) of a group that connect what all its links connect: each member is reached once."""
    left = np.arange(len(fps))
    frontier: list[int] = []
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
        one = frontier.pop()
        close = (np.abs(table_[left] - table_[one]) <= radius).all(axis=1)
        close[close] = np.bitwise_count(fps[left[close]] ^ fps[one]) <= radius
        if close.any():
            near, left = left[close], left[~close]
            yield one, near
            frontier.extend(near.tolist())


def group_links(groups: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked members inside each run of equal ``groups``; runs longer than SMALL_GROUP give a forest."""
    table_ = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    rest = np.repeat(starts + sizes, sizes) - np.arange(len(fps)) - 1  # members behind each
    for lag in range(1, SMALL_GROUP):
        at = np.flatnonzero(small & (rest >= lag))
        if not len(at):
            break
        at = at[(np.abs(table_[at] - table_[at + lag]) <= radius).all(axis=1)]
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        left.append(at)
        right.append(at + lag)
    for k in np.flatnonzero(sizes > SMALL_GROUP).tolist():
        part = slice(starts[k], starts[k] + sizes[k])
        for one, others in _forest(fps[part], table_[part], radius):
            left.append(np.full(len(others), starts[k] + one))
            right.append(starts[k] + others)
    return np.concatenate(left), np.concatenate(right)


def meetings(dealt: DataFrame, radius: int) -> DataFrame:
    """Pairs (low, high) of linked ids among the rows (choice, key, window, sub, id, fp) that share the first four."""
    names = ["choice", "key", "window", "sub"]
    id_type = dealt.schema["id"].dataType
    together = dealt.select(*names, "id", "fp").repartition(*names).sortWithinPartitions(*names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group may go on in the next batch

        def found(rows: pa.Table, groups: np.ndarray) -> pa.RecordBatch:
            a, b = group_links(groups, rows["fp"].to_numpy().view(np.uint64), radius)
            ids = rows["id"].combine_chunks()
            low, high = ids.take(pa.array(a)), ids.take(pa.array(b))
            return pa.RecordBatch.from_arrays([low, high], ["low", "high"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            changes = np.zeros(rows.num_rows, bool)
            for name in names:
                values = rows[name].to_numpy()
                changes[1:] |= values[1:] != values[:-1]
            last = int(np.flatnonzero(changes)[-1]) if changes.any() else 0
            held = rows.slice(last)
            if last:
                yield found(rows.slice(0, last), np.cumsum(changes[:last]))
        if held is not None and held.num_rows:
            yield found(held, np.zeros(held.num_rows, np.int64))

    met = together.mapInArrow(meet, StructType([StructField("low", id_type), StructField("high", id_type)]))
    return met.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct()


def sub_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks (signed) of ``radius`` + 1 parts of the bits outside ``mask``: linked fingerprints agree in one of them."""
    bits = [k for k in range(64) if not mask >> k & 1]
    masks = [sum(1 << k for k in bits[part :: radius + 1]) for part in range(radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (low, high) of different fingerprints that connect all fingerprints within ``radius``.

    ``distinct`` has one row per ``fp`` and is read twice; write it first.
    """
    masks = block_masks(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for k, mask in enumerate(masks)
    ])).alias("k")).select("k.*", "fp")
    hot = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY).select("choice", "key", F.lit(True).alias("hot"))
    parts = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in sub_masks(mask, radius)]) for mask in masks])
    part = lambda m, at: F.struct(at.cast("int").alias("window"), F.col("fp").bitwiseAND(m).alias("sub"))
    whole = F.array(F.struct(F.lit(-1).alias("window"), F.lit(0).cast("bigint").alias("sub")))
    windows = F.when(F.col("hot"), F.transform(F.get(parts, F.col("choice")), part)).otherwise(whole)
    dealt = keyed.join(bounded(written(hot, "hot-keys")), ["choice", "key"], "left").select(
        "choice", "key", F.col("fp").alias("id"), "fp", F.explode(windows).alias("w")
    ).select("choice", "key", "w.*", "id", "fp")
    return meetings(dealt, radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (low, high): the smallest node that it is connected with.

    Each round's smallest neighbours are written, so that both sides of a join have a shuffle of
    their own and Spark can split the edges of a large component, which all have its root. The
    tables of a round have at most two rows for each edge before it, and files to match.
    """
    edges = written(edges.select(F.greatest("low", "high").alias("u"), F.least("low", "high").alias("v")).where("u <> v"), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, most = state, 2 * state[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), F.least("u", "m").alias("m"))
        lowest = written(packed(lowest, most), "lowest")
        large = both.join(lowest, F.col("u") == F.col("center")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(packed(large.where("u <> v").distinct(), most), "large-star")
        lowest = written(packed(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), "m"), most), "lowest")
        met = large.join(lowest, F.col("u") == F.col("center"))
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select(F.col("center").alias("u"), F.col("m").alias("v")))
        edges = written(packed(small.distinct(), most), "small-star")
    return packed(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    ), 2 * state[0])


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``marked`` (doc_id, fp; written) with component_id, the smallest doc_id that links reach."""
    most = marked.count()
    distinct = written(packed(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), most), "fingerprints")
    roots = written(components(links(distinct, radius)), "components")
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id"
    )
    smallest = written(packed(members.groupBy("root").agg(F.min("first_id").alias("component_id")), most), "smallest")
    of_fp = members.join(smallest, "root").select(F.col("fp").alias("known"), "component_id")
    return marked.join(of_fp, marked["fp"] == of_fp["known"], "left").drop("known")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    return classes(written(fingerprints(docs, shingle), "marked"), radius)


# --- Groups by the similarity of the shingles themselves, linked fingerprints first -------------

SIMILARITY = 0.8
WIDE_SHINGLE = 5
#: Texts in which the common shingles are counted, and how many shingles are known as common at most.
SAMPLE_TEXTS = 32_768
MAX_COMMON = 1 << 19
#: Up to so many rows of 16-byte keys are broadcast.
MAX_BROADCAST = 2_000_000


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [tuple(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(gram), seed) for gram in grams), np.uint64))


def bounded(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups (rows equal in ``names``), each with the starts of its groups and its end."""
    held: pa.Table | None = None  # the last group may go on in the next batch
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        starts = _starts(rows, names)
        held = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])).combine_chunks(), starts
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _starts(rows: pa.Table, names: list[str]) -> np.ndarray:
    changes = np.zeros(rows.num_rows, bool)
    changes[0] = True
    for name in names:
        values = rows[name].to_numpy()
        changes[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changes)


def _open(sizes: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs can have the similarity: the first shingle they share has ``at`` others of its set before it."""
    need = np.ceil(similarity / (1 + similarity) * (sizes[a] + sizes[b]) - 1e-6)
    return np.minimum(sizes[a] - at[a], sizes[b] - at[b]) >= need


def first_meetings(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of whole groups, and the members of groups over SMALL_GROUP.

    Small groups give all pairs that can be similar. Large ones give those of one hub, which
    only unite most of a group of near copies; ``second_meetings`` looks at all the others.
    """
    counts = np.diff(starts)
    small = np.repeat(counts <= SMALL_GROUP, counts)
    rest = np.repeat(starts[1:], counts) - np.arange(len(sizes)) - 1  # members behind each
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, SMALL_GROUP):
        one = np.flatnonzero(small & (rest >= lag))
        if not len(one):
            break
        one = one[_open(sizes, at, one, one + lag, similarity)]
        left.append(one)
        right.append(one + lag)
    for k in np.flatnonzero(counts > SMALL_GROUP).tolist():
        members = np.arange(starts[k], starts[k + 1])
        hub = members[np.argmin(at[members])]  # the one with the fewest shingles of its own
        others = members[members != hub]
        others = others[_open(sizes, at, np.full(len(others), hub), others, similarity)]
        left.append(np.full(len(others), hub))
        right.append(others)
    return np.concatenate(left), np.concatenate(right), np.flatnonzero(~small)


def second_meetings(sizes: np.ndarray, at: np.ndarray, roots: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of a large group that can be similar and are not united yet; None if those are very many."""
    counts = np.bincount(roots)
    none = np.zeros(0, np.int64)
    if len(sizes) ** 2 - (counts**2).sum() > 2 * SMALL_GROUP * len(sizes):
        return None
    largest = roots == np.argmax(counts)
    left, right = [none], [none]
    for one in np.flatnonzero(~largest).tolist():
        others = np.flatnonzero((roots != roots[one]) & (largest | (np.arange(len(roots)) > one)))
        others = others[_open(sizes, at, np.full(len(others), one), others, similarity)]
        left.append(np.full(len(others), one))
        right.append(others)
    return np.concatenate(left), np.concatenate(right)


def similar_forest(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of a group that connect, with ``roots``, what all its similar pairs connect.

    A member is taken off only when it is united or its similarity on all shingles is enough.
    """
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    n_codes = int(code.max()) + 1 if len(code) else 0
    is_left, n_left, n_indexed = np.ones(len(sets), bool), len(sets), 2 * len(sets)
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    frontier: list[int] = []
    while n_left:
        if not frontier:
            frontier.append(int(np.argmax(is_left)))
            is_left[frontier[0]] = False
        one = frontier.pop()
        united = np.flatnonzero(is_left & (roots == roots[one]))
        is_left[united] = False
        frontier.extend(united.tolist())
        n_left = int(is_left.sum())
        if 2 * n_left <= n_indexed:  # the members with each shingle, of those that are left
            rows = np.flatnonzero(is_left[owner])
            rows = rows[np.argsort(code[rows], kind="stable")]
            holders, n_indexed = owner[rows], n_left
            ends = np.cumsum(np.bincount(code[rows], minlength=n_codes))
        own = code[first[one] : first[one + 1]]
        lengths = ends[own] - np.where(own > 0, ends[own - 1], 0)
        places = np.arange(lengths.sum()) + np.repeat(ends[own] - np.cumsum(lengths), lengths)
        common = np.bincount(holders[places], minlength=len(sets))
        near = np.flatnonzero(is_left & (common > 0) & (common >= similarity * (sizes + sizes[one] - common)))
        is_left[near] = False
        n_left -= len(near)
        frontier.extend(near.tolist())
        low.append(np.full(len(near), one))
        high.append(near)
    return np.concatenate(low), np.concatenate(high)


def common_shingles(texts: DataFrame, one_of: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several of the sampled texts have, and how many have them.

    They only set the order of rarity; any order finds the same pairs.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            some = np.concatenate([np.zeros(0, np.uint64), *(shingle_hashes(t, shingle) for t in batch["text"].to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], ["hash"])

    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(one_of)) == 0).groupBy("id").agg(F.first("text").alias("text"))
    counted = sample.mapInArrow(hashes, "hash bigint").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.where("n > 1"), "common-shingles")
    least, known = 2, 0
    for n, how_many in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        known += how_many
        if known > MAX_COMMON:
            least = n + 1
            break
    found = counted.where(F.col("n") >= least).coalesce(8).toArrow()
    hash_, n = found["hash"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hash_)
    return hash_[order], n[order].astype(np.int32)


def rarest(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a text, one of which each similar text has among its own rarest; with their sample counts.

    A similar text shares at least ``similarity`` of these shingles, so it cannot miss all of one
    more than the rest; and of the shared shingles the rarest stands among the rarest of both.
    """
    known, counts = common
    count = np.zeros(len(hashes), np.int32)
    if len(known):
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        count = np.where(known[place] == hashes, counts[place], 0)
    order = np.lexsort((hashes, count))[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]
    return hashes[order], count[order]


def wide_dealt(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Rows (key, window, id, size, at): similar texts share a key, a shingle, and a window of it.

    ``at`` is the number of shingles of the text that are rarer than the key.
    """
    one_of = max(1, texts.select(F.approx_count_distinct("id")).first()[0] // SAMPLE_TEXTS)
    common = common_shingles(texts, one_of, shingle)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(t, shingle) for t in batch["text"].to_pylist()]
            each = [rarest(s, common, similarity) if len(s) else (s, np.zeros(0, np.int32)) for s in sets]
            ends = np.cumsum([0, *(len(k) for k, _ in each)]).astype(np.int32)
            flat = [pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k, _ in each], [np.ceil(c * (one_of / HOT_KEY)).clip(1).astype(np.int32) for _, c in each])]
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in flat]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(s) for s in sets], pa.int32()), *lists], ["id", "size", "keys", "parts"])

    marked = texts.mapInArrow(keys, "id binary, size int, keys array<bigint>, parts array<int>")
    marked = marked.groupBy("id").agg(F.first(F.struct("size", "keys", "parts")).alias("m")).select("id", "m.*")
    keyed = marked.select("id", "size", F.posexplode(F.arrays_zip("keys", "parts")).alias("at", "k"))
    # A hot key is dealt over slices, each pair of which is a window: own slice and each other one.
    own, n = F.pmod(F.xxhash64("id"), F.col("k.parts")).cast("int"), F.col("k.parts")
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.least(x, own) * n + F.greatest(x, own))
    return keyed.select(F.col("k.keys").alias("key"), F.explode(windows).alias("window"), "id", "size", "at")


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (low, high) of different texts that connect all texts whose fingerprints link.

    A text is paired with the first one of its fingerprint, and the first ones of two
    fingerprints that ``links`` gives are paired.
    """
    marked = written(fingerprints(texts, name="id", kind="binary").groupBy("id").agg(F.min("fp").alias("fp")), "marked")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    shared = written(distinct.where("n > 1").select(F.col("fp").alias("of"), "first"), "shared-fingerprints")
    same = marked.join(shared, F.col("fp") == F.col("of")).where("id <> first").select(F.col("first").alias("low"), F.col("id").alias("high"))
    linked = written(links(distinct), "linked")
    low, high = (distinct.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_id")) for side in ("low", "high"))
    linked = linked.join(low, "low").join(high, "high").select(F.col("low_id").alias("low"), F.col("high_id").alias("high"))
    return same.unionByName(linked.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (low, high) that ``roots`` (node, root; written) do not connect already."""
    one, other = (roots.select(F.col("node").alias(f"{side}_node"), F.col("root").alias(f"{side}_root")) for side in ("low", "high"))
    both = pairs.join(bounded(one), F.col("low") == F.col("low_node"), "left").join(bounded(other), F.col("high") == F.col("high_node"), "left")
    return both.where("low_root IS NULL OR high_root IS NULL OR low_root <> high_root").select("low", "high")


def similar_pairs(texts: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (low, high) of different texts whose distinct shingles have the Jaccard similarity asked for.

    ``texts`` has id (16 bytes, its digest) and text; copies are harmless. Every pair returned
    is verified on all shingles of both texts, and the pairs connect whatever all similar pairs
    connect: a pair is passed over only if both are connected already. Linked fingerprints give
    the first pairs; the filter on rare shingles finds those that differ in more bits.
    """
    names = ["key", "window"]
    schema = "key bigint, window int, low binary, high binary, root binary, size int, at int"

    def out(rows: pa.Table, a: np.ndarray, b: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
        """Pairs, and members of groups that are still to be looked at, as rows of one table."""
        no = lambda of: pa.nulls(len(a), rows.schema.field(of).type)
        of = lambda name, at: rows[name].combine_chunks().take(pa.array(at))
        root = of("root", members) if "root" in rows.column_names else pa.nulls(len(members), pa.binary())
        both = lambda x, y: pa.concat_arrays([x, y])
        return pa.RecordBatch.from_arrays([
            both(no("key"), of("key", members)), both(no("window"), of("window", members)),
            both(of("id", a), of("id", members)), both(of("id", b), pa.nulls(len(members), pa.binary())),
            both(pa.nulls(len(a), pa.binary()), root), both(no("size"), of("size", members)), both(no("at"), of("at", members)),
        ], ["key", "window", "low", "high", "root", "size", "at"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, names):
            yield out(rows, *first_meetings(starts, rows["size"].to_numpy(), rows["at"].to_numpy(), similarity))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for rows, starts in whole_groups(batches, names):
            for lo, hi in itertools.pairwise(starts.tolist()):
                group = rows.slice(lo, hi - lo)
                roots = group["root"].combine_chunks().dictionary_encode().indices.to_numpy()
                found = second_meetings(group["size"].to_numpy(), group["at"].to_numpy(), roots, similarity)
                yield out(group, none, none, np.arange(hi - lo)) if found is None else out(group, *found, none)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, names):
            for lo, hi in itertools.pairwise(starts.tolist()):
                group = rows.slice(lo, hi - lo)
                roots = group["root"].combine_chunks().dictionary_encode().indices.to_numpy()
                a, b = similar_forest([np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()], roots, similarity)
                ids = group["id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["low", "high"])

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(*names).sortWithinPartitions(*names)

    def sides(met: DataFrame) -> DataFrame:
        ordered = met.where("high IS NOT NULL").select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
        return ordered.distinct()

    members = ["key", "window", F.col("low").alias("id"), "size", "at"]
    similar = written(verified(texts, written(fingerprint_pairs(texts), "fingerprint-pairs"), shingle, similarity), "similar")
    roots = written(components(similar), "wide-roots")
    met = written(together(wide_dealt(texts, shingle, similarity)).mapInArrow(first, schema), "wide-first")
    wide = written(apart(sides(met), roots), "wide-pairs")
    similar = similar.unionByName(written(verified(texts, wide, shingle, similarity), "similar"))
    large = met.where("high IS NULL").select(*members)
    if large.isEmpty():
        return similar
    roots = written(components(similar), "wide-roots")
    large = large.join(roots, F.col("id") == F.col("node"), "left").select("key", "window", "id", "size", "at", F.coalesce("root", "id").alias("root"))
    met = written(together(large).mapInArrow(second, schema), "wide-second")
    similar = similar.unionByName(verified(texts, written(sides(met), "wide-pairs"), shingle, similarity))
    crowded = met.where("high IS NULL").select(*members, "root")
    if crowded.isEmpty():
        return similar
    sets = shingle_sets(texts, crowded.select(F.col("id").alias("wanted")).distinct(), shingle)
    crowded = crowded.join(sets.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).select("key", "window", "id", "root", "hashes")
    return similar.unionByName(together(crowded).mapInArrow(third, "low binary, high binary"))


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of the texts that are ``wanted``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes(t, shingle).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(hashes, pa.binary())], ["id", "hashes"])

    found = texts.join(bounded(wanted), F.col("id") == F.col("wanted"), "left_semi").mapInArrow(sets, "id binary, hashes binary")
    return written(found, "shingle-sets", compression="zstd").groupBy("id").agg(F.first("hashes").alias("hashes"))


def verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (low, high; written) that have the similarity on all their shingles."""
    found = shingle_sets(texts, pairs.select(F.explode(F.array("low", "high")).alias("wanted")).distinct(), shingle)
    both = pairs.join(found.select(F.col("id").alias("low"), F.col("hashes").alias("a")), "low").join(
        found.select(F.col("id").alias("high"), F.col("hashes").alias("b")), "high"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            kept = []
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(common >= similarity * (len(a) + len(b) - common) and (len(a) > 0) == (len(b) > 0))
            yield batch.select(["low", "high"]).filter(pa.array(kept, pa.bool_()))

    return both.select("low", "high", "a", "b").mapInArrow(verify, "low binary, high binary")


def _place(docs: DataFrame) -> Column:
    """Where a row of a scan stands: a digest of its file's path, and its number there."""
    at = docs.metadataColumn("_metadata")
    return F.struct(F.unhex(F.md5(at["file_path"])).alias("file"), at["row_index"].alias("row_index"))


def one_of_each(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the smallest doc_id (nulls last).

    Exact copies, repeated rows and, as one group, texts without words belong together. Rows are
    told apart by file and row in it, whatever splits they are read in; where ``docs`` is no scan
    of files, it is written first.
    """
    try:
        docs.metadataColumn("_metadata")
        docs.select(_place(docs)).schema
    except AnalysisException:
        docs = written(docs, "documents", compression="zstd")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")) == ""
    digest = F.unhex(F.md5(F.when(blank, F.lit("")).otherwise(text)))
    numbered = docs.select(whole_row(docs).alias("row"), _place(docs).alias("number"))
    places = written(docs.select(_place(docs).alias("number"), digest.alias("id"), F.col("doc_id").alias("doc_id")), "places")
    pairs = similar_pairs(docs.select(digest.alias("id"), text.alias("text")), shingle, similarity)
    roots = components(written(pairs, "similar"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number"))
    texts = written(places.groupBy("id").agg(first.alias("first")), "texts")
    members = texts.join(roots, texts["id"] == roots["node"], "left").select(F.coalesce("root", "id").alias("root"), "first")
    stays = members.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.number").alias("stays"))
    goes = written(places.join(stays, F.col("number") == F.col("stays"), "left_anti").select(F.col("number").alias("goes")), "goes")
    return numbered.join(bounded(goes), F.col("number") == F.col("goes"), "left_anti").select("row.*")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
