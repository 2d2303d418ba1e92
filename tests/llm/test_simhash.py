"""Fingerprints and components against brute force."""

import itertools

import numpy as np
import pytest
import xxhash

from tidewash.llm import shared, simhash

SCHEMA = "doc_id bigint, text string, fp string, key int"


def slow_fingerprint(text, n=3):
    words = []
    word = ""
    for c in (text or ""):
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c == " " or 9 <= ord(c) <= 13:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    words += [word] if word else []
    grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


TEXTS = ["", None, " \t\n", "one", "One two", "a b c d e f g", "A\x0bB c D e f G É é", "x " * 500, "\x1c a\x85b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def random_fingerprints(seed, n, dense=False):
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    out = [0, 2**64 - 1]
    for x in bits.tolist():
        out.append(x)
        for _ in range(rng.integers(0, 4)):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            out.append(x)
    if dense:  # very many near copies of one text
        for _ in range(1500):
            x = out[2]
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("dense, hot", [(False, 4096), (True, 4096), (True, 40)])
def test_components_of_links(spark, monkeypatch, dense, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    fps = random_fingerprints(4, 300, dense)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint").repartition(3)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [tuple(r) for r in simhash.links(frame).collect()]
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    true = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    assert all(bin((x ^ y) & (2**64 - 1)).count("1") <= 3 and x < y for x, y in links)
    assert union(links, signed) == union(true, signed)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "low bigint, high bigint")).collect()}
    expected = union(true, signed)
    assert all(found.get(n, n) == expected[n] for n in signed)


def test_a_hot_key_is_dealt_on(spark, monkeypatch):
    rng = np.random.default_rng(2)
    low = rng.integers(0, 2**30, 15_000).astype(np.uint64) << np.uint64(15)  # all share the other bits
    frame = spark.createDataFrame([(int(x),) for x in np.unique(low).view(np.int64).tolist()], "fp bigint").repartition(4)
    monkeypatch.setattr(simhash, "HOT_KEY", 1000)
    sizes = []
    real = simhash.meetings

    def watched(dealt, radius):
        sizes.append(dealt.groupBy("choice", "key", "window", "sub").count().agg({"count": "max"}).first()[0])
        return real(dealt, radius)

    monkeypatch.setattr(simhash, "meetings", watched)
    links = {tuple(r) for r in simhash.links(frame).collect()}
    assert sizes[0] <= 2 * simhash.HOT_KEY
    fps = np.unique(low)
    near = set()
    for flips in itertools.chain([()], itertools.combinations(range(15, 45), 1), itertools.combinations(range(15, 45), 2), itertools.combinations(range(15, 45), 3)):
        other = fps ^ np.uint64(sum(1 << b for b in flips))
        found = np.isin(other, fps) & (other > fps)
        near |= set(zip(fps[found].tolist(), other[found].tolist()))
    assert len(near) > 200 and union(links, fps.tolist()) == union(near, fps.tolist())
    for mask in simhash.block_masks(10**6):
        parts = [m & (2**64 - 1) for m in simhash.sub_masks(mask)]
        assert sum(parts) == ~mask & (2**64 - 1) and sum(m.bit_count() for m in parts) == 64 - (mask & (2**64 - 1)).bit_count()


def test_chain_of_links(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "low bigint, high bigint")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert simhash.components(spark.createDataFrame([], "low bigint, high bigint")).count() == 0


@pytest.mark.parametrize("rows_a_file, least, most", [(1 << 16, 1, 1), (8, 2, 11)])
def test_files_of_a_round_go_by_its_edges(spark, monkeypatch, rows_a_file, least, most):
    """Not by the shuffle's partitions; and a larger table stays in several files."""
    files, real = [], shared.written

    def watched(df, purpose, **options):
        out = real(df, purpose, **options)
        if purpose not in ("edges", "hot-keys", "marked"):
            files.append((purpose, len(out.inputFiles())))
        return out

    monkeypatch.setattr(simhash, "written", watched)
    monkeypatch.setattr(shared, "ROWS_A_FILE", rows_a_file)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101)]
    texts = [(k, f"text {k % 40} stands here alone with other words {k % 40}", "x", 1) for k in range(60)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "low bigint, high bigint").repartition(5)).collect()}
        simhash.near_duplicates(spark.createDataFrame(texts, SCHEMA).repartition(5)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert {"lowest", "large-star", "small-star", "fingerprints", "components", "smallest"} == {p for p, _ in files}
    assert least <= max(n for _, n in files) <= most


def test_classes_of_documents(spark):
    base = "The quick brown fox jumps over the lazy dog and runs far away into the deep dark wood " * 20
    rows = [(9, base), (4, base.upper()), (7, base + "end"), (3, ""), (2, None), (8, "\n"), (1, "other words stand here alone"), (None, base), (1, "other words stand here alone")]
    rows += [(k, t) for k, t in enumerate(TEXTS, 20)]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    fps = {t: slow_fingerprint(t) for _, t in rows}
    nodes = sorted(set(fps.values()))
    root = union([(x, y) for x in nodes for y in nodes if x < y and (x ^ y).bit_count() <= 3], nodes)
    lowest = {}
    for i, t in rows:
        if i is not None:
            lowest[root[fps[t]]] = min(lowest.get(root[fps[t]], i), i)
    assert got == sorted(((i, fps[t], lowest[root[fps[t]]]) for i, t in rows), key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
