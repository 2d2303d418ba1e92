"""The pipeline's stages, each against brute force on what it is given."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidewash.llm import simhash
from tidewash.llm.shared import written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return written(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3), "given")


def jaccard(a, b):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def words(seed, n):
    return [f"w{(seed * 7919 + k * k * 31 + k) % 5003}" for k in range(n)]


def rows_of_groups():
    rows = []
    for g in range(30):
        base = words(g, 200)
        rows.append((g, " ".join(base)))
        rows.append((100 + g, " ".join(base).upper()))  # the same words
        near = [*base]
        near[g] = "changed"
        rows.append((200 + g, " ".join(near)))  # about 0.95
        far = ["other" if k % 4 == 0 else w for k, w in enumerate(base)]
        rows.append((300 + g, " ".join(far)))  # below 0.8
    rows += [(1000 + k, " ".join(words(900 + k, 60))) for k in range(20)]
    rows += [(2000, None), (2001, ""), (1999, " \n"), (3000, "short one"), (3001, "Short one"), (3002, "short"), (None, "short one"), (0, " ".join(words(0, 200)))]
    return rows


def test_one_of_each(spark):
    rows = rows_of_groups()
    docs = documents(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    expected, groups = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        near = [g for g in groups if any(jaccard(t, u) >= 0.8 for u in g)]
        for g in near:
            groups.remove(g)
        if not near:
            expected.append((i, t))
        groups.append([t, *(u for g in near for u in g)])
    assert [i for i, _ in got] == [i for i, _ in sorted(expected)]
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_same_rows_whatever_the_splits(spark):
    sizes = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    rows = rows_of_groups()
    given = written(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5), "given", **{"parquet.block.size": "2048"})
    expected = sorted(str(tuple(r)) for r in simhash.one_of_each(given).collect())
    kept = simhash.one_of_each(given)  # its jobs have run; the last scan is planned anew
    try:
        spark.conf.set(sizes[0], "4096")
        spark.conf.set(sizes[1], "1")
        assert given.rdd.getNumPartitions() > 5
        assert sorted(str(tuple(r)) for r in kept.select("*").collect()) == expected
    finally:
        for name in sizes:
            spark.conf.unset(name)
    no_scan = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], SCHEMA + ", _metadata string")
    assert sorted(str(tuple(r)[:-1]) for r in simhash.one_of_each(no_scan).collect()) == expected


@pytest.mark.parametrize("hot", [8, 4096])
def test_hot_group_of_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    base = words(3, 300)
    rows = [(k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(60)] + [(100, " ".join(words(5, 300)))]
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()) == [0, 100]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"
    ]


def test_whole_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = written(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == given.columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    packed = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r["sum(length)"] <= 4096 for r in packed)
    assert given.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def components_of(texts, similar):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if find(a) != find(b) and similar(texts[a], texts[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(k) for k in range(len(texts))})


def edited(base, seed, edits, name="x"):
    rng = random.Random(f"{name} {seed}")
    near = [*base]
    for at in rng.sample(range(5, len(base) - 5), edits):
        near[at] = f"{name}{seed}q{at}"
    return near


def test_star_of_near_copies(spark):
    """Variants similar to one base and not to each other; the base is neither first nor last."""
    base = words(3, 300)
    texts = [" ".join(edited(base, k, 6)) for k in range(120)]
    texts.insert(60, " ".join(base))
    kept = sorted(r.doc_id for r in simhash.one_of_each(documents(spark, list(enumerate(texts)))).collect())
    assert kept == components_of(texts, lambda a, b: jaccard(a, b) >= 0.8)
    assert kept == [0]


def test_similar_forest_is_verified():
    rng = np.random.default_rng(1)
    base = np.arange(300, dtype=np.uint64)
    sets = [np.sort(np.concatenate([rng.permutation(base)[:275], 1000 * (k + 1) + np.arange(25, dtype=np.uint64)])).astype(np.uint64) for k in range(200)]
    sets.insert(90, base)
    low, high = simhash.similar_forest(sets, np.arange(len(sets)), 0.8)

    def similar(a, b):
        common = len(np.intersect1d(a, b))
        return common >= 0.8 * (len(a) + len(b) - common)

    assert all(similar(sets[a], sets[b]) for a, b in zip(low, high))
    assert len(low) == len(sets) - len(components_of(sets, similar)) == 200
    roots = np.where(np.arange(len(sets)) < 100, 0, np.arange(len(sets)))  # those are united already
    assert len(simhash.similar_forest(sets, roots, 0.8)[0]) == 101


def test_rarest_shingles_meet():
    """Each pair at 0.8 or more shares a shingle among the rarest of both, whatever is known as common."""
    rng = np.random.default_rng(2)
    common = (np.arange(0, 400, 3, dtype=np.uint64), rng.integers(2, 50, 134).astype(np.int32))
    met = 0
    for n in [1, 2, 4, 5, 9, 10, 40, 300] * 40:
        a = np.unique(rng.integers(0, 1000, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(np.ceil(len(a) * rng.uniform(0.8, 1)))], rng.integers(0, 10**6, int(rng.integers(0, 1 + n // 9))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if shared >= 0.8 * (len(a) + len(b) - shared):
            met += 1
            keys, others = simhash.rarest(a, common, 0.8)[0], simhash.rarest(b, common, 0.8)[0]
            key = next(k for k in keys if k in others)
            sizes, at = np.array([len(a), len(b)]), np.array([list(keys).index(key), list(others).index(key)])
            assert simhash._open(sizes, at, np.array([0]), np.array([1]), 0.8)[0]
    assert met > 100


def test_pairs_just_above_the_similarity(spark):
    rows = [(k, " ".join(edited(words(k, 300), k, 7, name)) if name else " ".join(words(k, 300))) for name in ("", "z") for k in range(400)]
    near = [k for k in range(400) if jaccard(rows[k][1], rows[400 + k][1]) >= 0.8]
    assert len(near) > 50
    rows = [row for k in near for row in ((k, rows[k][1]), (1000 + k, rows[400 + k][1]))]
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()) == near


def test_pairs_inside_a_hot_key(spark, monkeypatch):
    """Texts that share most of their shingles without being similar, and pairs of near copies among them."""
    monkeypatch.setattr(simhash, "HOT_KEY", 16)
    base = words(3, 150)
    rows = []
    for k in range(100):
        own = [*base, *(f"own{k}n{n}" for n in range(20))]
        rows += [(k, " ".join(own)), (1000 + k, " ".join([*own[:30], f"y{k}", *own[31:60], f"z{k}", *own[61:]]))]
    assert jaccard(rows[0][1], rows[2][1]) < 0.8 <= jaccard(rows[0][1], rows[1][1])
    assert sorted(r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()) == list(range(100))


def linked_texts(seed):
    """Near copies whose fingerprints link, a pair that links without being similar, and others."""
    rows = []
    for g in range(12):
        base = words(seed + g, 900)
        rows += [(100 * g + k, " ".join([*base[: 50 * k], f"new{k}", *base[50 * k + 1 :]])) for k in range(6)]
    repeated = ["a", "b", "c"] * 300
    return [*rows, (5000, " ".join(repeated)), (5001, " ".join([*repeated, *words(77, 12)])), *((6000 + k, " ".join(words(50 + k, 90))) for k in range(20))]


def test_fingerprints_give_the_first_pairs(spark, monkeypatch):
    """The stage links fingerprints as operator 4 does: what they link and the exact check confirms needs no other filter."""
    rows = linked_texts(1)
    texts = [t for _, t in rows]
    fps = [simhash.fingerprint(t) for t in texts]
    linked = components_of(list(range(len(rows))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    confirmed = components_of(list(range(len(rows))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3 and jaccard(texts[a], texts[b]) >= 0.8)
    assert len(linked) < len(confirmed) < len(rows) - 20  # the exact check parts 5000 and 5001
    docs = documents(spark, rows)
    found = simhash.fingerprint_pairs(docs.selectExpr("unhex(md5(text)) AS id", "text")).collect()
    ids = {bytes.fromhex(r.h): r.n for r in docs.selectExpr("md5(text) AS h", "doc_id AS n").collect()}
    place = {i: k for k, (i, _) in enumerate(rows)}
    pairs = {frozenset((place[ids[bytes(r.low)]], place[ids[bytes(r.high)]])) for r in found}
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 and a != b for a, b in map(tuple, pairs))
    assert components_of(list(range(len(rows))), lambda a, b: frozenset((a, b)) in pairs) == linked
    real = simhash.wide_dealt
    monkeypatch.setattr(simhash, "wide_dealt", lambda *given: real(*given).limit(0))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [rows[k][0] for k in confirmed]
    monkeypatch.setattr(simhash, "wide_dealt", real)
    every = components_of(texts, lambda a, b: jaccard(a, b) >= 0.8)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [rows[k][0] for k in every]


def test_united_pairs_are_not_looked_at_again(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "low bigint, high bigint")
    roots = written(spark.createDataFrame([(0, 0), (1, 0), (2, 0), (4, 4), (5, 4)], "node bigint, root bigint"), "roots")
    left = {tuple(r) for r in simhash.apart(pairs, roots).collect()}
    assert {(a, b) for a in range(8) for b in range(a + 1, 8)} - left == {(0, 1), (0, 2), (1, 2), (4, 5)}
