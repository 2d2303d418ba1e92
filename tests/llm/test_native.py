"""Line dedup, sharding and decontamination against plain Python."""

import re
import zlib
from collections import Counter

import pytest

from tidewash.llm import decontaminate, line_dedup, sharding

SCHEMA = "doc_id bigint, text string, key string, row int, lines string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "k", 7, None) for a, b in rows], SCHEMA)


A = "First sentence of a passage. Second sentence is here! Third one ends it? "
LINED = [
    (1, "Intro line.\n" + A + "Tail one.\n"), (2, "Other start here. " + A + "Tail two."), (2, "Other start here. " + A + "Tail two."),
    (3, None), (4, ""), (5, "One. Two."), (6, "a. b. c. a. b. c. a. b. c."), (7, (A + "\n") * 3), (None, A), (8, "x" * 200_000 + "\n" + A),
    (9, "No full stop at all"), (10, "\n\n\n\n\n\n"), (11, "Wow!! Yes!! " + A),
]


def slow_dedup(rows, least=24):
    def lines(t):
        return [x for x in re.split(r"(?<=\n)|(?<=[^\W_][.!?] )", t or "") if x]

    seen, gone = {}, {}
    documents = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc in documents:
        each = lines(doc[1])
        for i in range(len(each) - 2):
            w = tuple(x.rstrip(" \t\r\n") for x in each[i : i + 3])
            if sum(map(len, w)) < least:
                continue
            if seen.setdefault(w, (doc, i)) != (doc, i):
                gone.setdefault(doc, set()).update(range(i, i + 3))
    return [(d, len(lines(t)), len(gone.get((d, t), ())), None if t is None else "".join(x for i, x in enumerate(lines(t)) if i not in gone.get((d, t), ()))) for d, t in rows]


def test_line_dedup(spark):
    docs = frame(spark, LINED)
    got = [(r.row.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.marked_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(slow_dedup(LINED), key=str)
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(LINED)
    assert line_dedup.marked_lines(docs.limit(0)).count() == 0


def test_shards(spark):
    rows = [(k, None if k % 11 == 0 else "é" * (k % 37)) for k in range(1003)] + [(5, "same")] * 400 + [(None, None)] * 3
    docs = frame(spark, rows).repartition(3)
    got = sharding.shards(docs, 16, bucket_bytes=2000).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    firsts = [r.row.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert firsts != sorted(firsts, key=lambda x: (x is None, x))
    assert sharding.shards(docs.limit(0)).count() == 0


def test_shuffle_is_even(spark):
    docs = frame(spark, [(k, "t") for k in range(2000)])
    counts = Counter(r.shard for r in sharding.shards(docs, 8, bucket_bytes=500).where("row.doc_id < 400").collect())
    assert all(20 < counts[s] < 90 for s in range(8))


def test_shards_are_written(spark, tmp_path):
    docs = frame(spark, [(k, "t" * k) for k in range(50)])
    sharding.write_shards(sharding.shards(docs, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
BENCH = [("b1", PASSAGE), ("b2", "short item"), ("b1", PASSAGE), ("b3", ""), ("b4", None), (None, "é è ê ñ ü ö ä ß ø å æ"), ("b10", "Delta, epsilon; ZETA eta theta iota kappa lambda mu nu")]
DIRTY = [
    (1, "clean text only"), (2, PASSAGE.upper() + "!"), (3, "x " + PASSAGE.replace(" ", ", ") + " nu y"), (4, "a short item, short item"), (5, None), (6, ""),
    (7, "É è ê ñ ü ö ä ß ø å æ"), (7, "é è ê ñ ü ö ä ß ø å æ"), (None, PASSAGE), (8, "alpha beta gamma delta epsilon zeta eta theta iota"), (9, "w " * 20_000 + PASSAGE),
    (1, "clean text only"),
]


def slow_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(name or "")
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("limit", [100_000, 3])
def test_contamination(spark, limit):
    docs = frame(spark, DIRTY)
    bench = spark.createDataFrame([(a, b, 1) for a, b in BENCH], "item_id string, text string, words int")
    got = decontaminate.contamination(docs, bench, max_grams=limit).collect()
    expected = [(d, *slow_hits(t, BENCH)) for d, t in DIRTY]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_clean_documents_and_spans(spark):
    docs = frame(spark, DIRTY)
    bench = spark.createDataFrame([(a, b) for a, b in BENCH], "item_id string, text string")
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == sorted((d or -1, t) for d, t in DIRTY if t and not slow_hits(t, BENCH)[1])
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert spans[3] == "x y" and spans[4] == "a" and spans[8].startswith("alpha") and spans[9] == ("w " * 20_000).strip()
    nothing = bench.limit(0)
    assert decontaminate.clean_documents(docs, nothing).count() == len(DIRTY)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, nothing).where("contaminated").count() == 0


def test_crc_of_sharding_is_zlibs(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary"))).first()
    assert row[0] == zlib.crc32("é".encode())
