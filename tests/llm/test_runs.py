"""Runs against brute force: all periods of all places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewash.llm import runs
from tidewash.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def naive_lyndon(ranks):
    out = []
    for i in range(len(ranks)):
        j = i + 1
        while j < len(ranks) and ranks[j:] > ranks[i:]:
            j += 1
        out.append(j - i)
    return out


def brute(words, min_length=24, min_exponent=3):
    """(start, length, period) by comparing the whole text with itself at every distance."""
    codes = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    n, found = len(ids), {}
    for period in range(1, n // min_exponent + 1):
        equal = np.concatenate([[False], ids[:-period] == ids[period:], [False]]).astype(np.int8)
        edges = np.diff(equal)
        for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            length = end - start + period
            if length >= max(min_length, min_exponent * period) and (start, length) not in found:  # a multiple of a smaller period
                found[start, length] = period
    return sorted((*at, period) for at, period in found.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found, dropped = brute(words), set()
    for start, length, period in found:
        dropped |= set(range(start + period, start + length))
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_groups_give_the_lyndon_array():
    random.seed(1)
    for _ in range(500):
        ranks = [random.randrange(random.randint(1, 4)) for _ in range(random.randint(1, 40))]
        ranks = [sorted(set(ranks)).index(x) for x in ranks]
        assert list(runs.lyndon_groups(ranks)[1]) == naive_lyndon(ranks)


def test_runs_equal_brute_force():
    random.seed(2)
    for _ in range(1500):
        letters = random.randint(1, 4)
        text = [random.randrange(letters) for _ in range(random.randint(0, 30))]
        base = [random.randrange(letters) for _ in range(random.randint(1, 6))]
        text = text + base * random.randint(0, 8) + text[:4]
        assert runs.runs(text, 6, 3) == brute(text, 6, 3)
        assert runs.runs(text, 9, 4) == brute(text, 9, 4)


def test_registered_query_on_the_whole_table(spark):
    got = QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs)
    assert [rows[d.doc_id] for d in docs] == [expected(d.doc_id, d.text) for d in docs]
    assert sum(r[1] > 0 for r in rows.values()) > 10


@pytest.mark.parametrize("end", ["", " tail"])
def test_odd_rows(spark, end):
    line = "a b c d e f g h i j k l m "
    long = "x " * 30_000 + " ".join(map(str, range(3000)))
    texts = [None, "", " \t\n", line * 4 + end, line * 4 + end, "w " * 23, "w " * 24, "é ü " * 30, long, line * 2, "y " * 24 + "z " * 24]
    docs = spark.createDataFrame(
        [(i, t, i, "r", 7) for i, t in enumerate(texts)] + [(None, line * 5, 0, "r", 7), (3, line * 4 + end, 0, "r", 7)],
        "doc_id bigint, text string, runs int, collapsed string, row int",
    )
    rows = runs.with_runs(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = (r.row.text or "").encode().split()
        assert [tuple(x) for x in r.runs] == brute(words)
        assert r.collapsed.encode() == b" ".join(runs.collapsed_words(words, brute(words)))
    cleaned = runs.without_runs(docs)
    assert cleaned.columns == docs.columns
    texts_after = {r.doc_id: r.text for r in cleaned.collect() if r.doc_id is not None}
    assert texts_after[3] == ("a b c d e f g h i j k l m" + end) and texts_after[2] == " \t\n" and texts_after[0] is None
    assert texts_after[10] == "y z"


def test_empty_table_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert runs.with_runs(docs).count() == 0 and runs.without_runs(docs).count() == 0
    with pytest.raises(ValueError):
        runs.with_runs(docs, min_exponent=2)
