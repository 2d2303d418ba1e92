"""Registered queries without SQL on the whole smallest tables, against plain Python."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tidewash.llm.registry import ORACLES, QUERIES
from tidewash.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def tokens(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return {i: tokenizer.encode(text or "", add_special_tokens=False).ids for i, text in docs}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_all_others_have_sql_or_a_test_of_their_own():
    here = {"op1_best_fit_packing", "op3_token_files", "op4_simhash_near_dedup", "op5_sharding"}
    elsewhere = {"op7_license_scan", "op9_html_extraction", "op10_quality_classifier", "op12_embedding_whitening", "op13_periodic_runs"}
    assert set(QUERIES) == set(ORACLES) | here | elsewhere


def test_packing(spark, tokens):
    got = QUERIES["op1_best_fit_packing"](spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    expected, sizes = set(), []
    for i, ids in tokens.items():
        whole = [*ids, 1]
        for piece, start in enumerate(range(0, len(whole), 4096)):
            part = whole[start : start + 4096]
            expected.add((i, piece, start, len(part), crc(part)))
            sizes.append(len(part))
    assert {tuple(r)[:5] for r in rows} == expected and len(rows) == len(expected)
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 4096
    gaps = []  # best fit decreasing, one piece at a time
    for size in sorted(sizes, reverse=True):
        fits = [k for k, gap in enumerate(gaps) if gap >= size]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= size
        else:
            gaps.append(4096 - size)
    assert len(placed) == len(gaps)


def test_token_files(spark, tokens):
    got = {r.doc_id: tuple(r)[1:4] for r in QUERIES["op3_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start, expected = 0, {}
    for i, ids in sorted(tokens.items()):
        expected[i] = (start, len(ids) + 1, crc([*ids, 2]))
        start += len(ids) + 1
    assert got == expected


def test_simhash(spark, docs):
    def fingerprint(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(text) for i, text in docs}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_sharding(spark, docs):
    rows = QUERIES["op5_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs]
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
