"""Packing and token files: round trips against the tokenizer on whole texts."""

import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewash.llm import packing, token_files, tokens
from tidewash.llm.tokens import default_tokenizer, encoder

TEXTS = [
    (1, "The quick brown fox, it's 12 o'clock. <|endoftext|> Été à Straße.\nNew line"), (2, ""), (3, None),
    (4, "word " * 9000), (5, "same text."), (5, "same text."), (None, "no id"), (7, "tab\tand\x1codd\x85 blanks  İSTANBUL ΣΑΣ 你好 🙂"),
]
SCHEMA = "doc_id bigint, text string, length string, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)


library = functools.cache(lambda: encoder(default_tokenizer()).tokenizer)


def whole(text, end):
    return library().encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_encoder_is_the_tokenizer():
    encode = encoder(default_tokenizer())
    texts = [text for _, text in TEXTS]
    for text, ids in zip(texts, encode.encode_all(texts, 9)):
        assert ids.tolist() == whole(text, 9)
    assert encode.encode_all([], 9) == []


def test_long_texts_go_in_portions(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 50)
    encode = encoder(default_tokenizer())
    texts = [TEXTS[0][1] * 9, "x" * 300, "", None, "é " * 200, "a\n" * 100 + "b" * 120 + " <|endoftext|> end", " " * 400]
    for text, ids in zip(texts, encode.encode_all(texts, 9)):
        assert ids.tolist() == whole(text, 9)


def test_slices_keep_rows_and_bytes_small():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (10, 2000, 5, 5, 9000, 1, 1, 1)] * 40})
    parts = list(tokens.slices([batch], 64, 4000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert max(p.num_rows for p in parts) <= 64 and all(p.num_rows == 1 or p.nbytes <= 4000 for p in parts)


def test_packs_every_piece_once(spark):
    packed = packing.pack(frame(spark, TEXTS), capacity=64)
    rows = packed.collect()
    expected = []
    for doc_id, text in TEXTS:
        ids = whole(text, packing.END)
        expected += [(doc_id, k, s, len(ids[s : s + 64]), crc(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x) for x in (whole(t, 1) for _, t in TEXTS))
    assert len(places) <= -(-total // 64) + 1
    made = packing.sequences(packed).collect()
    assert sum(r.length for r in made) == total
    for r in made:
        assert len(r.ids) == 2 * r.length and r.length == sum(n for _, n in places[r.sequence_id])


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.lognormal(6, 1.3, 50_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    slots = packing.best_fit_plan(counts)
    placed = {}
    for length, rank, number, first, offset in slots:
        for i in range(number):
            placed.setdefault(first + i, []).append((offset, length))
    assert sum(n for _, _, n, _, _ in slots) == len(lengths)
    for taken in placed.values():
        taken.sort()
        assert all(a + b == c for (a, b), (c, _) in zip(taken, taken[1:])) and taken[0][0] == 0 and sum(taken[-1]) <= 4096
    assert len(placed) <= -(-int(lengths.sum()) // 4096) * 1.001 + 1


def test_empty_table(spark, tmp_path):
    assert packing.pack(frame(spark, [])).count() == 0
    token_files.write_token_files(frame(spark, []), str(tmp_path / "t"))
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_number_coding(n):
    rng = np.random.default_rng(n)
    numbers = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    ids = list(range(min(n, 1)))
    got, sizes, back = token_files.decode_block(token_files.encode_block(ids, [n][: len(ids)], numbers))
    assert got == ids and back.tolist() == numbers.tolist()


def test_files_give_the_ids_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(token_files, "PART_TOKENS", 3000)
    path = str(tmp_path / "files")
    token_files.write_token_files(frame(spark, TEXTS), path)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks)))
    assert all(a["count"] >= b["count"] for a, b in zip(ranks, ranks[1:]))
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (doc_id, text) in zip(rows, ordered, strict=True):
        ids = whole(text, token_files.END)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
