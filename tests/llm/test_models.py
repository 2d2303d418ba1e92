"""Quality scores and licence scan: held-out accuracy, and the paths without data."""

import zlib

import duckdb
import numpy as np

from tidewash.llm import licenses, quality

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = {r.doc_id: r for r in quality.op10_quality_classifier(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(got) == sorted(d for d, in docs)
    for doc_id, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    test = [(got[d].predicted, q) for d, q in labels if got[d].held_out]
    assert np.mean([p == q for p, q in test]) > 0.93


def test_quality_edge_cases(spark):
    schema = "doc_id bigint, text string, score string, row int"
    rows = [(1, "good plain words here"), (2, ""), (3, None), (None, "x"), (4, "word " * 100_000), (4, "word " * 100_000)]
    docs = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], schema)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    labels = spark.createDataFrame([(2, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0), (1, 1, 0)], labels.schema)
    scores = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert quality.good_documents(docs.limit(0), labels).count() == 0


def test_one_row_of_a_labelled_id_trains(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "other"), (3, None), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id bigint, quality int")
    rows = quality.training_rows(docs, labels, 100).collect()
    known = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r.doc_id for r in rows) == known


def test_neighbours_of_all_documents(spark):
    texts = ["a b c a b", None, "", "x", "b c d e " * 50, "x y"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for text in texts:
        quality.neighbour_sums([text], sums)
    assert sums.any() and np.array_equal(quality.all_neighbours(docs), sums)
    assert not quality.all_neighbours(docs.limit(0)).any()


def test_features_of_a_long_text_in_portions(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["a", "Bc.", "d,", "word", "word"], 4000)) + "  \n"
    model = quality.Model(rng.normal(0, 1, (quality.BUCKETS, quality.DIMENSIONS)), np.zeros(1), np.ones(1), [], 1.0)
    whole = model.features([text, "short", None])
    monkeypatch.setattr(quality, "SLICE_BYTES", 300)
    assert len(list(quality.portions(text.encode(), 300))) > 10
    assert np.allclose(model.features([text, "short", None]), whole, atol=1e-12)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1, 5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2.4 < quality.best_temperature(z * 3, y) < 3.6


def test_licences_of_the_corpus(spark):
    got = {r.doc_id: r for r in licenses.op7_license_scan(spark, SF).collect()}
    known = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary",
    }
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        expected = {family for line, family in known.items() if line in text}
        assert set(got[doc_id].families.split(",")) - {""} == expected, doc_id


def test_licence_classes_and_screening():
    rows = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()
    paragraphs = [p for text, in rows for p in licenses.paragraphs_of(text)]
    model = licenses.train([p for p in paragraphs[:800] if "icense" not in p and "reserved" not in p])
    cases = {
        "Licensed under the MIT license": "MIT", "SPDX-License-Identifier: BSD-2-Clause": "BSD", "GNU LESSER GENERAL PUBLIC LICENSE version 2.1": "LGPL",
        "Here begins text. Licensed under CC BY-SA 4.0.": "CC-BY-SA", "This file is licensed under the Zonk License.": licenses.UNKNOWN,
    }
    for text, family in cases.items():
        assert [f for _, f, _ in model.families([text])] == [family]
    assert model.families([]) == [] and model.families(["The cat sat on the mat."]) == []
    skipped = np.setdiff1d(np.arange(len(paragraphs)), model.candidates(paragraphs))
    assert (model.probabilities([paragraphs[k] for k in skipped]).argmax(axis=1) == 0).all()


def test_screening_keeps_what_none_does_not_hold():
    """"None" is the largest class, but with many others close behind it has less than a half."""
    weights = np.zeros((licenses.FEATURES, len(licenses.CLASSES)))
    bias = np.zeros(len(licenses.CLASSES))
    for temperature in (0.5, 1.0, 2.0):
        bias[0] = 0.9 * temperature * np.log(len(bias) - 1)
        model = licenses.Model(weights, bias, temperature)
        p = model.probabilities(["Released under the MIT License."])[0]
        assert p.argmax() == 0 and p[0] < 0.5 and model.candidates(["Released under the MIT License."]).tolist() == [0]
        bias[0] = 1.1 * temperature * np.log(len(bias) - 1)
        model = licenses.Model(weights, bias, temperature)
        assert model.probabilities(["Released."])[0][0] > 0.5 and not len(model.candidates(["Released."]))


def test_licence_edge_cases(spark):
    schema = "doc_id bigint, text string, family string"
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "Released under the MIT License."), (4, "w " * 50_000 + "Licensed under the Apache License, Version 2.0."), (4, "a\nReleased under the MIT License.\nb")]
    docs = spark.createDataFrame([(a, b, "f") for a, b in rows], schema)
    got = [(r.doc_id, r.n_paragraphs if r.doc_id != 4 or r.n_paragraphs < 5 else "many", sorted({n.family for n in r.notices})) for r in licenses.scan(docs, licenses.fit(docs)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, []), (2, 0, []), (3, 0, []), (None, 1, ["MIT"]), (4, "many", ["Apache-2.0"]), (4, 3, ["MIT"])], key=str)
    assert licenses.scan(docs.limit(0), licenses.fit(docs.limit(0))).count() == 0


WRAPPED = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
    "BSD": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


def test_wrapped_notices(spark):
    names = list(WRAPPED)
    plain = "The cat sat on the mat.\nIt was a long day in the town\nand the rain did not stop."
    rows = [(k, f"{plain}\n\n{WRAPPED[name]}\n\n{plain}") for k, name in enumerate(names)] + [(9, plain)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.fit(given)).collect()}
    assert not got[9].notices
    for k, name in enumerate(names):
        assert name in {n.family for n in got[k].notices}, (name, got[k].notices)
        assert got[k].n_paragraphs == len(licenses.paragraphs_of(rows[k][1]))
