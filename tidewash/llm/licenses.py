"""Licence scan: a trained paragraph classifier, confirmed by templates.

Paragraphs (lines, and windows over consecutive lines, as notices are often wrapped; long ones
in overlapping windows) are classed by a multinomial logistic
regression on hashed 1- to 3-grams of words. It is trained with numpy on variants of short
licence notices, on notices of no known licence, and on a bounded number of paragraphs of the
corpus as the class "none"; one temperature, fitted on notices kept from the training,
calibrates it. A predicted family counts only if a template of that family agrees with the
paragraph in enough of its words; a notice that no template confirms is "unknown".

Most paragraphs are settled by one sum: each feature has a bound on what it can add to any
class over "none", and a paragraph whose bound proves a probability of 0.5 is "none" without
looking further.

Defined results: a null or empty text has no paragraphs; repeated rows are scanned one by one;
an empty table gives no rows, and the classifier is then trained without "none" paragraphs of
the corpus. Extra columns are not carried.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import table
from tidewash.llm.tokens import slices
from tidewash.llm.word_hashes import LETTERS, Words, mixed

#: Words of one classified paragraph; longer lines are cut into windows half overlapping.
PARAGRAPH_WORDS = 40
FEATURES = 1 << 17
MAX_NONE_DOCS = 300
EPOCHS = 40
VARIANTS = 24
#: Share of a template's 1- and 2-grams that the paragraph must hold to be of its family, or to be a notice at all.
AGREEMENT = 0.6
RESEMBLANCE = 0.2
SEED = 5
NONE, UNKNOWN = "none", "unknown"

# Short forms of public licence notices, by family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Released under CC0 1.0 Universal Public Domain Dedication.", "Licensed under CC0 1.0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v2.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL, version 2 or later.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced without permission.",
        "All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}
# Notices of no family above.
STRANGE = [
    "Licensed under the Foo Community License.", "Released under the Example Open License, version 1.", "Distributed under terms that may change.",
    "This work is licensed under the Acme Public License, version 7.", "You may use this file under the license of your choice.",
    "SPDX-License-Identifier: LicenseRef-custom", "See the license file for details.", "Permission to use this material is granted by the owner.",
]
# Sentences that only look like notices.
PLAIN = [
    "The licence plate of the car was stolen.", "He has a license to drive.", "The public version of the general report is free.",
    "She asked for permission to leave.", "The work was released in version 3 last year.", "Under the terms of the deal, the company pays.",
    "We released the new version under the bridge.", "Software is eating the world.", "The Apache helicopter landed.", "MIT is a university.",
]
CLASSES = [NONE, UNKNOWN, *NOTICES]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all 1- to 3-grams, in order of n."""
    h, text = words.hashes, words.text
    one = h
    two = mixed(h[:-1] * np.uint64(3) + h[1:])
    three = mixed(two[:-1] * np.uint64(5) + h[2:])
    same_two, same_three = text[:-1] == text[1:], text[:-2] == text[2:]
    numbers = np.concatenate([one, two[same_two], three[same_three]])
    return np.concatenate([text, text[:-1][same_two], text[:-2][same_three]]), (numbers >> np.uint64(40)).astype(np.int64) % FEATURES


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) > 0]


def distinct_grams(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each once, in order of the text."""
    text, feature = grams(Words(paragraphs, LETTERS, lower=True))
    return np.divmod(_distinct(text * FEATURES + feature), FEATURES)


def units_of(line: str) -> list[str]:
    """The line, if it has words; a long line as windows of PARAGRAPH_WORDS words that overlap by half."""
    if line.count(" ") < PARAGRAPH_WORDS:
        return [line] if line and not line.isspace() else []
    words = line.split()
    step = PARAGRAPH_WORDS // 2
    return [" ".join(words[k : k + PARAGRAPH_WORDS]) for k in range(0, max(1, len(words) - step), step)]


def paragraphs_of(text: str | None) -> list[str]:
    """The units of all lines."""
    return [unit for line in (text or "").split("\n") for unit in units_of(line)]


def joined_lines(text: str | None) -> list[tuple[str, int, int]]:
    """Windows over consecutive lines with words that reach over a line's end, with the first and last unit they touch."""
    found: list[tuple[str, int, int]] = []
    words: list[str] = []
    ends: list[int] = []  # words up to the end of each line of the block
    firsts: list[int] = [0]  # the first unit of each line, and of the next
    step = PARAGRAPH_WORDS // 2
    for line in [*(text or "").split("\n"), ""]:
        own = line.split()
        if own:
            words += own
            ends.append(len(words))
            firsts.append(firsts[-1] + len(units_of(line)))
            continue
        if len(ends) > 1:
            for k in range(0, max(1, len(words) - step), step):
                one, last = bisect.bisect_right(ends, k), bisect.bisect_left(ends, min(k + PARAGRAPH_WORDS, len(words)))
                if one < last:
                    found.append((" ".join(words[k : k + PARAGRAPH_WORDS]), firsts[one], firsts[last + 1] - 1))
        words, ends, firsts = [], [], [firsts[-1] + len(units_of(line))]
    return found


@functools.cache
def template_sets() -> dict[str, list[frozenset[str]]]:
    return {family: [agreement_set(notice) for notice in notices] for family, notices in [*NOTICES.items(), (UNKNOWN, STRANGE)]}


def agreement_set(paragraph: str) -> frozenset[str]:
    words = "".join(c if c.isalnum() else " " for c in paragraph.lower()).split()
    return frozenset([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


def shares_of(words: frozenset[str]) -> dict[str, float]:
    return {name: max(len(t & words) / len(t) for t in sets) for name, sets in template_sets().items()}


def with_joined(found: list[dict], joined: list[dict]) -> list[dict]:
    """The notices of single units and those of joined lines (with the ``last`` unit) that add to them.

    A family confirmed over several lines replaces unknown ones of its lines that resemble it most.
    """
    for notice in joined:
        inside = [x for x in found if notice["paragraph"] <= x["paragraph"] <= notice["last"]]
        if notice["family"] == UNKNOWN and inside or any(x["family"] == notice["family"] for x in inside):
            continue
        parts = []
        if notice["family"] != UNKNOWN:
            for x in inside:
                shares = shares_of(agreement_set(x["text"])) if x["family"] == UNKNOWN else {}
                if shares and max(shares, key=shares.get) == notice["family"]:
                    parts.append(x)
        found = [x for x in found if not any(x is y for y in parts)] + [{k: v for k, v in notice.items() if k != "last"}]
    return sorted(found, key=lambda x: x["paragraph"])


@dataclass
class Model:
    weights: np.ndarray  # FEATURES x classes
    bias: np.ndarray
    temperature: float

    def __post_init__(self) -> None:
        self.most = (self.weights[:, 1:] - self.weights[:, :1]).max(axis=1)
        self.bound = np.maximum(self.most, 0)
        self.bound_bias = float((self.bias[1:] - self.bias[0]).max())

    def probabilities(self, paragraphs: list[str]) -> np.ndarray:
        """Class probabilities of each paragraph; a feature counts once."""
        text, feature = distinct_grams(paragraphs)
        n = len(paragraphs)
        z = np.stack([np.bincount(text, self.weights[feature, k], n) for k in range(len(CLASSES))], axis=1)
        z = (z + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def candidates(self, paragraphs: list[str]) -> np.ndarray:
        """The paragraphs that may have a probability of "none" below 0.5.

        It is 0.5 at least where each other class lies temperature x ln(their number) below "none".
        """
        n = len(paragraphs)
        margin = self.bound_bias + self.temperature * float(np.log(len(CLASSES) - 1))
        text, feature = grams(Words(paragraphs, LETTERS, lower=True))
        open_ = np.bincount(text, self.bound[feature], n) + margin >= 0
        # The same with each feature once, so that what speaks against counts too.
        rest = open_[text] & (self.most[feature] != 0)
        text, feature = np.divmod(_distinct(text[rest] * FEATURES + feature[rest]), FEATURES)
        return np.flatnonzero(open_ & (np.bincount(text, self.most[feature], n) + margin >= 0))

    def families(self, paragraphs: list[str]) -> list[tuple[int, str, float]]:
        """(number, family, probability) of the paragraphs that are notices."""
        at = self.candidates(paragraphs) if paragraphs else []
        found = []
        if not len(at):
            return found
        chosen = [paragraphs[k] for k in at]
        for k, paragraph, p in zip(at.tolist(), chosen, self.probabilities(chosen)):
            if p[0] >= 0.5:
                continue
            family = CLASSES[2:][int(np.argmax(p[2:]))]
            words = agreement_set(paragraph)
            shares = shares_of(words)
            if max(shares.values()) < RESEMBLANCE:
                continue
            confirmed = p[CLASSES.index(family)] >= p[1] and shares[family] >= AGREEMENT
            found.append((k, family if confirmed else UNKNOWN, float(p[CLASSES.index(family)] if confirmed else 1 - p[0])))
        return found


def variants(notice: str, others: list[str], rng: np.random.Generator, number: int) -> list[str]:
    """The notice, and the notice with words dropped, cased otherwise or with ordinary words around it."""
    made = [notice]
    for _ in range(number - 1):
        words = [w for w in notice.split() if rng.random() > 0.06] or notice.split()
        if rng.random() < 0.2:
            words = [w.upper() for w in words]
        if rng.random() < 0.4 and others:
            near = others[int(rng.integers(len(others)))].split()[: int(rng.integers(1, 12))]
            words = [*near, *words] if rng.random() < 0.5 else [*words, *near]
        made.append(" ".join(words))
    return made


def train(none_paragraphs: list[str]) -> Model:
    rng = np.random.default_rng(SEED)
    rows: list[tuple[str, int]] = [(p, 0) for p in none_paragraphs]
    rows += [(v, 0) for p in PLAIN for v in variants(p, none_paragraphs, rng, VARIANTS // 2)]
    rows += [(v, 1) for p in STRANGE for v in variants(p, none_paragraphs, rng, VARIANTS)]
    rows += [(v, k) for k, family in enumerate(CLASSES[2:], 2) for p in NOTICES[family] for v in variants(p, none_paragraphs, rng, VARIANTS)]
    kept = np.arange(len(rows)) % 6 == 0  # for the temperature
    text, feature = distinct_grams([p for p, _ in rows])
    labels = np.array([k for _, k in rows])
    starts = np.searchsorted(text, np.arange(len(rows) + 1))
    weights, bias = np.zeros((FEATURES, len(CLASSES)), np.float32), np.zeros(len(CLASSES))
    bias[0] = 1.0  # a paragraph without known features is "none"
    squares = np.full((FEATURES, 1), 1e-6)
    weight_of = 1 / np.maximum(np.bincount(labels, minlength=len(CLASSES)), 1)
    weight_of = weight_of / weight_of[labels[~kept]].mean()
    training = np.flatnonzero(~kept)
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(training), max(1, len(training) // 128)):
            at = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in batch])
            row = np.repeat(np.arange(len(batch)), np.diff(starts)[batch])
            z = np.stack([np.bincount(row, weights[feature[at], k], len(batch)) for k in range(len(CLASSES))], axis=1) + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(batch)), labels[batch]] -= 1
            z *= weight_of[labels[batch]][:, None] / len(batch)
            used, place = np.unique(feature[at], return_inverse=True)
            step = np.stack([np.bincount(place, z[row, k], len(used)) for k in range(len(CLASSES))], axis=1)
            squares[used] += (step**2).sum(axis=1, keepdims=True)
            weights[used] -= 0.3 * step / np.sqrt(squares[used])
            bias[1:] -= 0.01 * z.sum(axis=0)[1:]
    model = Model(weights, bias, 1.0)
    kept_rows = [rows[k] for k in np.flatnonzero(kept)]
    logits = np.log(np.maximum(model.probabilities([p for p, _ in kept_rows]), 1e-12))
    truth = np.array([k for _, k in kept_rows])

    def loss(t: float) -> float:
        z = logits / t
        z = z - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - z.max(axis=1, keepdims=True)
        return float(-z[np.arange(len(truth)), truth].mean())

    model.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    return model


def fit(docs: DataFrame, max_docs: int = MAX_NONE_DOCS) -> Model:
    """Trained with paragraphs of ``max_docs`` documents (smallest hash of their id) as "none".

    Paragraphs with a word that tells a notice are not taken as "none"; at most 20 of a document are.
    """
    telling = r"(?i)licen[cs]|copyright|rights reserved|spdx|creative commons|permission|redistribut"
    ids = docs.select(F.col("doc_id").alias("chosen")).where("chosen IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("chosen"), "chosen").limit(max_docs)
    lines = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("chosen")).select(
        F.slice(F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(telling)), 1, 20).alias("lines")
    )
    short = lines.select(F.transform("lines", lambda x: F.array_join(F.slice(F.split(x, " "), 1, PARAGRAPH_WORDS), " ")).alias("lines"))
    return train(sorted(line for r in short.collect() for line in r["lines"] or []))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, and the notices (paragraph from 0, family, probability, text) of each document.

    Joined lines are not counted as paragraphs; a notice over several has the number of its first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notice = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("text", pa.string())])
        for batch in slices(batches, 64):
            each = [paragraphs_of(text) for text in batch["text"].to_pylist()]
            every = [p for paragraphs in each for p in paragraphs]
            first = np.cumsum([0, *map(len, each)])
            found: list[list[dict]] = [[] for _ in each]
            for k, family, p in model.families(every):
                doc = int(np.searchsorted(first, k, side="right")) - 1
                found[doc].append({"paragraph": k - int(first[doc]), "family": family, "probability": round(p, 6), "text": every[k]})
            windows = [joined_lines(text) for text in batch["text"].to_pylist()]
            every_window = [w for of_doc in windows for w in of_doc]
            first = np.cumsum([0, *map(len, windows)])
            joined: list[list[dict]] = [[] for _ in each]
            for k, family, p in model.families([w for w, _, _ in every_window]):
                text, one, last = every_window[k]
                doc = int(np.searchsorted(first, k, side="right")) - 1
                joined[doc].append({"paragraph": one, "family": family, "probability": round(p, 6), "text": text, "last": last})
            found = [with_joined(a, b) if b else a for a, b in zip(found, joined)]
            columns = [batch["doc_id"], pa.array(map(len, each), pa.int64()), pa.array(found, pa.list_(notice))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_paragraphs", "notices"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_paragraphs bigint, notices array<struct<paragraph:int,family:string,probability:double,text:string>>"
    return texts.mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    return scan(docs, fit(docs)).select(
        "doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), F.array_join(families, ",").alias("families"),
        F.array_max(F.transform("notices", lambda n: n["probability"])).alias("probability"),
    )
