"""Language model, quality classifier, licence scan: definitions, held-out accuracy and edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import licenses, lm_score, quality
from tidemark.llm.common import Scratch
from tests.llm.conftest import corpus, prose


def held(i, n, k):
    return zlib.crc32((b"" if i is None else str(i).encode())) % n == k


def test_lm_counts_and_base(docs):
    rows = [(r[0], (r[1] or "").encode().lower().split()) for r in corpus()]
    counts = Counter(t for i, w in rows if not held(i, 7, 2) for t in [*w, b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, w in rows:
        own = [*w, b"\n"]
        want[(i, held(i, 7, 2), len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6))] += 1
    got = lm_score.lm_scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_learns_order(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        w = "abcdefgh"[int(rng.integers(8))]
        words = [w]
        for _ in range(60):
            w = chr((ord(w) - 97 + 1) % 8 + 97) if rng.uniform() < 0.9 else "abcdefgh"[int(rng.integers(8))]
            words.append(w)
        rows.append((i, " ".join(words)))
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert got.score.sum() > 0.6 * got.base_score.sum()


def test_class_probabilities_sum_to_one(docs, spark):
    config = lm_score.LmConfig(classes=9, rows=64)
    scratch = Scratch(spark, "t")
    table = lm_score.train_classes(lm_score.tokenised(docs, "doc_id", "text", config, scratch)[0], config, scratch)
    assert np.exp(table).sum(axis=1) == pytest.approx(np.ones(config.classes**2))


@pytest.mark.parametrize("unit_bytes", [1, 4000, 1 << 24])
def test_lm_scores_equal_brute_force(docs, spark, unit_bytes):
    """Counts of words, pairs and triples from plain dictionaries, under the fitted class softmax and strengths."""
    config = lm_score.LmConfig(unit_bytes=unit_bytes, part_bytes=5000)
    scratch = Scratch(spark, "t")
    units, _, n_parts = lm_score.tokenised(docs, "doc_id", "text", config, scratch)
    model, _ = lm_score.fit_lm(units, n_parts, config, scratch)
    rows, ones, twos, threes = [], Counter(), Counter(), Counter()
    for r in corpus():
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        classes = lm_score.tokens(data, np.array([0, len(data)]), config)[0] & np.uint64(127)
        words = ["<s>", "<s>", *(r[1] or "").encode().lower().split(), "</s>"]
        rows.append((r[0], words, [0, 0, *classes.tolist()]))
        if not held(r[0], 7, 2):
            for a, b, c in zip(words, words[1:], words[2:]):
                ones[c] += 1
                twos[b, c] += 1
                threes[a, b, c] += 1
    ones["<s>"] = twos["<s>", "<s>"] = ones["</s>"]
    want = Counter()
    for i, words, classes in rows:
        score = 0.0
        for j in range(2, len(words)):
            a, b, c = words[j - 2 : j + 1]
            x, y, z = (int(v) for v in classes[j - 2 : j + 1])
            p = math.exp(model.log_class[x * config.classes + y, z] - model.log_sizes[z]) * (ones[c] + 1)
            p = (twos[b, c] + model.strength[0] * p) / (ones[b] + model.strength[0])
            score += math.log10((threes[a, b, c] + model.strength[1] * p) / (twos[a, b] + model.strength[1]))
        want[i, round(score, 5)] += 1
    assert Counter((r.doc_id, round(r.score, 5)) for r in lm_score.lm_scores(docs, config=config).collect()) == want


def test_lm_without_training_rows(spark, empty):
    assert lm_score.lm_scores(empty).count() == 0
    ids = [i for i in range(60) if held(i, 7, 2)][:3]
    got = lm_score.lm_scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3


def labelled(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = prose(i, 150)
        rows.append((i, text.upper() if bad and i % 2 else " | ".join(text.split()) if bad else text))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    test = got[got.held_out]
    assert len(test) > 20 and (test.predicted == test.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got.itertuples())


def test_quality_edge_cases(spark, docs, empty):
    _, labels = labelled(spark)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(docs, labels.where("false")).count() == len(corpus())
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_passages_cover_the_text():
    data = np.frombuffer(("a " * 130 + "B!").encode(), np.uint8)
    x, first = quality.encode_passages(data, np.array([0, 0, len(data), len(data)]), 64)
    assert first.tolist() == [0, 1, 4, 5]
    assert x[0].sum() == 0 and x[3][1] > 0 and x[1][0] == pytest.approx(0.5)


def test_attention_gradient_is_right():
    rng = np.random.default_rng(0)
    model = quality.GatedAttention(4, 1)
    x, first, y = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(model.forward(x, first)["score"]) + (1 - y) * np.log(1 - model.forward(x, first)["score"]))
    before = loss()
    model.fit(x, first, y, quality.QualityConfig(epochs=200, decay=0))
    assert loss() < 0.1 * before


def test_licenses(spark):
    filler = [(i, prose(i, 40)) for i in range(40)]
    said = [
        (100, prose(1, 30) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(2, 20), "Apache-2.0"),
        (101, "Released under the MIT License.\nAll rights reserved.", "MIT,Proprietary"),
        (102, prose(3, 20) + "\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        (103, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        (104, "He had a driving license and the version of events was his own.", ""),
        (105, "", ""),
        (106, None, ""),
    ]
    df = spark.createDataFrame([*filler, *((i, t) for i, t, _ in said)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert {i: got[i].licenses for i, _, _ in said} == {i: w for i, _, w in said}
    assert all(got[i].licenses == "" for i, _ in filler) and got[106].n_paragraphs == 1 and got[100].n_confirmed == 1


def test_licenses_over_line_breaks(spark):
    long = " ".join(f"{w}" for w in prose(4, 5000).replace(".", "").split())
    said = [
        (200, "Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this software.", "MIT"),
        (201, "# This work is licensed under the GNU\n# General Public License, version 3.\n" + prose(6, 40), "GPL-3.0"),
        (202, prose(7, 24) + "\nSubject to the terms of the Mozilla Public License, v.\n2.0. This Source Code Form is subject\nto the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        (203, long + " This work is licensed under the GNU Affero\nGeneral Public License, version 3. " + long, "AGPL-3.0"),
        (204, "This work is licensed under the GNU\n\nGeneral Public License, version 3.", ""),
        (205, "He left his driving\nlicense and the version\nof events was his own", ""),
        (206, "x" * 300_000 + "\n" + "y " * 20_000 + "\n\n\n", ""),
    ]
    df = spark.createDataFrame([*((i, prose(i, 40)) for i in range(40)), *((i, t) for i, t, _ in said)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert {i: got[i].licenses for i, _, _ in said} == {i: w for i, _, w in said}
    assert [got[i].wrapped for i, _, _ in said] == [w for _, _, w in said] and got[200].n_confirmed == 0 and got[200].n_paragraphs == 3


def test_license_identifiers(spark):
    named = {"Apache-2.0": "Apache-2.0", "MIT": "MIT", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "LGPL-2.1": "LGPL", "BSD-3-Clause": "BSD", "MPL-2.0": "MPL-2.0", "AGPL-3.0": "AGPL-3.0", "ISC": "ISC", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0"}
    df = spark.createDataFrame([*((f"p{i}", prose(i, 40)) for i in range(40)), *((n, f"// SPDX-License-Identifier: {n}\n" + prose(3, 24)) for n in named)], "doc_id string, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert {n: got[n] for n in named} == named and all(got[f"p{i}"] == "" for i in range(40))


def test_licenses_give_a_row_per_row(spark):
    rows = [(1, "Released under the MIT License.", "a", 1), (1, "Released under the MIT License.", "a", 1), (None, prose(2, 30), "b", 2), (None, None, "c", 3), (2, prose(5, 30), "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, paragraph string, row int")
    got = sorted((str(r.doc_id), r.n_paragraphs, r.licenses) for r in licenses.scan_licenses(df).collect())
    assert got == [("1", 1, "MIT"), ("1", 1, "MIT"), ("2", 3, ""), ("None", 1, ""), ("None", 3, "")]


def test_licenses_on_an_empty_table(empty):
    assert licenses.scan_licenses(empty).count() == 0
