"""Repeated windows of words against a plain count of all windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import substring_dedup as sd

SMALL = sd.WindowConfig(words=5, range_bits=16, part_windows=64, unit_bytes=2_000)


def brute(rows, size):
    """(identifier, kept, words, removed) of every row."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((str(doc_id), " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.kept, r.n_words, r.n_removed) for r in df.collect())


@pytest.mark.parametrize("config", [sd.WindowConfig(), SMALL])
def test_equals_a_plain_count(docs, config):
    got = found(sd.remove_repeated_windows(docs, config=config))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], config.words)
    assert any(r[3] for r in got) and any(not r[3] and r[2] > 100 for r in got)


def test_a_full_sketch_loses_nothing(spark):
    """Where nearly every cell counts two, the exact pass alone decides."""
    rows = [(i, prose(i % 7, 80) + f"\nown {i} " + prose(100 + i, 60)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tight = sd.WindowConfig(words=5, spread=1, range_bits=16, unit_bytes=1_000)
    texts = [sd._Text([len(t.encode())], sd._pack(t.encode()), 5) for _, t in rows]
    narrow = 1 << 10
    estimates = Counter(c for t in texts for c in sd._cells(t.window_hashes(), 0, narrow).tolist())
    truth = Counter(h for t in texts for h in t.window_hashes().tolist())
    for t in texts:
        for h, c in zip(t.window_hashes().tolist(), sd._cells(t.window_hashes(), 0, narrow).tolist()):
            assert estimates[c] >= truth[h]
    assert found(sd.remove_repeated_windows(docs, config=tight)) == brute(rows, 5)


def test_case_white_space_borders_and_long_texts(spark):
    a, b = [f"w{i}" for i in range(40)], ["same"] * 100
    rows = [
        (1, " ".join(a)), (2, " ".join(a).upper()), (3, "\n\t".join(a)), (4, " ".join(a[:34])), (5, " ".join(a[6:])), (6, " ".join(b)), (7, "  ".join(b[:34])),
        (8, " ".join(a[:20])), (9, " ".join(a[20:])), (10, "x" * 300_000 + " " + " ".join(a)), (11, ""), (12, None), (13, " \n "), (14, "é ü " * 36),
        (15, " ".join(f"v{i}" for i in range(60_000))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found(sd.remove_repeated_windows(docs)) == brute(rows, 35)


def test_one_passage_everywhere(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{prose(i, 20)} {shared} {prose(500 + i, 20)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(sd.remove_repeated_windows(docs, config=sd.WindowConfig(unit_bytes=4_000, range_bits=16)))
    assert got == brute(rows, 35) and all(r[3] >= 60 for r in got)


def test_repeated_rows_null_identifiers_and_no_rows(spark, empty):
    text = prose(3, 50)
    rows = [(1, text), (1, text), (None, prose(4, 50)), (None, prose(4, 50)), (2, prose(5, 50))]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, unit long, blob string")
    assert found(sd.remove_repeated_windows(docs)) == brute(rows, 35)
    assert sd.remove_repeated_windows(empty).collect() == []
    assert found(sd.remove_repeated_windows(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"))) == [("1", "", 0, 0), ("2", "a b", 2, 0)]


@pytest.mark.parametrize("n", [0, 1, 5, 600, 3_000, 60_000])
def test_cells_survive_packing(n):
    rng = random.Random(n)
    cells = np.array(sorted(rng.sample(range(1 << 16), n)), np.int64)
    assert (sd.unpack_cells(sd.pack_cells(cells, 16), n, 16) == cells).all()
    wide = np.array(sorted(rng.sample(range(1 << 22), n)), np.int64)
    assert (sd.unpack_cells(sd.pack_cells(wide, 22), n, 22) == wide).all()
