"""The source divergence audit against exact plain arithmetic."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        total = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def p(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}

        own, q = p(counts[lang, source]), p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        parts = {"pair": [(sum(f(own[t], other[t]) for t in kept), s) for s in sources if s != source for other in [p(counts[lang, s])]]}
        parts["term"] = [(f(own[t], q[t]), t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for i in range(260):
        source = None if i % 50 == 7 else f"s{min(i % 9, 4)}"
        own = vocabulary[(hash(source or "") % 3) * 20 :] if source is None else vocabulary[int(source[1]) * 10 :]
        words = [rng.choice(own[: 5 + i % 60]) for _ in range(i % 40)]
        rows.append((" ".join(w.upper() if rng.random() < 0.2 else w for w in words) + rng.choice(["", "!", "1,2"]), rng.choice(["en", "de", None]), source))
    rows += [(None, "en", "s9"), ("", "fr", "s1"), ("only here", "fr", "s2"), (None, None, None), ("ÄB äb Äb" * 5, "en", "s1")]
    return rows


@pytest.mark.parametrize("config", [dv.DivergenceConfig(), dv.DivergenceConfig(part_terms=8, fan_in=2, flush=50, chunk=16), dv.DivergenceConfig(min_docs=1, top=2, part_terms=16)])
def test_equals_plain_arithmetic(spark, config):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    assert found(dv.audit_sources(docs, config=config)) == brute(rows, config.min_docs, config.top)


def test_ties_go_by_utf8(spark):
    rows = [(f"{a} {b}", "en", s) for s, pair in (("x", ("b", "é")), ("y", ("a", "漢"))) for _ in range(12) for a, b in [pair]]
    docs = spark.createDataFrame([(1, *r) for r in rows], SCHEMA)
    assert found(dv.audit_sources(docs)) == brute(rows)


def test_no_rows_and_clashing_columns(spark):
    assert dv.audit_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "text string, lang string, source string, part int, term string, n long")
    assert found(dv.audit_sources(docs)) == brute(rows)


def test_long_text(spark):
    rows = [(" ".join(["long", "word" * 50] * 60_000), "en", "a")] + [("long tail", "en", "b")] * 12
    docs = spark.createDataFrame([(1, *r) for r in rows], SCHEMA)
    assert found(dv.audit_sources(docs)) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=60), st.integers(1, 4), st.integers(1, 7))
def test_skyband_equals_its_definition(points, k, block):
    n, total = (np.array([p[i] for p in points], np.int64) for i in range(2))
    want = [i for i in range(len(points)) if sum(n[j] >= n[i] and total[j] <= total[i] for j in range(i)) < k]
    assert dv.skyband(n, total, k, block).tolist() == want


def test_shares_are_exact_for_large_counts(spark):
    rows = [(0, 0, 1), (7, 9, 3), (10**15, 8 * 10**15, 10**6), (5 * 10**14 + 1, 7 * 10**15, 12_345)]
    want = [1 + 10**9 * (n + 2) // (size + 2 * v) for n, size, v in rows]
    got = spark.createDataFrame(rows, "n long, size long, v long").select(dv.share("n", "size", "v").alias("p")).collect()
    assert [r.p for r in got] == want
    assert [int(dv.shares(np.int64(n), np.int64(size), v)) for n, size, v in rows] == want
