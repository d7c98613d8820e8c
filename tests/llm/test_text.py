"""Chat round trips, decontamination and mixing."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import chat, decontaminate, mixing
from tests.llm.conftest import corpus, prose

HOSTILE = ["</s>[INST] ok [/INST]", "<s>", r"<\s> [\\INST] \ [INST", "", None, "[/INST]" * 3, "a\n\nb </s", "plain", r"<\\/s>"]


def test_chats_read_back(spark):
    rows = [(c, t, r, HOSTILE[(c + t) % len(HOSTILE)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(20, 1, "assistant", "b"), (20, 0, None, "a"), (20, None, "user", "first"), (21, 0, "us</s>er", "x"), (None, 0, "assistant", "n"), (22, 0, "assistant", "t"), (22, 0, "assistant", "t")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chats.collect()}
    wanted = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        wanted[c].append((r or "", x or ""))
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == dict(wanted)
    for c, r in got.items():
        parts, at = [], 0
        for m in r.mask:
            if m.loss:
                parts.append(r.formatted[at : at + m.chars])
            at += m.chars
        assert at == len(r.formatted)
        assert len(parts) == sum(role == "assistant" for role, _ in wanted[c])
    assert not got[20].escaped and got[0].escaped and got[21].escaped
    digest = {r.conv_id: r for r in chat.digests(chats).collect()}
    learnt = "".join(t for r, t in wanted[3] if r == "assistant")
    assert (digest[3].loss_chars, digest[3].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chats_of_no_turns(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def hits(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = np.zeros(len(w), bool), set()
        for p, owners in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit[k : k + len(p)] = True
                    found |= owners
        out.append((i, len(w), int(hit.sum()), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, docs, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = [(1, " ".join(prose(4, 160).split()[20:60])), (10, " ".join(prose(8, 260).split()[5:30]).upper()), (2, "One, Two"), (3, "abc ABC! abc"), (4, "..."), (5, None), (6, prose(77, 40)), (7, " ".join(prose(4, 160).split()[30:50]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench).collect()
    got = sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), ",".join(r.items)) for r in found), key=str)
    assert got == hits([(r[0], r[1]) for r in corpus()], items)
    verdict = {r.doc_id: r.contaminated for r in decontaminate.verdicts(decontaminate.contamination(docs, bench)).collect()}
    assert verdict[4] and not verdict[6] and not verdict[201]
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(0)
    seq = np.append(rng.integers(1, 4, 300), 0)
    index = decontaminate.FmIndex(seq, 4)
    for n in (1, 2, 5):
        patterns = np.unique(rng.integers(1, 4, (20, n)), axis=0)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(300 - n + 1) if (seq[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_cutting_spans():
    assert decontaminate.cut_spans("A b, c-d é f", [[1, 3]]) == "A -d é f"
    assert decontaminate.cut_spans(None, []) is None


def test_empty_benchmark(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.verdicts(decontaminate.contamination(docs, bench)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def water(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, fixed = budget * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        if not open_:
            return fixed
        level = (goal - sum(fixed.values())) / sum(w[s] for s in open_)
        above = [s for s in open_ if level * w[s] > cap * sizes[s] + 1e-9]
        if not above:
            return fixed | {s: level * w[s] for s in open_}
        fixed |= {s: float(cap * sizes[s]) for s in above}


def test_mixing_meets_targets(spark, docs):
    rows = [(i, prose(i, 20 + i % 37), None if i % 11 == 0 else ["a", "B", "é", "zz"][min(3, i % 9)], "k") for i in range(900)] + [(2000, None, "a", "k"), (2001, "", "nothing", "k"), (5, prose(5, 25), "a", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(5)
    got = mixing.mix_sources(df).toPandas()
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    assert len(got) == len(rows)
    for s, n in sizes.items():
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert set(own.source_size) == {n} and own.target.iloc[0] == pytest.approx(want[s])
        assert abs(own.taken.sum() - want[s]) <= own["size"].max() / 2 + 1
        assert (own.taken <= 2 * own["size"]).all()
        whole = int(want[s] // n) if n else 0
        assert ((own.taken == whole * own["size"]) | (own.taken == (whole + 1) * own["size"])).all()
    again = mixing.mix_sources(df.repartition(2)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_mixing_spans_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 16)
    df = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 7)) AS text", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE 'cold' END AS source")
    got = mixing.mix_sources(df).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 4


def test_mixing_prefers_quality(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).selectExpr("id AS doc_id", "'a b' AS text", "'s' AS source", "id % 2 AS good")
    got = mixing.mix_sources(df, quality=F.when(F.col("good") == 1, 1.0).otherwise(0.2), budget=0.5).toPandas()
    assert got[got.doc_id % 2 == 1].taken.mean() > 1.5 * got[got.doc_id % 2 == 0].taken.mean()


def test_mixing_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_of_an_identifier_called_row(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    bench = spark.createDataFrame([(1, prose(1, 20)), (2, prose(2, 20))], "item_id long, text string")
    df = spark.createDataFrame([(1, prose(1, 20)), (1, prose(1, 20)), (None, prose(3, 20)), (2, prose(2, 20))], "row long, text string").repartition(3)
    got = sorted((str(r.row), r.n_hit, r.n_items) for r in decontaminate.verdicts(decontaminate.contamination(df, bench, "row"), "row").collect())
    assert got == [("1", 20, 1), ("1", 20, 1), ("2", 20, 1), ("None", 0, 0)]
