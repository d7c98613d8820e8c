"""Exact, near, line and string dedup against brute force."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidemark.llm import exact_dedup, line_dedup, near_dedup, repeats
from tidemark.llm.common import Scratch
from tidemark.llm.components import components
from tests.llm.conftest import corpus, prose

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in corpus():
        groups[SPACES.sub(" ", r[1] or "")].append(r[0])
    assert len(got) == len(corpus())
    assert sum(r.kept for r in got) == len(groups)
    for r in got:
        group = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        assert (r.keep_id, r.group_size) == (min((x for x in group if x is not None), default=None), len(group))
        if r.kept:
            assert r.doc_id == r.keep_id


def test_exact_dedup_group_over_many_partitions(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i % 6}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all((got[i].keep_id, got[i].group_size) == (1, 200) for i in range(300) if i % 3)
    assert [i for i in got if got[i].kept] and sorted(i for i in got if got[i].kept) == [0, 1, 3]


def test_drop_copies_keeps_columns(plain):
    out = exact_dedup.drop_copies(plain)
    assert out.columns == plain.columns and out.count() == exact_dedup.exact_dedup(plain).where("kept").count()


def bags(texts, n=5):
    out = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        out.append(Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else Counter())
    return out


def near_classes(rows):
    b = bags([r[1] for r in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((b[i] & b[j]).values())
            total = sum((b[i] | b[j]).values())
            if (total and shared / total >= 0.8) or (not total and not b[i] and not b[j]):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r[0])
    return classes


def test_near_duplicates_equal_brute_force(docs):
    want = {}
    sizes = Counter()
    for c in near_classes(corpus()).values():
        for i in c:
            want.setdefault(i, min((x for x in c if x is not None), default=None))
        sizes[min(x for x in c if x is not None)] = len(c)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(corpus()) and sum(r.kept for r in got) == len(sizes)
    for r in got:
        assert r.class_id == want[r.doc_id] and r.class_size == sizes[r.class_id]


def test_near_duplicates_in_a_crowded_bucket(spark):
    """Many texts that share most, but not enough, of their words, and chains of links between them."""
    head = prose(99, 120)
    rows = [(i, head + "\n" + prose(i, 90)) for i in range(25)] + [(100 + i, head + "\n" + prose(i % 3, 90) + f" tail{i}") for i in range(12)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: min(c) for c in near_classes(rows).values() for i in c}
    assert got == want


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    shared, rest = rng.integers(0, 2**63, 60, np.uint64), rng.integers(0, 2**63, (2, 30), np.uint64)
    weight = rng.integers(1, 20, 60)
    a = (np.concatenate([shared, rest[0]]), np.concatenate([weight, np.full(30, 3)]))
    b = (np.concatenate([shared, rest[1]]), np.concatenate([weight + rng.integers(0, 4, 60), np.full(30, 3)]))
    order = lambda x: tuple(v[np.argsort(x[0])] for v in x)
    true = near_dedup.overlap(order(a), order(b))
    hashes, owner, count = np.concatenate([a[0], b[0]]), np.repeat([0, 1], 90), np.concatenate([a[1], b[1]])
    s = near_dedup.bag_minhash(hashes, owner, count, 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.03)


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 5), (5, 200), (7, 7), (300, 301)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components(df, Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 100: 5, 5: 5, 200: 5, 300: 300, 301: 300}


def line_rule(rows, least):
    """Lines that go: in a run of enough words whose lines also start earlier."""
    texts = [(i, (t or "").split("\n")) for i, t in sorted(rows, key=lambda r: r[0])]
    gone = {i: set() for i, _ in texts}
    for x, (i, a) in enumerate(texts):
        for y in range(x + 1):
            b = texts[y][1]
            for s in range(len(a)):
                for q in range(len(b)):
                    if y == x and q >= s:
                        break
                    n = 0
                    while s + n < len(a) and q + n < len(b) and a[s + n] == b[q + n]:
                        n += 1
                    if n and sum(len(z.split()) for z in a[s : s + n]) >= least:
                        gone[i] |= set(range(s, s + n))
    return gone


def test_lines_equal_brute_force(plain):
    rows = [(r.doc_id, r.text) for r in plain.collect()] + [(300, "a\nb\nc\nd"), (301, "b\nc\nx\nb\nc"), (302, "a\n\nb"), (303, "q\na\n\nb\nc"), (304, "x y z\nx y z")]
    df = plain.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for least in (3, 6):
        gone = line_rule(rows, least)
        got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=least).collect()}
        for i, t in rows:
            lines = (t or "").split("\n")
            assert got[i].kept == "\n".join(x for k, x in enumerate(lines) if k not in gone[i]), i
            assert (got[i].n_lines, got[i].n_removed) == (len(lines), len(gone[i]))


def test_lines_with_repeated_identifiers(docs):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(corpus()) and sum(1 for r in got if r.doc_id == 7 and r.kept == "") == 1
    out = line_dedup.without_repeated_lines(docs.where("doc_id IS NOT NULL"), chars_col="size")
    assert out.columns == docs.columns


def string_rule(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out.setdefault(i, []).append((bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    return out


@pytest.mark.parametrize("config", [repeats.RepeatConfig(), repeats.RepeatConfig(hot=0), repeats.RepeatConfig(unit_bytes=3000, bucket_bytes=4000, group_bytes=2000, index_bytes=1000), repeats.RepeatConfig(unit_bytes=1, hot=2, bucket_bytes=4000, group_bytes=2000, index_bytes=1000)])
def test_strings_equal_brute_force(docs, config):
    """By run-length indexes, by window digests, and by a mix of both over small units."""
    rows = [(r[0], r[1]) for r in corpus()]
    want = string_rule(rows)
    got = defaultdict(list)
    for r in repeats.remove_repeats(docs, config=config).collect():
        got[r.doc_id].append((bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_windows_of_busy_anchors_take_bounded_memory():
    """A batch of busy anchors is examined part by part: no more windows are held than window_bytes has, and each kind of window is left once a part."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 2000, np.uint8)).decode() for _ in range(40)] * 50
    own = [[{"kind": repeats._HOT, "lo": 0, "hi": 1901, "key": 1}]] * len(texts)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64())]))
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(own, kind)], names=["id", "text", "own"])
    tracemalloc.start()
    held, windows, covered = 0, set(), 0
    for part in repeats._examined(repeats.RepeatConfig())(iter([batch])):
        held += part.num_rows
        covered += pc.sum(pc.subtract(part.column("hi"), part.column("lo"))).as_py() or 0
        windows |= {w for w in part.column("bytes").to_pylist()[:50] if w}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(len(w) == 100 for w in windows) and covered >= 40 * 1901
    assert held < 40 * 1901 * 40 and peak < 300e6  # 3.8 million windows of 100 bytes


def test_run_length_index_statistics():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 99, 40, np.uint8)) for _ in range(4)]
    text = np.frombuffer(b"\xff".join([*parts, parts[1], parts[2][:30], b"a" * 50]) + b"\xff", np.uint8)
    index = repeats.RunLengthIndex(text, np.arange(0, len(text), 41), 400)
    before, length = index.statistics()
    stop = [text.tobytes().index(b"\xff", i) for i in range(len(text))]
    suffixes = sorted(range(len(text)), key=lambda i: (bytes(text[i : stop[i] + 1]), i))  # a stop byte is the least of those after it
    assert index.runs < len(text)
    for a, b in zip(suffixes, suffixes[1:]):
        n = 0
        while text[a + n] == text[b + n] != 255:
            n += 1
        assert before[b] == a and length[b] == n


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
