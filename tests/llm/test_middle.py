"""Fill-in-middle: digests and outputs against a plain loop over units."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import middle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_loop(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def hostile():
    """Texts that nearly hold a mark, or do; long ones; letters beyond ASCII; one unit."""
    texts = ["<P", "<", "<<<<>>>>", "P>S>M>", "a<P>b", "x<M>", "ÄÖß é 漢字 🙂 " * 50, "a" * 70_000, "a b" * 40_000, "\x00\n\r\t", "é", "<" * 20_000]
    return [(i, t) for k in range(6) for i, t in enumerate(texts, 1000 + 100 * k)]


def expected(rows):
    return sorted(((i, *plain_loop(i, t or "")[:4], sha(plain_loop(i, t or "")[4]), sha(t or "")) for i, t in rows), key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in df.collect()), key=str)


def test_digests_equal_a_plain_loop(docs):
    assert found(middle.fim_digests(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_hostile_and_long_texts(spark):
    rows = hostile()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(middle.fim_digests(docs))
    assert got == expected(rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_marks_split_over_pieces(monkeypatch, spark):
    """The parser finds marks wherever the stream is cut."""
    for form, order in middle.ORDERS.items():
        parts = {middle.PREFIX: b"ab<", middle.MIDDLE: b"<M", middle.SUFFIX: b"<S<<"}
        stream = b"".join(mark + parts[mark] for mark in order)
        for size in range(1, len(stream) + 1):
            got = {0: b"", 1: b"", 2: b""}
            for place, chunk in middle._parts(form, (stream[i : i + size] for i in range(0, len(stream), size))):
                got[place] += chunk
            assert got == {middle.PLACE[m]: p for m, p in parts.items()}


def test_outputs_are_restored_by_an_expression(docs):
    out = middle.fill_in_middle(docs)
    rows = out.withColumn("text", middle.restored(out.output, out.form)).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), r.output) for r in rows) == sorted((str(r.doc_id), plain_loop(r.doc_id, r.text or "")[4]) for r in docs.collect())


def test_no_rows(empty):
    assert middle.fim_digests(empty).collect() == [] and middle.fill_in_middle(empty).collect() == []


def test_names_that_clash_with_the_pieces(spark):
    docs = spark.createDataFrame([(1, prose(1, 50), 5, "x"), (2, None, 6, "y")], "id long, chunk string, at long, form string")
    got = found(middle.fim_digests(docs, "id", "chunk").withColumnRenamed("id", "doc_id"))
    assert got == expected([(1, prose(1, 50)), (2, None)])


@pytest.mark.parametrize("text", ["", "abc", "a1b", "1a", "éaé"])
def test_units(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = middle.unit_starts(data, np.array([0, len(data)]))
    assert len(starts) == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S))
