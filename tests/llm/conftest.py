from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "ze") for b in ("ban", "del", "fir", "gor", "hul", "jas")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def edited(text: str, seed: int, every: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for i in range(every, len(words), every):
        words[i] = rng.choice(WORDS) + "x"
    return " ".join(words)


def corpus() -> list[tuple]:
    """Rows with nulls, empty and long texts, ties, repeats, copies and columns whose names clash."""
    base = [prose(i, 60 + 25 * i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[3]), (101, base[3].replace(" ", "  ")), (102, base[3]), (103, edited(base[9], 1, 40)), (104, edited(base[9], 2, 60)), (105, base[5] + "\n" + base[6])]
    rows += [(200, ""), (201, None), (202, " \n\t "), (203, "one"), (204, "one two three"), (None, base[1]), (7, base[7]), (205, "abc " * 3000), (206, base[2][:150] + " ÄÖ ß é " + base[2][150:])]
    return [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", 1, "x", k) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, id long, bucket string, size long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(docs):
    """The rows with distinct identifiers."""
    return docs.where("doc_id IS NOT NULL AND NOT (doc_id = 7 AND id = 0)").dropDuplicates(["doc_id"])
