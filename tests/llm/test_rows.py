"""The pipeline's stages where identifiers repeat or are null: every row is judged by itself."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import decontaminate, exact_dedup, line_dedup, near_dedup

TEXTS = {k: prose(900 + i, 60) for i, k in enumerate("tuvwxy")}
TABLE = "doc_id long, text string, lang string, source string, n_chars long"
#: A repeated row, one identifier with two texts, and null identifiers, two of them with one text.
KEYS = [(7, "t"), (7, "t"), (8, "u"), (8, "v"), (None, "w"), (None, "x"), (None, "x"), (None, "y")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, TEXTS[k], "en", "s0", len(TEXTS[k])) for i, k in KEYS], TABLE).repartition(3)


def kept(df):
    names = {t: k for k, t in TEXTS.items()}
    return sorted((str(r.doc_id), names[r.text]) for r in df.collect())


ONE_EACH = sorted({(str(i), k) for i, k in KEYS})


def test_line_dedup_keeps_one_copy(rows):
    out = line_dedup.without_repeated_lines(rows)
    assert out.columns == rows.columns and kept(out) == ONE_EACH


def test_exact_dedup_keeps_one_copy(rows):
    out = exact_dedup.drop_copies(rows)
    assert out.columns == rows.columns and kept(out) == ONE_EACH


def test_exact_dedup_keeps_the_least_identifier(spark):
    table = [(3, "a  b", "x"), (2, "a b", "y"), (None, "a\tb", "z"), (None, "c", "p"), (1, None, "q"), (0, "", "r")]
    out = exact_dedup.drop_copies(spark.createDataFrame(table, "doc_id long, text string, id string").repartition(3))
    assert sorted((str(r.doc_id), r.id) for r in out.collect()) == [("0", "r"), ("2", "y"), ("None", "p")]


def test_near_dedup_keeps_one_copy(rows):
    out = near_dedup.drop_near_copies(rows)
    assert out.columns == rows.columns and kept(out) == ONE_EACH


def test_decontamination_drops_the_row_alone(spark, rows):
    benchmark = spark.createDataFrame([(1, TEXTS["u"]), (2, TEXTS["x"])], "item_id long, text string")
    out = decontaminate.decontaminate(rows, benchmark)
    assert out.columns == rows.columns and kept(out) == sorted((str(i), k) for i, k in KEYS if k not in "ux")


def test_mix_gives_every_row_its_own_words(spark, rows):
    docs = spark.createDataFrame([(i, " ".join(["ab"] * n), "en", "s0", 1) for i, n in [(7, 5), (7, 6), (None, 7), (None, 8), (None, 9)]], TABLE)
    out = corpus_pipeline.mix(spark, docs, "").collect()
    assert sorted(r.size for r in out) == [5, 6, 7, 8, 9]
    assert all(r.size == len(r.text.split()) and r.taken in (r.size, 2 * r.size) for r in out)


def test_pipeline_with_repeated_rows_and_null_identifiers(spark, tmp_path):
    good = [(i, prose(i, 150), "en", f"s{i % 3}", 1) for i in range(60) if i % 4]
    bad = [(i, prose(i, 150).upper(), "en", f"s{i % 3}", 1) for i in range(60) if not i % 4]
    odd = [(i, TEXTS[k], "en", "s0", 1) for i, k in KEYS]
    spark.createDataFrame(good + bad + odd, TABLE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60) if i not in (7, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, TEXTS["y"])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert kept(docs.where(docs.text.isin(list(TEXTS.values())))) == [x for x in ONE_EACH if x[1] != "y"]
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and len({r.text for r in mixed}) == len(mixed) and {r.text for r in mixed} <= {r.text for r in docs.collect()}


def test_items_without_an_identifier_are_hit(spark, rows):
    benchmark = spark.createDataFrame([(None, TEXTS["u"]), (None, TEXTS["w"]), (3, TEXTS["w"])], "item_id long, text string")
    found = decontaminate.contamination(rows, benchmark)
    got = sorted((str(r.doc_id), r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.verdicts(found).collect() if r.n_hit)
    assert got == [("8", 60, 1, decontaminate.items_digest([]), True), ("None", 60, 2, decontaminate.items_digest(["3"]), True)]
    assert kept(decontaminate.decontaminate(rows, benchmark)) == sorted((str(i), k) for i, k in KEYS if k not in "uw")
